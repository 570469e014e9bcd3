"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.session import cut_lineage


def _compress(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every ``hi`` ends at the root of its tree.

    ``lo`` is always smaller than ``hi``, so there are no cycles, and each round
    halves the depth.
    """
    while True:
        up = parents.select(F.col("hi").alias("_at"), F.col("lo").alias("_up"))
        jumped = cut_lineage(
            parents.join(up, F.col("lo") == F.col("_at"), "left").select(
                "hi", F.coalesce("_up", "lo").alias("lo"), F.col("_up").isNotNull().alias("_moved")
            )
        )
        parents = jumped.select("hi", "lo")
        if jumped.where("_moved").limit(1).isEmpty():
            return parents


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) per node with a link; the root is the smallest node reachable.

    Each round hooks every node below its smallest neighbour, flattens those
    trees, and keeps the links between different roots, which at least halves the
    nodes left. All state lies in written tables. Every join reads two written
    tables, so Spark can split the rows of a node that many others point to.
    Null ends and loops are no links; an empty table gives an empty result.
    """
    pair = [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]
    left = cut_lineage(links.where(F.col(a) != F.col(b)).select(*pair).distinct())
    roots = None
    while not left.limit(1).isEmpty():
        hooked = _compress(cut_lineage(left.groupBy("hi").agg(F.min("lo").alias("lo"))))
        up = hooked.select(F.col("hi").alias("_at"), F.col("lo").alias("_up"))
        # the map of this round carries the roots of earlier rounds onwards
        if roots is None:
            roots = hooked
        else:
            moved = roots.join(up, F.col("lo") == F.col("_at"), "left").select(
                "hi", F.coalesce("_up", "lo").alias("lo")
            )
            roots = cut_lineage(moved.unionByName(hooked.join(roots.select("hi"), "hi", "left_anti")))
        one = cut_lineage(
            left.join(up, F.col("hi") == F.col("_at"), "left").select(F.coalesce("_up", "hi").alias("hi"), "lo")
        )
        both = one.join(up, F.col("lo") == F.col("_at"), "left").select("hi", F.coalesce("_up", "lo").alias("lo"))
        left = cut_lineage(
            both.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        )
    if roots is None:
        roots = left
    ends = roots.select(F.col("lo").alias("hi"), "lo").distinct()
    return roots.unionByName(ends).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
