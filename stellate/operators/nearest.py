"""Exact nearest target per point, by walking a packed tree of the targets with a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.functions.geo import cartesian_km, haversine_km
from stellate.operators.numbering import with_position

FANOUT_BITS = 5  # a node has 32 children
_SLACK_KM = 1e-5  # answers are compared to the millimetre; nothing that close is left out
_AXES = ("x", "y", "z")


def _spread(value: Column) -> Column:
    """Puts a zero between any two bits of a 31-bit number."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def _z_order(lat: Column, lon: Column) -> Column:
    """Neighbours in this order are mostly neighbours on the map."""
    steps = (1 << 31) - 1
    north = F.floor((lat + 90) / 180 * steps).cast("long")
    east = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * steps).cast("long")
    return _spread(north).bitwiseOR(F.shiftleft(_spread(east), 1))


def _nodes(sites: DataFrame, level: int) -> DataFrame:
    """Boxes around runs of 32 ** level targets, each with one target that stands for the run."""
    node = F.shiftright("_position", FANOUT_BITS * level)
    boxes = [f(f"_{a}").alias(f"_{n}{a}") for a in _AXES for n, f in (("low", F.min), ("high", F.max))]
    one = F.min(F.struct("_position", *[f"_{a}" for a in _AXES])).alias("_one")
    return (
        sites.groupBy(node.alias("_node"))
        .agg(*boxes, one)
        .withColumn("_parent", F.shiftright("_node", FANOUT_BITS))
    )


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def reachable_leaves(places: DataFrame, sites: DataFrame, here: list[str]) -> DataFrame:
    """Per place the leaves (``_at``) that can hold its nearest site; ``_position`` numbers the sites."""
    count = sites.count()
    levels = 0
    while count > 1 << FANOUT_BITS * (levels + 1):
        levels += 1
    place = Window.partitionBy(*here)
    walk = places.withColumns({"_at": F.lit(0).cast("long"), "_bound": F.lit(float("inf"))})
    for level in range(levels, 0, -1):
        nodes = _nodes(sites, level)
        if level == levels:  # at most 32 nodes
            nodes = F.broadcast(nodes)
        met = walk.join(nodes, F.col("_at") == F.col("_parent"))
        to_one = _length([F.col(f"_{a}") - F.col(f"_one._{a}") for a in _AXES])
        outside = _length([
            F.greatest(F.col(f"_low{a}") - F.col(f"_{a}"), F.col(f"_{a}") - F.col(f"_high{a}"), F.lit(0.0)) for a in _AXES
        ])
        kept = [*here, "_x", "_y", "_z", "_at", "_bound"]
        walk = (
            met.withColumns({"_at": F.col("_node"), "_near": to_one, "_box": outside})
            .withColumn("_bound", F.least("_bound", F.min("_near").over(place)))
            .filter(F.col("_box") <= F.col("_bound") + _SLACK_KM)
            .select(*kept)
        )
    return walk


def nearest_target(
    points: DataFrame,
    targets: DataFrame,
    point_id: str,
    target_id: str,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """(point_id, target_id, distance_km) with ties at equal distance going to the lowest id.

    Both sides need unique ids. Distances are compared to the millimetre.
    Points and targets at one place are reduced to one each first. Targets are
    put in an order that keeps neighbours together and packed into nodes of 32,
    those into nodes of 32, and so on. Each place starts at the top and goes on
    only into nodes whose box, seen as a straight line through the Earth, can
    be nearer than the nearest target it knows of. That leaves a few nodes per place and
    level however targets are spread, also where all of them lie far away.
    """
    here = [lat, lon]

    def located(df: DataFrame, key: str) -> DataFrame:
        return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
            key, F.col(lat).cast("double").alias(lat), F.col(lon).cast("double").alias(lon)
        )

    def placed(df: DataFrame) -> DataFrame:
        x, y, z = cartesian_km(F.col(lat), F.col(lon))
        return df.withColumns({"_x": x, "_y": y, "_z": z})

    located_points = located(points, point_id)
    distinct_sites = located(targets, target_id).groupBy(*here).agg(F.min(target_id).alias(target_id))
    order = [_z_order(F.col(lat), F.col(lon)), F.col(lat), F.col(lon)]
    sites = placed(with_position(distinct_sites, order, "_position", "_total"))
    walk = reachable_leaves(placed(located_points.select(*here).distinct()), sites, here)
    leaves = sites.select(
        F.shiftright("_position", FANOUT_BITS).alias("_leaf"), F.col(target_id),
        F.col(lat).alias("_tlat"), F.col(lon).alias("_tlon"),
    )
    pairs = walk.join(leaves, F.col("_at") == F.col("_leaf"))
    km = haversine_km(F.col(lat), F.col(lon), F.col("_tlat"), F.col("_tlon"))
    millimetres = F.floor(km * F.lit(1e6) + F.lit(0.5)).cast("long")
    best = pairs.groupBy(*here).agg(F.min(F.struct(millimetres.alias("mm"), F.col(target_id).alias("id"))).alias("_best"))
    return located_points.join(best, here).select(
        point_id, F.col("_best.id").alias(target_id), (F.col("_best.mm") / F.lit(1e6)).alias("distance_km")
    )
