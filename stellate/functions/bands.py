"""Label bands with a parallel sort order, defined once per scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions.literals import literal_table


@dataclass(frozen=True)
class Scale:
    """Half-open bands: label i covers [cuts[i-1], cuts[i]); the last one has no upper end."""

    cuts: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.cuts) + 1 or list(self.cuts) != sorted(self.cuts):
            raise ValueError("a scale needs rising cuts and one label more than cuts")

    def _pick(self, value: Column, results: list[Column]) -> Column:
        chain = F
        for cut, result in zip(self.cuts, results):
            chain = chain.when(value < F.lit(cut), result)
        return chain.otherwise(results[-1])

    def label(self, value: Column) -> Column:
        """Band label; an unknown value falls into the last band."""
        return self._pick(value, [F.lit(text) for text in self.labels])

    def order(self, value: Column) -> Column:
        return self._pick(value, [F.lit(i + 1) for i in range(len(self.labels))]).cast("short")

    def key(self, value: Column) -> Column:
        """Band key as a foreign key: an unknown or below-range value has none."""
        return F.when(value >= 0, self.order(value))

    def as_table(self, spark: SparkSession, prefix: str) -> DataFrame:
        lowers = (0, *self.cuts)
        uppers = (*self.cuts, None)
        rows = [(i + 1, t, lo, hi) for i, (t, lo, hi) in enumerate(zip(self.labels, lowers, uppers))]
        return literal_table(
            spark,
            rows,
            f"{prefix}_key short, {prefix} string, lower_bound decimal(12,2), upper_bound decimal(12,2)",
        )


# Band cut-offs and labels.
AGE = Scale((35, 45, 55, 65), ("Under 35", "35-44", "45-54", "55-64", "65+"))
CREDIT = Scale(
    (580, 670, 740, 800),
    ("Poor (<580)", "Fair (580-669)", "Good (670-739)", "Very Good (740-799)", "Exceptional (800+)"),
)
INCOME = Scale((40000, 60000, 80000, 120000), ("Under $40k", "$40-60k", "$60-80k", "$80-120k", "$120k+"))
DEBT_TO_INCOME = Scale((1, 2, 3), ("Under 1x", "1-2x", "2-3x", "3x+"))
CREDIT_LIMIT = Scale((5000, 15000, 30000), ("Under $5k", "$5-15k", "$15-30k", "$30k+"))
TICKET = Scale((25, 100, 250, 500), ("Under $25", "$25-100", "$100-250", "$250-500", "$500+"))
DISTANCE = Scale((25, 50, 100, 200), ("< 25 km", "25-50 km", "50-100 km", "100-200 km", "> 200 km"))
