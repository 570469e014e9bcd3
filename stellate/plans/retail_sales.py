"""Shop sales: growth, stores, weekdays, hours and products.

Input: one row per sold line with product_id, sale_date, sale_hour, store,
quantity and revenue (decimal), and the items with product_id, product and
category. Lines are reduced to one row per product id before they meet the
items, so a best seller is no hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellate.functions import calendar
from stellate.functions.bands import Scale
from stellate.functions.rates import percent, ratio, rows
from stellate.operators import periods
from stellate.operators.numbering import with_position
from stellate.operators.shares import with_share
from stellate.operators.star import totals_by_attribute

# Morning Rush is 08:00 to 11:00 and Midday the four hours after it.
# The other day parts are ours: the hours before, and two after.
DAY_PARTS = Scale((8, 11, 15, 18), ("Opening", "Morning Rush", "Midday", "Afternoon", "Evening"))


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Revenue per month with its change on the month before and first-to-last growth."""
    months = sales.groupBy(F.trunc("sale_date", "month").alias("month_start")).agg(
        F.sum("revenue").alias("revenue")
    )
    return months.select(
        "month_start",
        "revenue",
        periods.change_from_previous("revenue", "month_start").alias("mom_pct"),
        periods.change_from_first("revenue", "month_start").alias("growth_first_to_last_pct"),
    ).orderBy("month_start")


def stores(sales: DataFrame) -> DataFrame:
    """Revenue per store and per open day, and how far the best store is above the worst."""
    per_day = sales.groupBy("store", "sale_date").agg(F.sum("revenue").alias("revenue"))
    totals = per_day.groupBy("store").agg(F.sum("revenue").alias("revenue"), rows().alias("days"))
    every = Window.partitionBy()
    high, low = (f("revenue").over(every).cast("double") for f in (F.max, F.min))
    return totals.select(
        "store",
        "revenue",
        "days",
        ratio(F.col("revenue"), F.col("days")).alias("revenue_per_day"),
        (F.try_divide(high - low, low) * 100).alias("spread_pct"),
    ).orderBy(F.desc("revenue"), "store")


def weekday_weekend(sales: DataFrame) -> DataFrame:
    """Per calendar day, because there are more weekdays than weekend days."""
    days = sales.groupBy("sale_date").agg(F.sum("revenue").alias("revenue"))
    kind = F.when(calendar.iso_weekday(F.col("sale_date")) >= 6, "Weekend").otherwise("Weekday")
    return (
        days.groupBy(kind.alias("day_kind"))
        .agg(F.sum("revenue").alias("revenue"), rows().alias("days"))
        .select("day_kind", "revenue", "days", ratio(F.col("revenue"), F.col("days")).alias("revenue_per_day"))
        .orderBy("day_kind")
    )


def hour_profile(sales: DataFrame) -> DataFrame:
    hours = sales.groupBy("sale_hour").agg(rows().alias("lines"), F.sum("revenue").alias("revenue"))
    return with_share(hours, "revenue", "share_pct", 1).orderBy("sale_hour")


def day_part_shares(sales: DataFrame) -> DataFrame:
    hours = sales.groupBy("sale_hour").agg(F.sum("revenue").alias("revenue"))
    parts = hours.groupBy(
        DAY_PARTS.label(F.col("sale_hour")).alias("day_part"), DAY_PARTS.order(F.col("sale_hour")).alias("part_order")
    ).agg(F.sum("revenue").alias("revenue"), rows().alias("hours"))
    return with_share(parts, "revenue", "share_pct", 1).orderBy("part_order")


def products(sales: DataFrame, items: DataFrame) -> DataFrame:
    parts = {"quantity": F.sum("quantity"), "revenue": F.sum("revenue")}
    return totals_by_attribute(sales, items, "product_id", ["product", "category"], parts)


def top_products(sales: DataFrame, items: DataFrame, by: str, k: int) -> DataFrame:
    return products(sales, items).orderBy(F.desc(by), "product", "category").limit(k)


def category_shares(sales: DataFrame, items: DataFrame) -> DataFrame:
    totals = totals_by_attribute(sales, items, "product_id", ["category"], {"revenue": F.sum("revenue")})
    return with_share(totals, "revenue", "share_pct", 1).orderBy(F.desc("revenue"), "category")


def leaders_compared(sales: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The best sellers by quantity next to their place among all products by revenue."""
    place = products(sales, items)
    for measure in ("quantity", "revenue"):
        order = [F.desc(measure), F.asc("product"), F.asc("category")]
        place = with_position(place, order, f"{measure}_rank", "_n").drop("_n")
    return (
        place.withColumns({c: F.col(c) + 1 for c in ("quantity_rank", "revenue_rank")})
        .filter(F.col("quantity_rank") <= k)
        .orderBy("quantity_rank")
    )
