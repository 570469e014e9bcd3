"""Hospitals and their distance to the nearest qualifying trauma centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions import bands, text
from stellate.functions.literals import literal_table
from stellate.functions.rates import fraction, median_tenths, rows, rows_where
from stellate.operators.gates import counters, row_total, side_by_side
from stellate.operators.joins import missing_keys
from stellate.operators.nearest import nearest_target
from stellate.session import cut_lineage

# Trauma designations (text, category, adult level, pediatric level, has pediatric).
TRAUMA_MAP = [
    ("NOT AVAILABLE", "NOT REPORTED", None, None, False),
    ("LEVEL I", "ADULT", 1, None, False),
    ("LEVEL II", "ADULT", 2, None, False),
    ("LEVEL III", "ADULT", 3, None, False),
    ("LEVEL IV", "ADULT", 4, None, False),
    ("LEVEL V", "ADULT", 5, None, False),
    ("LEVEL I ADULT", "ADULT", 1, None, False),
    ("LEVEL II ADULT", "ADULT", 2, None, False),
    ("LEVEL III ADULT", "ADULT", 3, None, False),
    ("LEVEL I ADULT, LEVEL I PEDIATRIC", "ADULT", 1, 1, True),
    ("LEVEL I, LEVEL I PEDIATRIC", "ADULT", 1, 1, True),
    ("LEVEL I ADULT, LEVEL II PEDIATRIC", "ADULT", 1, 2, True),
    ("LEVEL I, LEVEL II PEDIATRIC", "ADULT", 1, 2, True),
    ("LEVEL II ADULT, LEVEL II PEDIATRIC", "ADULT", 2, 2, True),
    ("LEVEL II, LEVEL II PEDIATRIC", "ADULT", 2, 2, True),
    ("LEVEL II, LEVEL III PEDIATRIC, LEVEL II REHAB", "ADULT", 2, 3, True),
    ("LEVEL II / PEDIATRIC", "ADULT", 2, None, True),
    ("LEVEL I PEDIATRIC", "PEDIATRIC ONLY", None, 1, True),
    ("LEVEL II PEDIATRIC", "PEDIATRIC ONLY", None, 2, True),
    ("PEDIATRIC", "PEDIATRIC ONLY", None, None, True),
    ("LEVEL I PEDIATRIC REHAB", "TRAUMA REHAB", None, None, False),
    ("LEVEL II REHAB", "TRAUMA REHAB", None, None, False),
    ("TRH", "STATE DESIGNATION", None, None, False),
    ("TRF", "STATE DESIGNATION", None, None, False),
    ("CTH", "STATE DESIGNATION", None, None, False),
    ("ATH", "STATE DESIGNATION", 3, None, False),
    ("RTC", "STATE DESIGNATION", 2, None, False),
    ("RTH", "STATE DESIGNATION", 2, None, False),
    ("I-RPTC", "STATE DESIGNATION", None, None, False),
    ("PARC", "STATE DESIGNATION", None, None, False),
    ("REGIONAL", "STATE DESIGNATION", None, None, False),
]
# Territories outside the 50 states and DC; sentinels; the qualifying level.
TERRITORIES = ("PR", "GU", "VI", "AS", "MP", "PW")
UNKNOWN_TEXT, UNKNOWN_BEDS = "NOT AVAILABLE", "-999"
QUALIFYING_LEVEL = 2
LOW_REPORTING = 0.10


def trauma_map(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        TRAUMA_MAP,
        "trauma_raw string, trauma_category string, adult_level short, pediatric_level short, "
        "has_pediatric boolean",
    )


def stage_hospitals(raw: DataFrame) -> DataFrame:
    """Typed hospitals with their trauma level and the number of units at their site.

    Site sizes are counted and joined back; rows with missing site parts belong together. Spark splits
    the rows of a site that holds a large part of them.
    """
    site = ["name", "address", "city"]
    sizes = raw.groupBy(*[F.col(c).alias(f"_{c}") for c in site]).agg(rows().alias("units_at_site"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in site]
    sized = raw.join(sizes, same, "left").drop(*[f"_{c}" for c in site])
    levels = trauma_map(raw.sparkSession).withColumnsRenamed(
        {
            "trauma_raw": "trauma",
            "adult_level": "trauma_adult_level",
            "pediatric_level": "trauma_pediatric_level",
            "has_pediatric": "has_pediatric_trauma",
        }
    )
    owner = F.col("owner")
    return sized.join(F.broadcast(levels), "trauma", "left").select(
        F.col("id").alias("hospital_id"),
        F.col("name").alias("hospital_name"),
        text.absent(F.col("alt_name"), UNKNOWN_TEXT).alias("alt_name"),
        F.col("type").alias("hospital_type"),
        "status",
        text.absent(owner, UNKNOWN_TEXT).alias("owner_type"),
        F.when(owner.startswith("GOVERNMENT"), "GOVERNMENT")
        .otherwise(text.absent(owner, UNKNOWN_TEXT))
        .alias("owner_group"),
        "address", "city", "state", "zip", "county",
        F.col("countyfips").alias("county_fips"),
        F.col("st_fips").alias("state_fips"),
        "country",
        (~F.col("state").isin(*TERRITORIES)).alias("is_us_state"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        text.absent(F.col("beds"), UNKNOWN_BEDS).cast("int").alias("beds"),
        "naics_code", "naics_desc",
        text.yes_no(F.col("helipad")).alias("has_helipad"),
        text.absent(F.col("trauma"), UNKNOWN_TEXT).alias("trauma_raw"),
        "trauma_category", "trauma_adult_level", "trauma_pediatric_level", "has_pediatric_trauma",
        text.absent(F.col("website"), UNKNOWN_TEXT).alias("website"),
        F.to_date(F.left(F.col("sourcedate"), F.lit(10)), "yyyy/MM/dd").alias("source_date"),
        F.col("units_at_site").cast("long").alias("units_at_site"),
    )


def in_scope(staged: DataFrame) -> DataFrame:
    return staged.filter((F.col("status") == "OPEN") & F.col("is_us_state"))


def hospital_access(staged: DataFrame) -> DataFrame:
    """One row per open hospital with its nearest qualifying centre.

    The open hospitals serve as points, as centres and as the final rows, so
    they are materialised once.
    """
    base = cut_lineage(in_scope(staged))
    qualifies = F.col("trauma_adult_level") <= QUALIFYING_LEVEL
    centres = base.filter(qualifies).select(
        F.col("hospital_id").alias("nearest_trauma_id"),
        F.col("hospital_name").alias("nearest_trauma_name"),
        F.col("state").alias("nearest_trauma_state"),
        "latitude",
        "longitude",
    )
    found = nearest_target(base, centres, "hospital_id", "nearest_trauma_id").withColumnRenamed(
        "distance_km", "_km"
    )
    named = found.join(centres.drop("latitude", "longitude"), "nearest_trauma_id", "left")
    # Without coordinates (or without any centre) a distance is unknown: such a
    # hospital keeps its row, has no centre, falls into the last band and shows
    # up in the distance gate.
    km = F.col("_km")
    return base.join(named, "hospital_id", "left").select(
        "hospital_id", "hospital_name", "hospital_type", "owner_group", "owner_type", "address",
        "city", "state", "county", "county_fips", "latitude", "longitude", "beds", "units_at_site",
        "has_helipad", "trauma_category", "trauma_adult_level",
        F.coalesce(qualifies, F.lit(False)).alias("is_level12_trauma"),
        "nearest_trauma_id", "nearest_trauma_name", "nearest_trauma_state",
        F.round(km.cast("decimal(18,6)"), 1).cast("decimal(10,1)").alias("distance_km"),
        bands.DISTANCE.label(km).alias("distance_band"),
        bands.DISTANCE.order(km).alias("distance_band_order"),
    )


def _per_distance(access: DataFrame, *by: str) -> DataFrame:
    """Totals per group and distance.

    Distances have one decimal and end at half the Earth's circumference, so a
    group has at most some 200,000 of them however many hospitals it holds:
    exact medians are taken over these rows and their counts.
    """
    return access.groupBy(*by, "distance_km").agg(
        rows().alias("n"),
        F.sum("beds").alias("beds"),
        F.count("beds").alias("reported"),
        rows_where(F.col("is_level12_trauma")).alias("level12"),
        rows_where(F.col("hospital_type") == "CRITICAL ACCESS").alias("critical"),
        rows_where(F.col("trauma_category") != "NOT REPORTED").alias("designated"),
    )


def _n_far() -> Column:
    return F.coalesce(F.sum(F.when(F.col("distance_km") > 100, F.col("n"))), F.lit(0))


def state_summary(access: DataFrame) -> DataFrame:
    """Fourteen columns per state. A site counts once even where a part of its name is missing.

    Sites are counted on their own, so that the median does not have to be
    carried through the distinct step; states are a bounded set.
    """
    sites = access.groupBy("state").agg(
        F.count_distinct(F.struct("hospital_name", "address", "city")).alias("n_sites")
    )
    totals = _per_distance(access, "state").groupBy("state").agg(
        F.sum("n").alias("n_hospitals"),
        F.sum("beds").alias("total_beds"),
        F.sum("reported").alias("reported"),
        F.sum("level12").alias("n_level12_trauma"),
        F.sum("critical").alias("n_critical_access"),
        median_tenths(F.col("distance_km"), F.col("n")).alias("median_distance_km"),
        F.max("distance_km").cast("double").alias("max_distance_km"),
        _n_far().alias("n_over_100km"),
        F.sum("designated").alias("designated"),
    )
    n = F.col("n_hospitals")
    low = F.col("designated").cast("decimal(20,2)") < n * F.lit(LOW_REPORTING).cast("decimal(3,2)")
    return totals.withColumnRenamed("state", "_state").join(sites, F.col("_state").eqNullSafe(F.col("state"))).select(
        "state", "n_hospitals", "n_sites", "total_beds",
        fraction(F.col("reported"), n, 4).alias("pct_beds_reported"),
        "n_level12_trauma", "n_critical_access",
        fraction(F.col("n_critical_access"), n, 4).alias("pct_critical_access"),
        "median_distance_km", "max_distance_km", "n_over_100km",
        fraction(F.col("n_over_100km"), n, 4).alias("pct_over_100km"),
        fraction(F.col("designated"), n, 4).alias("trauma_reporting_rate"),
        F.when(low, "LOW").otherwise("OK").alias("trauma_reporting_flag"),
    )


def farthest(access: DataFrame, k: int = 10) -> DataFrame:
    return (
        access.orderBy(F.desc_nulls_last("distance_km"), "hospital_id")
        .limit(k)
        .select(
            "hospital_name", "city", "state", "hospital_type", "nearest_trauma_name",
            "nearest_trauma_state", F.col("distance_km").cast("double").alias("distance_km"),
        )
    )


def _distances(access: DataFrame, *by: str) -> DataFrame:
    return (
        _per_distance(access, *by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            median_tenths(F.col("distance_km"), F.col("n")).alias("median_km"),
            _n_far().alias("n_over_100km"),
        )
    )


def distance_by_type(access: DataFrame) -> DataFrame:
    return _distances(access, "hospital_type").orderBy(F.desc_nulls_last("median_km"), "hospital_type")


def national_distance(access: DataFrame) -> DataFrame:
    return _distances(access)


# -- gates --------------------------------------------------------------------


def unmapped_designations(raw: DataFrame) -> DataFrame:
    known = trauma_map(raw.sparkSession).select(F.col("trauma_raw").alias("trauma"))
    return missing_keys(raw, known, "trauma")


def null_profile(staged: DataFrame) -> DataFrame:
    columns = {
        "beds_null": "beds", "owner_null": "owner_type", "helipad_null": "has_helipad",
        "website_null": "website", "source_date_null": "source_date",
    }
    return counters(staged, {name: F.col(c).isNull() for name, c in columns.items()})


def category_distribution(staged: DataFrame) -> DataFrame:
    return staged.groupBy("trauma_category").agg(rows().alias("n")).orderBy(F.desc("n"), "trauma_category")


def row_check(staged: DataFrame, access: DataFrame) -> DataFrame:
    return side_by_side(
        row_total(staged, "staged_rows"),
        row_total(in_scope(staged), "expected_rows"),
        row_total(access, "actual_rows"),
    )


def distance_gate(access: DataFrame) -> DataFrame:
    km = F.col("distance_km")
    return counters(
        access,
        {
            "distance_null": km.isNull(),
            "trauma_center_not_zero": F.col("is_level12_trauma") & (km != 0),
            "distance_negative": km < 0,
        },
    )


def summary_check(summary: DataFrame) -> DataFrame:
    return summary.agg(F.sum("n_hospitals").alias("total_hospitals"), rows().alias("n_states"))
