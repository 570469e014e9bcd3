"""The generic test tables in the layout of each subject area's raw sources.

Nothing here is part of a data path in production: these mappings only give
the four areas something to run on. Values that the tables lack are derived
from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions.literals import literal_table
from stellate.sources import schemas

MCC_CODES = [
    5411, 5812, 5541, 3722, 4900, 5815, 5912, 4829, 1711, 3001, 3780, 5311,
    5499, 5813, 7538, 4121, 4814, 7995, 8011, 6300, 5211, 3771, 9999, 5651,
]
STATES = ["CA", "TX", "NY", "FL", "OH", "WA", "Mexico", "Italy"]
ERROR_STEPS = [
    ("Insufficient Balance", 11), ("Bad PIN", 13), ("Technical Glitch", 17), ("Bad Expiration", 19),
    ("Bad Card Number", 23), (" Bad CVV", 29), ("Bad Zipcode", 31),
]
HOSPITAL_STATES = [
    "AK", "AL", "AR", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA",
    "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "PR", "GU",
]
CENTRE_LEVELS = ["LEVEL I", "LEVEL II", "LEVEL I ADULT, LEVEL II PEDIATRIC", "RTC", "LEVEL III", "PEDIATRIC"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: str) -> str:
    """SQL for the value at a 0-based index."""
    listed = ", ".join("NULL" if v is None else repr(v) for v in values)
    return f"get(array({listed}), CAST({index} AS INT))"


def _as_layout(df: DataFrame, schema) -> DataFrame:
    return df.selectExpr(*[f"CAST({name} AS STRING) AS {name}" for name in schema.fieldNames()])


def card_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_k = [",".join(name for name, step in ERROR_STEPS if k % step == 0) or None for k in range(100)]
    named = table(spark, sf_dir, "events").selectExpr(
        "event_id AS n",
        "user_id",
        "event_type = 'error' AS online",
        "event_type",
        "date_add(DATE'2010-01-01', CAST(event_id * 37 % 3591 AS INT)) || ' ' || date_format(ts, 'HH:mm:ss') AS date",
        "CAST(value * 2 AS DECIMAL(12,2)) AS v",
        f"{_pick(by_k, "get_json_object(props, '$.k')")} AS reasons",
    )
    located = named.selectExpr("*", "IF(online AND n % 50 <> 1, 'ONLINE', 'City ' || n % 40) AS merchant_city")
    placed = located.selectExpr(
        "*", f"IF(merchant_city <> 'ONLINE', {_pick(STATES, 'n % 8')}, NULL) AS merchant_state"
    )
    return _as_layout(
        placed.selectExpr(
            "n AS id",
            "date",
            "user_id AS client_id",
            "user_id * 4 + n % 4 AS card_id",
            "'$' || CAST(CASE WHEN n % 97 = 3 THEN 0 WHEN n % 20 = 7 THEN -v ELSE v END AS DECIMAL(12,2)) AS amount",
            "CASE WHEN online THEN 'Online' WHEN event_type IN ('view', 'purchase') THEN 'Chip' ELSE 'Swipe' END"
            " || ' Transaction' AS use_chip",
            "n % 211 AS merchant_id",
            "merchant_city",
            "merchant_state",
            "IF(length(merchant_state) = 2, 10000 + n % 40 * 100 + n % 8 || '.0', NULL) AS zip",
            f"{_pick(MCC_CODES, '(n * 7 + user_id) % 24')} AS mcc",
            "IF(n % 5 < 2, reasons, NULL) AS errors",
        ),
        schemas.TRANSACTIONS,
    )


def card_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_layout(
        table(spark, sf_dir, "customer").selectExpr(
            "c_custkey AS id",
            "18 + c_custkey * 7 % 70 AS current_age",
            "60 + c_custkey % 10 AS retirement_age",
            "1930 + c_custkey % 70 AS birth_year",
            "1 + c_custkey % 12 AS birth_month",
            "IF(c_custkey % 2 = 0, 'Male', 'Female') AS gender",
            "c_name AS address",
            "CAST((2500 + c_custkey * 37 % 2400) / 100 AS DECIMAL(6,2)) AS latitude",
            "CAST((-12400 + c_custkey * 91 % 5700) / 100 AS DECIMAL(6,2)) AS longitude",
            "'$' || (15000 + c_custkey * 113 % 30000) AS per_capita_income",
            "'$' || IF(c_custkey % 50 = 49, 0, 25000 + c_custkey * 997 % 130000) AS yearly_income",
            "'$' || (c_custkey * 1523 % 300000) AS total_debt",
            "480 + c_custkey * 53 % 370 AS credit_score",
            "1 + c_custkey % 5 AS num_credit_cards",
        ),
        schemas.USERS,
    )


def card_cards_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cards per customer, with the sensitive columns that must not be kept."""
    month = "lpad(1 + c % 12, 2, '0')"
    return _as_layout(
        table(spark, sf_dir, "customer")
        .selectExpr("c_custkey AS c", "explode(sequence(0, 3)) AS j")
        .selectExpr(
            "c * 4 + j AS id",
            "c AS client_id",
            f"{_pick(['Visa', 'Mastercard', 'Amex', 'Discover'], '(c + j) % 4')} AS card_brand",
            f"{_pick(['Credit', 'Debit', 'Debit (Prepaid)', 'Credit'], 'j')} AS card_type",
            "4000000000000000 + c * 4 + j AS card_number",
            f"{month} || '/' || (2018 + (c + j) % 6) AS expires",
            "100 + c % 900 AS cvv",
            "IF((c + j) % 5 = 0, 'NO', 'YES') AS has_chip",
            "1 + j % 2 AS num_cards_issued",
            "'$' || ((c * 37 + j * 4000) % 45000) AS credit_limit",
            f"{month} || '/' || (2000 + (c + j) % 10) AS acct_open_date",
            "2005 + c % 12 AS year_pin_last_changed",
            "'No' AS card_on_dark_web",
        ),
        schemas.CARDS_FILE,
    )


def card_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(str(code), f"Code {code}, as listed") for code in MCC_CODES]
    return literal_table(spark, rows, "mcc string, description string")


def card_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About two thirds of the transactions have a label."""
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderstatus <> 'P'")
        .selectExpr(
            "CAST(o_orderkey AS STRING) AS transaction_id",
            "IF(o_totalprice >= 470000, 'Yes', 'No') AS is_fraud",
        )
    )


def card_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw card source in its landed layout."""
    if name == "cards":
        return card_cards_file(spark, sf_dir).drop(*schemas.CARDS_SENSITIVE)
    builders = {
        "transactions": card_transactions,
        "users": card_users,
        "mcc": card_mcc,
        "fraud_labels": card_labels,
    }
    return builders[name](spark, sf_dir)


def bill_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Listrik", "Air", "Internet", "Asuransi", "Telepon"]
    channels = ["ATM", "EDC", "Teller", "Mobile Banking", "Internet Banking"]
    paid = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS o",
        "o_custkey AS c",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS tanggal",
        f"{_pick(kinds, 'o_custkey % 5')} AS kind",
        f"{_pick(channels, 'substr(o_orderpriority, 1, 1) - 1')} AS channel",
        "CASE WHEN o_orderstatus <> 'P' THEN 'Sukses' WHEN o_orderkey % 2 = 0 THEN 'Gagal' ELSE 'Pending ' END AS status",
        "IF(o_orderkey % 101 <> 0, floor(o_totalprice), NULL) AS nominal",
        "IF(o_orderkey % 103 <> 0, 1000 + o_orderkey % 5 * 500, NULL) AS biaya_admin",
    )
    return paid.selectExpr(
        "'TX' || o AS id_transaksi",
        "tanggal",
        "c AS no_rekening",
        "'Nasabah ' || c || '  ' AS nama_nasabah",
        "kind AS jenis_biller",
        "kind || ' ' || c % 3 || ' ' AS nama_biller",
        "c * 7 + 100000 AS nomor_pelanggan",
        "nominal",
        "biaya_admin",
        "coalesce(nominal, 0) + coalesce(biaya_admin, 0) + IF(o % 997 = 5, 1, 0) AS total_bayar",
        "channel",
        "status",
    )


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are plain hospitals, suppliers the ones that may be centres."""

    def degrees(base: int, key: str, step: int, span: int) -> str:
        return f"CAST(({base} + {key} * {step} % {span}) / 100 AS DECIMAL(6,2))"

    plain = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS n",
        "'H' || lpad(c_custkey, 9, '0') AS id",
        "'Hospital ' || c_custkey % 700 AS name",
        "c_custkey % 350 || ' Main St' AS address",
        "IF(c_custkey % 90 <> 7, 'Town ' || c_custkey % 70, NULL) AS city",
        f"{_pick(HOSPITAL_STATES, 'c_nationkey')} AS state",
        f"{_pick(['GENERAL ACUTE CARE', 'CRITICAL ACCESS', 'PSYCHIATRIC'], 'c_custkey % 3')} AS type",
        "IF(c_custkey % 29 = 4, 'CLOSED', 'OPEN') AS status",
        f"{degrees(2500, 'c_custkey', 37, 2400)} AS latitude",
        f"{degrees(-12400, 'c_custkey', 91, 5700)} AS longitude",
        "IF(c_custkey % 11 = 0, '-999', CAST(10 + c_custkey % 400 AS STRING)) AS beds",
        "CASE WHEN c_custkey % 4 = 0 THEN 'LEVEL IV' WHEN c_custkey % 203 = 9 THEN 'SOMETHING NEW'"
        " ELSE 'NOT AVAILABLE' END AS trauma",
        f"{_pick(['Y', 'N', 'NOT AVAILABLE'], 'c_custkey % 3')} AS helipad",
        f"{_pick(['GOVERNMENT - LOCAL', 'NON-PROFIT', 'NOT AVAILABLE', 'GOVERNMENT - FEDERAL'], 'c_custkey % 4')} AS owner",
    )
    centres = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS n",
        "'S' || lpad(s_suppkey, 9, '0') AS id",
        "'Centre ' || s_suppkey AS name",
        "s_suppkey || ' High St' AS address",
        "'Town ' || s_suppkey % 70 AS city",
        f"{_pick(HOSPITAL_STATES, 's_nationkey')} AS state",
        "'GENERAL ACUTE CARE' AS type",
        "'OPEN' AS status",
        f"{degrees(2500, 's_suppkey', 53, 2400)} AS latitude",
        f"{degrees(-12400, 's_suppkey', 71, 5700)} AS longitude",
        "CAST(100 + s_suppkey % 900 AS STRING) AS beds",
        f"{_pick(CENTRE_LEVELS, 's_suppkey % 6')} AS trauma",
        "'Y' AS helipad",
        "'NON-PROFIT' AS owner",
    )
    both = plain.unionByName(centres).selectExpr(
        "*",
        "IF(n % 2 = 0, 'NOT AVAILABLE', 'Alt ' || n) AS alt_name",
        "IF(n % 5 = 0, 'NOT AVAILABLE', 'http://h/' || n) AS website",
        "'20' || lpad(10 + n % 14, 2, '0') || '/' || lpad(1 + n % 12, 2, '0') || '/' || lpad(1 + n % 28, 2, '0')"
        " || ' 00:00:00+00' AS sourcedate",
        "lpad(n % 99999, 5, '0') AS zip",
        "'County ' || n % 30 AS county",
        "n % 30 AS countyfips",
        "n % 56 AS st_fips",
        "'USA' AS country",
        "'622110' AS naics_code",
        "'GENERAL MEDICAL AND SURGICAL HOSPITALS' AS naics_desc",
    )
    rest = [f"NULL AS {c}" for c in schemas.HOSPITALS.fieldNames() if c not in both.columns]
    return _as_layout(both.selectExpr("*", *rest), schemas.HOSPITALS)


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS product_id",
        "CAST(l_shipdate AS DATE) AS sale_date",
        "CAST(6 + (l_orderkey * 7 + l_linenumber) % 14 AS INT) AS sale_hour",
        f"{_pick(['Harbour', 'Station', 'University'], 'l_suppkey % 3')} AS store",
        "CAST(l_quantity AS BIGINT) AS quantity",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS revenue",
    )


def retail_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS product", "p_type AS category"
    )
