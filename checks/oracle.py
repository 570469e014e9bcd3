"""Independent SQL for the registered queries, written against the generic tables.

Rates are rounded in integer arithmetic, so that both engines agree on the
last digit without relying on how either rounds floating point.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def pct(part: str, whole: str, digits: int, scale: int = 100) -> str:
    """scale x part / whole for integers, rounded half up to the digits."""
    step = 10**digits
    n, d = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    return (
        f"CASE WHEN {whole} <> 0 THEN CAST(({2 * scale * step} * {n} + {d}) // (2 * {d}) AS DOUBLE) / 1e{digits} END"
    )


def cents(money: str) -> str:
    return f"CAST(({money}) * 100 AS HUGEINT)"


def share(column: str, digits: int, within: str = "") -> str:
    over = f"OVER ({within})"
    return pct(column, f"(SUM({column}) {over})", digits)


# -- card ---------------------------------------------------------------------

# Decline reasons, spend categories of the listed codes, bands and their labels.
_CARD = """
WITH reasons(error_key, error_name, fault_owner, step) AS (VALUES
  (1, 'Insufficient Balance', 'Customer', 11), (2, 'Bad PIN', 'Customer', 13),
  (3, 'Technical Glitch', 'Issuer', 17), (4, 'Bad Expiration', 'Issuer', 19),
  (5, 'Bad Card Number', 'Data entry', 23), (6, 'Bad CVV', 'Data entry', 29),
  (7, 'Bad Zipcode', 'Data entry', 31)),
codes(mcc, spend_category) AS (VALUES
  (5411, 'Groceries & Food Retail'), (5812, 'Restaurants & Bars'), (5541, 'Fuel & Automotive'),
  (3722, 'Transport & Travel'), (4900, 'Utilities & Telecom'), (5815, 'Digital & Entertainment'),
  (5912, 'Health & Personal Care'), (4829, 'Financial & Professional Services'),
  (1711, 'Home & Trade Supplies'), (3001, 'Home & Trade Supplies'), (3780, 'Utilities & Telecom'),
  (5311, 'General Retail & Apparel'), (5499, 'Groceries & Food Retail'), (5813, 'Restaurants & Bars'),
  (7538, 'Fuel & Automotive'), (4121, 'Transport & Travel'), (4814, 'Utilities & Telecom'),
  (7995, 'Digital & Entertainment'), (8011, 'Health & Personal Care'),
  (6300, 'Financial & Professional Services'), (5211, 'Home & Trade Supplies'),
  (3771, 'Transport & Travel'), (9999, 'General Retail & Apparel'), (5651, 'General Retail & Apparel')),
ev AS (
  SELECT event_id AS n, user_id AS u, ts, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(value * 2 AS DECIMAL(12,2)) AS v,
    CAST(DATE '2010-01-01' + CAST((event_id * 37) % 3591 AS INTEGER) AS DATE) AS d
  FROM events),
tx AS (
  SELECT n AS transaction_id, d, ts, u AS client_id, u * 4 + n % 4 AS card_id, n % 211 AS merchant_id,
    CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS date_key,
    CAST(year(d) AS BIGINT) AS year, CAST(hour(ts) AS BIGINT) AS hour_of_day,
    CAST(CASE WHEN n % 97 = 3 THEN 0 WHEN n % 20 = 7 THEN -v ELSE v END AS DECIMAL(12,2)) AS amount,
    CAST(CASE WHEN n % 97 = 3 THEN 0 ELSE v END AS DECIMAL(12,2)) AS abs_amount,
    CASE event_type WHEN 'error' THEN 'Online' WHEN 'view' THEN 'Chip' WHEN 'purchase' THEN 'Chip' ELSE 'Swipe' END
      AS channel_name,
    event_type = 'error' AS is_online,
    CASE WHEN event_type = 'error' AND n % 50 <> 1 THEN 'ONLINE' ELSE 'City ' || (n % 40) END AS city,
    CASE WHEN event_type <> 'error' OR n % 50 = 1
      THEN (['CA','TX','NY','FL','OH','WA','Mexico','Italy'])[1 + n % 8] END AS state,
    CASE WHEN (event_type <> 'error' OR n % 50 = 1) AND n % 8 < 6 THEN 10000 + (n % 40) * 100 + n % 8 END AS zip,
    ([5411, 5812, 5541, 3722, 4900, 5815, 5912, 4829, 1711, 3001, 3780, 5311,
      5499, 5813, 7538, 4121, 4814, 7995, 8011, 6300, 5211, 3771, 9999, 5651])[1 + (n * 7 + u) % 24] AS mcc,
    k, n % 5 < 2 AS may_fail,
    n % 5 < 2 AND (k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 OR k % 31 = 0)
      AS is_failed,
    n % 5 < 2 AND (k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0) AS is_stale,
    o.o_orderkey IS NOT NULL AS labelled,
    COALESCE(o.o_totalprice >= 470000, FALSE) AS fraud,
    CASE WHEN v * CAST(n % 97 <> 3 AS INTEGER) < 25 THEN 1 WHEN v < 100 THEN 2 WHEN v < 250 THEN 3
      WHEN v < 500 THEN 4 ELSE 5 END AS band
  FROM ev LEFT JOIN orders o ON o.o_orderkey = n AND o.o_orderstatus <> 'P'),
bi AS (SELECT * FROM tx WHERE date_key >= 20170101),
br AS (SELECT tx.*, reasons.* FROM tx JOIN reasons ON may_fail AND k % step = 0),
bibr AS (SELECT * FROM br WHERE date_key >= 20170101),
clients AS (
  SELECT c_custkey AS client_id, 18 + (c_custkey * 7) % 70 AS age,
    480 + (c_custkey * 53) % 370 AS score,
    CASE WHEN c_custkey % 50 = 49 THEN 0 ELSE 25000 + (c_custkey * 997) % 130000 END AS income,
    (c_custkey * 1523) % 300000 AS debt
  FROM customer),
dti AS (
  SELECT *, CASE WHEN income <> 0 THEN (2000 * debt + income) // (2 * income) END AS dti_milli FROM clients),
banded AS (
  SELECT *,
    CASE WHEN age < 35 THEN 1 WHEN age < 45 THEN 2 WHEN age < 55 THEN 3 WHEN age < 65 THEN 4 ELSE 5 END AS age_o,
    CASE WHEN score < 580 THEN 1 WHEN score < 670 THEN 2 WHEN score < 740 THEN 3 WHEN score < 800 THEN 4 ELSE 5 END
      AS credit_o,
    CASE WHEN income < 40000 THEN 1 WHEN income < 60000 THEN 2 WHEN income < 80000 THEN 3 WHEN income < 120000 THEN 4
      ELSE 5 END AS income_o,
    CASE WHEN dti_milli < 1000 THEN 1 WHEN dti_milli < 2000 THEN 2 WHEN dti_milli < 3000 THEN 3 ELSE 4 END AS dti_o
  FROM dti),
dim_client AS (
  SELECT *,
    (['Under 35','35-44','45-54','55-64','65+'])[age_o] AS age_band,
    (['Poor (<580)','Fair (580-669)','Good (670-739)','Very Good (740-799)','Exceptional (800+)'])[credit_o] AS credit_band,
    (['Under $40k','$40-60k','$60-80k','$80-120k','$120k+'])[income_o] AS income_band,
    (['Under 1x','1-2x','2-3x','3x+'])[dti_o] AS dti_band
  FROM banded),
dim_card AS (
  SELECT c_custkey * 4 + j AS card_id, c_custkey AS client_id, c_custkey, j,
    (['Visa','Mastercard','Amex','Discover'])[1 + (c_custkey + j) % 4] AS card_brand,
    (['Credit','Debit','Debit (Prepaid)','Credit'])[1 + j] AS card_type,
    (c_custkey + j) % 5 <> 0 AS has_chip,
    (c_custkey * 37 + j * 4000) % 45000 AS credit_limit,
    CASE WHEN (c_custkey * 37 + j * 4000) % 45000 < 5000 THEN 1 WHEN (c_custkey * 37 + j * 4000) % 45000 < 15000 THEN 2
      WHEN (c_custkey * 37 + j * 4000) % 45000 < 30000 THEN 3 ELSE 4 END AS limit_o
  FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) AS four(j)),
days AS (
  SELECT CAST(g AS DATE) AS full_date FROM generate_series(DATE '2010-01-01', DATE '2019-12-31', INTERVAL 1 DAY) AS t(g)),
bidays AS (
  SELECT full_date FROM days WHERE full_date >= DATE '2017-01-01' AND full_date <= (SELECT MAX(d) FROM tx))
"""


def card(name: str, sql: str) -> None:
    ORACLE[name] = _CARD + sql


_FAILED = "SUM(CASE WHEN is_failed THEN 1 ELSE 0 END)"
_FAILED_VALUE = "CAST(ROUND(SUM(CASE WHEN is_failed THEN abs_amount END)) AS BIGINT)"
_LABELLED = "SUM(CASE WHEN labelled THEN 1 ELSE 0 END)"
_FRAUDS = "SUM(CASE WHEN fraud THEN 1 ELSE 0 END)"
_LOSS = "CAST(ROUND(SUM(CASE WHEN fraud THEN abs_amount END)) AS BIGINT)"
_FAIL_RATE = pct(_FAILED, "COUNT(*)", 3) + " AS failure_rate_pct"
_FRAUD_RATE = pct(_FRAUDS, _LABELLED, 4) + " AS fraud_rate_pct"
_FRAUD_CENTS = cents("COALESCE(SUM(CASE WHEN fraud THEN abs_amount END), 0)")
_CLEAN = "SUM(CASE WHEN labelled AND NOT fraud THEN 1 ELSE 0 END)"
_CLEAN_CENTS = cents("COALESCE(SUM(CASE WHEN labelled AND NOT fraud THEN abs_amount END), 0)")
_AVG_FRAUD = pct(_FRAUD_CENTS, f"(100 * {_FRAUDS})", 2, 1) + " AS avg_fraud_ticket"
_AVG_CLEAN = pct(_CLEAN_CENTS, f"(100 * {_CLEAN})", 2, 1) + " AS avg_clean_ticket"


def n(count: str, name: str) -> str:
    return f"CAST({count} AS BIGINT) AS {name}"


card("f3_1_1_leakage_by_year", f"""
SELECT year, {n('COUNT(*)', 'transactions')}, {n(_FAILED, 'failed')}, {_FAIL_RATE}, {_FAILED_VALUE} AS failed_value_usd
FROM bi GROUP BY year""")
card("f3_1_2_failures_by_error", f"""
, t AS (SELECT fault_owner, error_name, COUNT(*) AS c, SUM(abs_amount) AS v FROM bibr GROUP BY fault_owner, error_name)
SELECT fault_owner, error_name, {n('c', 'occurrences')}, CAST(ROUND(v) AS BIGINT) AS value_usd,
  {share('c', 2)} AS pct_of_failures FROM t""")
card("n_1_fault_owner_totals", f"""
, t AS (SELECT fault_owner, COUNT(*) AS c, SUM(abs_amount) AS v FROM bibr GROUP BY fault_owner),
u AS (SELECT *, {cents('v')} AS vc FROM t)
SELECT fault_owner, {n('c', 'occurrences')}, CAST(ROUND(v) AS BIGINT) AS value_usd, {share('vc', 1)} AS pct_of_value FROM u""")
card("f3_1_3_failure_by_channel", f"""
SELECT channel_name, {n('COUNT(*)', 'transactions')}, {_FAIL_RATE}, {_FAILED_VALUE} AS failed_value_usd
FROM bi GROUP BY channel_name""")
card("f3_1_4_expired_card_declines", f"""
SELECT year, {n('COUNT(*)', 'expired_card_declines')}, CAST(ROUND(SUM(abs_amount)) AS BIGINT) AS value_usd,
  {n('COUNT(DISTINCT card_id)', 'cards_affected')}
FROM bibr WHERE error_name = 'Bad Expiration' GROUP BY year""")
card("n_7_cards_hit_by_expiry_per_year", f"""
SELECT year, {n('COUNT(DISTINCT card_id)', 'cards_affected')} FROM bibr WHERE error_key = 4 GROUP BY year""")
card("f3_1_5_failure_by_category", f"""
SELECT spend_category, {n('COUNT(*)', 'transactions')}, {_FAIL_RATE}, {_FAILED_VALUE} AS failed_value_usd
FROM bi JOIN codes USING (mcc) GROUP BY spend_category""")
_MIX = "t AS (SELECT spend_category, error_name, COUNT(*) AS c FROM bibr JOIN codes USING (mcc) GROUP BY ALL)"
card("f3_1_6_error_mix_by_category", f"""
, {_MIX}
SELECT spend_category, error_name, {n('c', 'occurrences')},
  {share('c', 1, 'PARTITION BY spend_category')} AS pct_within_category FROM t""")
card("n_8_error_mix_side_by_side", f"""
, {_MIX}, p AS (SELECT spend_category, error_name, {share('c', 1, 'PARTITION BY spend_category')} AS pct FROM t)
SELECT error_name, MAX(CASE WHEN spend_category = 'Restaurants & Bars' THEN pct END) AS pct_1,
  MAX(CASE WHEN spend_category = 'Utilities & Telecom' THEN pct END) AS pct_2
FROM p WHERE spend_category IN ('Restaurants & Bars', 'Utilities & Telecom') GROUP BY error_name""")
card("f3_1_7_stale_declines_rollup", f"""
, s AS (SELECT * FROM bibr JOIN codes USING (mcc) WHERE error_key IN (4, 5, 6))
SELECT spend_category, {n('COUNT(*)', 'stale_credential_declines')}, CAST(ROUND(SUM(abs_amount)) AS BIGINT) AS value_usd,
  {n('COUNT(DISTINCT card_id)', 'cards_affected')}, CAST(0 AS BIGINT) AS is_total FROM s GROUP BY spend_category
UNION ALL
SELECT NULL, {n('COUNT(*)', 'a')}, CAST(ROUND(SUM(abs_amount)) AS BIGINT), {n('COUNT(DISTINCT card_id)', 'b')}, 1 FROM s""")
_STALE = "SUM(CASE WHEN is_stale THEN 1 ELSE 0 END)"
# Categories that bill a stored card.
_SEGMENT = ("CASE WHEN spend_category IN ('Transport & Travel', 'Utilities & Telecom', 'Digital & Entertainment') "
            "THEN 'Card-on-file' ELSE 'Card-present' END")
card("f3_1_7b_stale_rate_by_segment", f"""
SELECT {_SEGMENT} AS segment, {n('COUNT(*)', 'transactions')}, {n(_STALE, 'stale_credential')},
  {pct(_STALE, 'COUNT(*)', 4)} AS rate_pct FROM bi JOIN codes USING (mcc) GROUP BY 1""")
card("f3_1_7c_stale_by_category", f"""
SELECT spend_category, {n('COUNT(*)', 'transactions')}, {n(_STALE, 'stale_credential')}
FROM bi JOIN codes USING (mcc) GROUP BY spend_category""")
card("n_3_stale_per_month", f"""
SELECT CAST(date_trunc('month', d) AS DATE)::VARCHAR AS month_start, {n('COUNT(*)', 'stale_credential')},
  CAST(ROUND(SUM(abs_amount)) AS BIGINT) AS value_usd FROM bi WHERE is_stale GROUP BY 1""")
card("n_2_issuer_value_per_year", f"""
, m AS (SELECT (year(MAX(d)) * 12 + month(MAX(d))) - (year(MIN(d)) * 12 + month(MIN(d))) + 1 AS months FROM bi),
v AS (SELECT SUM(abs_amount) AS value FROM bibr WHERE fault_owner = 'Issuer')
SELECT CAST(ROUND(value) AS BIGINT) AS issuer_value_usd, CAST(months AS BIGINT) AS months,
  CAST({pct(cents('value') + ' * 12', '(100 * months)', 0, 1)} AS BIGINT) AS value_per_year_usd FROM v, m""")
card("f3_2_1_label_coverage", f"""
SELECT {n('COUNT(*)', 'all_rows')}, {n(_LABELLED, 'labelled_rows')}, {pct(_LABELLED, 'COUNT(*)', 1)} AS label_coverage_pct,
  {n(_FRAUDS, 'fraud_rows')}, {_FRAUD_RATE}, {pct(_FRAUDS, 'COUNT(*)', 4)} AS wrong_denominator_pct FROM bi""")
card("f3_2_2_fraud_by_channel", f"""
SELECT channel_name, {n(_LABELLED, 'labelled')}, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE}, {_LOSS} AS fraud_loss_usd,
  {_AVG_FRAUD}, {_AVG_CLEAN} FROM bi GROUP BY channel_name""")
card("f3_2_3_fraud_by_category", f"""
SELECT spend_category, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE}, {_LOSS} AS fraud_loss_usd
FROM bi JOIN codes USING (mcc) GROUP BY spend_category HAVING {_FRAUDS} > 0""")
card("f3_2_4_fraud_by_ticket_band", f"""
SELECT (['1. Under $25','2. $25-100','3. $100-250','4. $250-500','5. $500+'])[band] AS ticket_band,
  {n(_LABELLED, 'labelled')}, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE}, {_LOSS} AS fraud_loss_usd
FROM bi GROUP BY band""")
card("f3_2_5_loss_concentration", f"""
, r AS (SELECT *, NTILE(100) OVER (ORDER BY abs_amount DESC, transaction_id) AS t FROM bi WHERE labelled)
SELECT CASE WHEN t = 1 THEN 'Top 1% by ticket size' WHEN t < 6 THEN 'Top 5%' WHEN t < 11 THEN 'Top 10%'
    ELSE 'Remaining 90%' END AS slice,
  {n('COUNT(*)', 'transactions')}, {n(_FRAUDS, 'fraud_txns')}, {_LOSS} AS fraud_loss_usd FROM r GROUP BY 1""")
card("f3_2_6_worst_hours", f"""
SELECT hour_of_day, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE} FROM bi GROUP BY hour_of_day
ORDER BY fraud_rate_pct DESC NULLS LAST, hour_of_day LIMIT 8""")
_BLOCK = "CASE WHEN hour_of_day IN (17, 18, 19) THEN 'Evening 17-19' ELSE 'All other hours' END AS block"
card("f3_2_7_evening_block", f"""
SELECT {_BLOCK}, {n(_LABELLED, 'labelled')}, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE}, {_LOSS} AS fraud_loss_usd
FROM bi GROUP BY 1""")
card("n_4_evening_shares", f"""
, t AS (SELECT {_BLOCK}, COUNT(*) AS c, CAST({_FRAUDS} AS BIGINT) AS f FROM bi GROUP BY 1)
SELECT block, {n('c', 'transactions')}, {share('c', 1)} AS pct_of_transactions, {n('f', 'fraud_txns')},
  {share('f', 1)} AS pct_of_fraud FROM t""")
card("n_5_segment_ratios", f"""
, s AS (SELECT spend_category IN ('Transport & Travel', 'Utilities & Telecom', 'Digital & Entertainment') AS top,
    CAST({_STALE} AS DOUBLE) / COUNT(*) AS r FROM bi JOIN codes USING (mcc) GROUP BY 1),
e AS (SELECT hour_of_day IN (17, 18, 19) AS top, CAST({_FRAUDS} AS DOUBLE) / CAST({_LABELLED} AS DOUBLE) AS r FROM bi GROUP BY 1),
t AS (SELECT CAST(SUM(CASE WHEN fraud THEN abs_amount END) AS DOUBLE) / {_FRAUDS} AS a,
    CAST(SUM(CASE WHEN labelled AND NOT fraud THEN abs_amount END) AS DOUBLE) / {_CLEAN} AS b FROM bi)
SELECT 'stale_on_file_vs_present' AS comparison,
  MAX(CASE WHEN top THEN r END) / NULLIF(MAX(CASE WHEN NOT top THEN r END), 0) AS times FROM s
UNION ALL SELECT 'fraud_evening_vs_rest', MAX(CASE WHEN top THEN r END) / NULLIF(MAX(CASE WHEN NOT top THEN r END), 0) FROM e
UNION ALL SELECT 'fraud_ticket_vs_clean', a / b FROM t""")
card("f3_2_8_fraud_by_card_type", f"""
SELECT card_type, {n(_LABELLED, 'labelled')}, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE}
FROM bi JOIN dim_card USING (card_id) GROUP BY card_type""")
card("f3_2_9_ticket_size_signal", f"""
SELECT {_AVG_FRAUD}, {_AVG_CLEAN},
  {pct(f'{_FRAUD_CENTS} * {_CLEAN}', f'({_CLEAN_CENTS} * {_FRAUDS})', 2, 1)} AS ratio FROM bi""")
card("f3_3_1_leakage_by_credit_band", f"""
SELECT credit_band, {n('COUNT(DISTINCT client_id)', 'clients')}, {n('COUNT(*)', 'transactions')},
  CAST(ROUND(SUM(abs_amount)) AS BIGINT) AS spend_usd, {_FAIL_RATE}, {_FRAUD_RATE}
FROM bi JOIN dim_client USING (client_id) GROUP BY credit_band""")
_SHORT = "SUM(CASE WHEN may_fail AND k % 11 = 0 THEN 1 ELSE 0 END)"
card("f3_3_2_declines_by_debt_band", f"""
SELECT dti_band, {n('COUNT(DISTINCT client_id)', 'clients')}, {_FAIL_RATE},
  {pct(_SHORT, 'COUNT(*)', 3)} AS insufficient_balance_pct
FROM bi JOIN dim_client USING (client_id) GROUP BY dti_band""")
card("f3_3_3_utilisation_by_limit_band", f"""
SELECT (['Under $5k','$5-15k','$15-30k','$30k+'])[limit_o] AS limit_band, {n('COUNT(DISTINCT card_id)', 'cards')},
  CAST(ROUND(SUM(abs_amount)) AS BIGINT) AS spend_usd,
  CAST({pct('SUM(credit_limit)', 'COUNT(*)', 0, 1)} AS BIGINT) AS avg_limit, {_FAIL_RATE}
FROM bi JOIN dim_card USING (card_id) WHERE card_type = 'Credit' GROUP BY limit_o""")
card("f3_3_4_by_brand_type_chip", f"""
SELECT card_brand, card_type, has_chip, {n('COUNT(*)', 'transactions')}, {_FAIL_RATE}, {_FRAUD_RATE}
FROM bi JOIN dim_card USING (card_id) GROUP BY card_brand, card_type, has_chip""")
_OF = "SUM(CASE WHEN channel_name = '{}' THEN 1 ELSE 0 END)"
card("f3_4_1_channel_mix_by_year", f"""
SELECT year, {pct(_OF.format('Swipe'), 'COUNT(*)', 1)} AS swipe_pct, {pct(_OF.format('Chip'), 'COUNT(*)', 1)} AS chip_pct,
  {pct(_OF.format('Online'), 'COUNT(*)', 1)} AS online_pct, {n('COUNT(*)', 'transactions')} FROM tx GROUP BY year""")
card("f3_4_2_fraud_by_era_and_channel", f"""
SELECT CASE WHEN d < DATE '2015-10-01' THEN 'Before Oct 2015' ELSE 'After Oct 2015' END AS era, channel_name,
  {n(_LABELLED, 'labelled')}, {_FRAUD_RATE}, {_LOSS} AS fraud_loss_usd FROM tx GROUP BY 1, 2""")
_ONLINE_CENTS = cents("SUM(CASE WHEN fraud AND is_online THEN abs_amount END)")
card("f3_4_3_online_share_of_loss", f"""
SELECT year, {pct(_ONLINE_CENTS, cents('SUM(CASE WHEN fraud THEN abs_amount END)'), 1)} AS online_share_of_fraud_loss_pct,
  {_LOSS} AS total_fraud_loss_usd FROM tx GROUP BY year""")
card("f3_4_4_label_regime_by_year", f"""
SELECT year, {n(_LABELLED, 'labelled')}, {n(_FRAUDS, 'fraud_txns')}, {_FRAUD_RATE},
  {n('SUM(CASE WHEN fraud AND is_online THEN 1 ELSE 0 END)', 'fraud_online')},
  {n('SUM(CASE WHEN fraud AND NOT is_online THEN 1 ELSE 0 END)', 'fraud_card_present')}, {_LOSS} AS fraud_loss_usd
FROM tx GROUP BY year""")

card("p1_stage_transactions", """
SELECT transaction_id, strftime(d, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') AS transacted_at,
  d::VARCHAR AS transaction_date, hour_of_day, client_id, card_id, CAST(amount AS DECIMAL(18,2)) AS amount,
  channel_name || ' Transaction' AS channel, merchant_id, city AS merchant_city, state AS merchant_state, zip,
  CAST(mcc AS BIGINT) AS mcc,
  CASE WHEN is_failed THEN concat_ws('|', CASE WHEN k % 11 = 0 THEN 'Insufficient Balance' END,
    CASE WHEN k % 13 = 0 THEN 'Bad PIN' END, CASE WHEN k % 17 = 0 THEN 'Technical Glitch' END,
    CASE WHEN k % 19 = 0 THEN 'Bad Expiration' END, CASE WHEN k % 23 = 0 THEN 'Bad Card Number' END,
    CASE WHEN k % 29 = 0 THEN ' Bad CVV' END, CASE WHEN k % 31 = 0 THEN 'Bad Zipcode' END) END AS error_list,
  is_failed, is_online, labelled AS has_fraud_label, CASE WHEN labelled THEN fraud END AS is_fraud FROM tx""")
card("p2_stage_clients", """
SELECT d.client_id, CAST(age AS BIGINT) AS current_age, 60 + d.client_id % 10 AS retirement_age,
  CASE WHEN d.client_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(2500 + (d.client_id * 37) % 2400 AS DOUBLE) / 100 AS latitude,
  CAST(-12400 + (d.client_id * 91) % 5700 AS DOUBLE) / 100 AS longitude,
  15000 + (d.client_id * 113) % 30000 AS per_capita_income, income AS yearly_income, debt AS total_debt,
  score AS credit_score, 1 + d.client_id % 5 AS num_credit_cards, CAST(dti_milli AS DOUBLE) / 1000 AS debt_to_income
FROM dti d""")
card("p3_stage_cards", """
SELECT card_id, client_id, card_brand, card_type,
  make_date(2018 + (c_custkey + j) % 6, 1 + c_custkey % 12, 1)::VARCHAR AS expires_on,
  make_date(2000 + (c_custkey + j) % 10, 1 + c_custkey % 12, 1)::VARCHAR AS account_opened_on,
  has_chip, CAST(1 + j % 2 AS BIGINT) AS num_cards_issued, credit_limit FROM dim_card""")
ORACLE["s5_cards_without_sensitive_columns"] = ORACLE["p3_stage_cards"]
card("p8_client_bands", """
SELECT client_id, age_band, CAST(age_o AS BIGINT) AS age_band_order, credit_band, CAST(credit_o AS BIGINT) AS credit_band_order,
  income_band, CAST(income_o AS BIGINT) AS income_band_order, dti_band, CAST(dti_o AS BIGINT) AS dti_band_order FROM dim_client""")
card("p8_card_limit_bands", """
SELECT card_id, credit_limit, (['Under $5k','$5-15k','$15-30k','$30k+'])[limit_o] AS limit_band,
  CAST(limit_o AS BIGINT) AS limit_band_order FROM dim_card""")
# Merchant category codes per spend category.
_LISTED = """
listed(spend_category, codes) AS (VALUES
  ('Groceries & Food Retail', [5411, 5499, 5300, 5921]),
  ('Restaurants & Bars', [5812, 5813, 5814]),
  ('Fuel & Automotive', [5541, 5533, 7531, 7538, 7542, 7549]),
  ('Transport & Travel', [3722, 3730, 3771, 3775, 4111, 4112, 4121, 4131, 4214, 4411, 4511, 4722, 4784, 7011]),
  ('Utilities & Telecom', [4814, 4899, 4900, 3780]),
  ('Digital & Entertainment', [5815, 5816, 7801, 7802, 7832, 7922, 7995, 7996]),
  ('Health & Personal Care', [5912, 7210, 7230, 8011, 8021, 8041, 8043, 8049, 8062, 8099]),
  ('Financial & Professional Services', [4829, 6300, 7276, 7393, 8111, 8931, 9402]),
  ('Home & Trade Supplies', [1711, 3504, 3509, 3596, 3640, 3684, 5211, 5251, 5261, 7349])),
one AS (SELECT spend_category, unnest(codes) AS mcc FROM listed),
named AS (
  SELECT p.*, COALESCE(one.spend_category, CASE WHEN p.mcc >= 3000 AND p.mcc <= 3999 THEN 'Home & Trade Supplies' END,
    'General Retail & Apparel') AS spend_category FROM p LEFT JOIN one ON one.mcc = p.mcc)"""
ORACLE["p10_spend_category"] = "WITH p AS (SELECT p_partkey * 7919 % 10000 AS mcc FROM part)," + _LISTED + """
SELECT spend_category, COUNT(*) AS n, MIN(mcc) AS lowest, MAX(mcc) AS highest FROM named GROUP BY spend_category"""
ORACLE["p10_every_code"] = """WITH dealt AS (SELECT p_partkey * 7919 % 10000 AS mcc, COUNT(*) AS parts FROM part GROUP BY 1),
p AS (SELECT range AS mcc, COALESCE(parts, 0) AS parts FROM range(10000) LEFT JOIN dealt ON mcc = range),""" + _LISTED + """
SELECT mcc, spend_category, parts FROM named"""
card("p14_channel_disagreement", """
SELECT COUNT(*) AS informational_channel_disagreement FROM tx WHERE is_online AND city <> 'ONLINE' OR NOT is_online AND city = 'ONLINE'""")
card("p20_window_fact_by_month", """
SELECT CAST(year(d) * 100 + month(d) AS BIGINT) AS month_key, COUNT(*) AS transactions,
  CAST(SUM(amount) AS DECIMAL(18,2)) AS amount FROM bi GROUP BY 1""")
card("p21_window_calendar", """
SELECT CAST(year(full_date) AS BIGINT) AS year, COUNT(*) AS days, MIN(full_date)::VARCHAR AS first_day,
  MAX(full_date)::VARCHAR AS last_day FROM bidays GROUP BY 1""")
card("k1_generated_calendar", """
, c AS (SELECT d, COUNT(*) AS c FROM tx GROUP BY d)
SELECT CAST(strftime(full_date, '%Y%m%d') AS BIGINT) AS date_key, full_date::VARCHAR AS full_date,
  CAST(day(full_date) AS BIGINT) AS day_of_month, dayname(full_date) AS day_name,
  CAST(isodow(full_date) AS BIGINT) AS day_of_week, isodow(full_date) IN (6, 7) AS is_weekend,
  CAST(month(full_date) AS BIGINT) AS month, monthname(full_date) AS month_name,
  CAST(date_trunc('month', full_date) AS DATE)::VARCHAR AS month_start, CAST(quarter(full_date) AS BIGINT) AS quarter,
  CAST(year(full_date) AS BIGINT) AS year, COALESCE(c.c, 0) AS transactions
FROM days LEFT JOIN c ON c.d = full_date""")
_PLACE = "city, COALESCE(state, '') AS state, COALESCE(zip, -1) AS zip"
card("k6_location_dimension", f"""
SELECT DISTINCT {_PLACE}, city = 'ONLINE' AS is_online,
  CASE WHEN city <> 'ONLINE' THEN CASE WHEN state IN ('Mexico', 'Italy') THEN state ELSE 'United States' END END AS country,
  CASE WHEN city <> 'ONLINE' THEN state NOT IN ('Mexico', 'Italy') END AS is_domestic FROM tx""")
card("k5_location_key_on_fact", f"""
SELECT {_PLACE}, COUNT(*) AS transactions, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount FROM tx GROUP BY 1, 2, 3""")
card("k7_fixed_dimensions_in_use", """
SELECT channel_name, channel_name <> 'Online' AS is_card_present,
  (['Under $25','$25-100','$100-250','$250-500','$500+'])[band] AS ticket_band,
  CAST(([0, 25, 100, 250, 500])[band] AS DECIMAL(18,2)) AS lower_bound,
  CAST(([25, 100, 250, 500, NULL])[band] AS DECIMAL(18,2)) AS upper_bound, error_name, fault_owner, COUNT(*) AS declines
FROM br GROUP BY channel_name, band, error_name, fault_owner""")
card("k11_fact", """
SELECT transaction_id, date_key, hour_of_day, client_id, card_id, merchant_id, CAST(mcc AS BIGINT) AS mcc,
  CAST(CASE channel_name WHEN 'Chip' THEN 1 WHEN 'Swipe' THEN 2 ELSE 3 END AS BIGINT) AS channel_key,
  CAST(band AS BIGINT) AS ticket_band_key, CAST(amount AS DECIMAL(18,2)) AS amount,
  CAST(abs_amount AS DECIMAL(18,2)) AS abs_amount, amount < 0 AS is_refund, amount = 0 AS is_zero_auth, is_failed, is_online,
  labelled AS has_fraud_label, fraud AS is_fraud FROM tx""")
card("k12_error_bridge", "SELECT transaction_id, CAST(error_key AS BIGINT) AS error_key FROM br")
card("k15_window_bridge_by_error", """
SELECT error_name, fault_owner, COUNT(*) AS declines, COUNT(DISTINCT transaction_id) AS transactions FROM bibr GROUP BY 1, 2""")
ORACLE["j5_ticket_band_by_range"] = """
WITH bands(ticket_band_key, lo, hi) AS (VALUES (1, 0, 25), (2, 25, 100), (3, 100, 250), (4, 250, 500), (5, 500, NULL)),
v AS (SELECT CAST(value * 2 AS DECIMAL(12,2)) AS v FROM events)
SELECT CAST(ticket_band_key AS BIGINT) AS ticket_band_key, COUNT(*) AS n, CAST(MIN(v) AS DECIMAL(18,2)) AS lowest,
  CAST(MAX(v) AS DECIMAL(18,2)) AS highest
FROM v LEFT JOIN bands ON v >= lo AND (hi IS NULL OR v < hi) GROUP BY 1"""
ORACLE["j5_order_bands_from_a_table"] = """
WITH b AS (SELECT n_nationkey + 1 AS band, n_nationkey * 20000 + 1500 AS lo, CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1) * 20000 + 1500 END AS hi
  FROM nation),
o AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
SELECT CAST(band AS BIGINT) AS band, COUNT(*) AS n, CAST(MIN(price) AS DECIMAL(18,2)) AS lowest, CAST(MAX(price) AS DECIMAL(18,2)) AS highest
FROM o LEFT JOIN b ON price >= lo AND (hi IS NULL OR price < hi) GROUP BY 1"""
ORACLE["j5_promotions_that_overlap"] = """
WITH r AS (SELECT s_suppkey AS promotion, s_suppkey * 7919 % 90000 AS lo,
  CASE WHEN s_suppkey % 20 <> 7 THEN s_suppkey * 7919 % 90000 + 400 + s_suppkey % 300 END AS hi FROM supplier),
l AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
SELECT CAST(promotion AS BIGINT) AS promotion, COUNT(*) AS n, CAST(SUM(price) AS DECIMAL(18,2)) AS price
FROM l JOIN r ON price >= lo AND (hi IS NULL OR price < hi) GROUP BY promotion"""
ORACLE["j5_promotions_by_cells"] = ORACLE["j5_promotions_that_overlap"]
card("j7_value_per_error_and_per_transaction", """
SELECT (SELECT COUNT(*) FROM bibr) AS declines, (SELECT CAST(SUM(abs_amount) AS DECIMAL(18,2)) FROM bibr) AS value_per_error,
  (SELECT COUNT(*) FROM bi WHERE is_failed) AS transactions,
  (SELECT CAST(SUM(abs_amount) AS DECIMAL(18,2)) FROM bi WHERE is_failed) AS value_per_transaction""")
ORACLE["j9_semi_join_as_flag"] = """
SELECT o_orderpriority, COUNT(*) AS orders, COUNT(*) FILTER (WHERE EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS with_return
FROM orders GROUP BY o_orderpriority"""
ORACLE["j11_customers_without_orders"] = """
SELECT c_mktsegment, COUNT(*) AS idle FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < DATE '1996-01-01') GROUP BY c_mktsegment"""


def _km(a: str, b: str) -> str:
    return (
        f"2 * 6371 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) "
        f"* cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


ORACLE["j13_nearest_supplier"] = f"""
WITH p AS (SELECT c_custkey, (2500 + (c_custkey * 37) % 2400) / 1e2 AS lat, (-12400 + (c_custkey * 91) % 5700) / 1e2 AS lon FROM customer),
t AS (SELECT s_suppkey, (2500 + (s_suppkey * 53) % 2400) / 1e2 AS lat, (-12400 + (s_suppkey * 71) % 5700) / 1e2 AS lon FROM supplier),
pairs AS (SELECT c_custkey, s_suppkey, round({_km('p', 't')}, 6) AS km FROM p CROSS JOIN t),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS place FROM pairs)
SELECT c_custkey, s_suppkey, round(km, 1) AS distance_km FROM best WHERE place = 1"""

# The card tables with the faults that the gate queries plant.
_FAULTY = """
, ft AS (
  SELECT transaction_id AS n,
    CASE WHEN transaction_id % 89 = 11 THEN DATE '2020-01-05' WHEN transaction_id % 101 <> 7 THEN d END AS fd,
    CASE WHEN transaction_id % 103 <> 5 THEN amount END AS fa,
    CASE WHEN transaction_id % 107 = 3 THEN 1234 WHEN transaction_id % 109 <> 4 THEN mcc END AS fm,
    CASE WHEN transaction_id % 113 = 6 THEN -1 ELSE card_id END AS fcard,
    CASE WHEN transaction_id % 127 = 9 THEN -1 ELSE client_id END AS fclient,
    transaction_id % 131 = 8 AS no_channel, transaction_id % 137 = 2 AS no_city,
    transaction_id % 139 = 12 AS blank, transaction_id % 139 <> 12 AND transaction_id % 149 = 13 AS strange
  FROM tx)"""
_STAGING_GATE = _FAULTY + """
SELECT COUNT(*) FILTER (fd IS NULL) AS null_dates, COUNT(*) FILTER (fa IS NULL) AS null_amounts,
  COUNT(*) FILTER (fm IS NULL) AS null_mcc, 0::BIGINT AS failed_without_error,
  COUNT(*) FILTER (fcard NOT IN (SELECT card_id FROM dim_card)) AS orphan_cards,
  COUNT(*) FILTER (fclient NOT IN (SELECT client_id FROM dim_client)) AS orphan_clients,
  COUNT(*) FILTER (fm IS NULL OR fm NOT IN (SELECT mcc FROM codes)) AS unknown_mcc FROM ft"""
card("q1_card_staging_gate", _STAGING_GATE)
card("q1_card_staging_gate_from_the_write", _STAGING_GATE)
_RECONCILIATION = _FAULTY + """
, kept AS (SELECT *, fa + CASE WHEN n % 163 = 4 THEN 1 ELSE 0 END AS drifted FROM ft WHERE n % 157 <> 3),
fdays AS (SELECT full_date FROM days WHERE full_date >= DATE '2017-01-01' AND full_date <= (SELECT MAX(fd) FROM kept))
SELECT (SELECT COUNT(*) FROM ft) - (SELECT COUNT(*) FROM kept) AS rows_lost,
  CAST(trunc((SELECT SUM(fa) FROM ft) - (SELECT SUM(drifted) FROM kept)) AS BIGINT) AS amount_drift,
  (SELECT COUNT(*) FROM codes WHERE mcc % 5 = 0) AS uncategorised_mcc,
  (SELECT COUNT(*) FROM kept WHERE no_channel) AS unmatched_channel,
  (SELECT COUNT(*) FROM kept WHERE no_city) AS unmatched_location,
  (SELECT COUNT(*) FROM kept WHERE fa IS NULL) AS unbanded_ticket,
  (SELECT COUNT(*) FROM kept WHERE fd IS NULL OR fd NOT IN (SELECT full_date FROM days)) AS unmatched_date,
  (SELECT COUNT(*) FROM ft WHERE strange) AS unknown_errors,
  (SELECT COUNT(*) FROM ft WHERE no_city) AS wrong_location,
  (SELECT COUNT(*) FROM fdays WHERE NOT EXISTS (SELECT 1 FROM kept WHERE fd = full_date)) AS empty_bi_days"""
card("q5_card_reconciliation", _RECONCILIATION)
card("q5_card_reconciliation_from_the_write", _RECONCILIATION)
card("q6_card_sizes", f"""
SELECT (SELECT COUNT(*) FROM bi) AS bi_window_rows, (SELECT COUNT(*) FROM br) AS bridge_rows,
  (SELECT COUNT(*) FROM tx WHERE fraud) AS fraud_rows, (SELECT COUNT(*) FROM tx WHERE amount = 0) AS zero_auth_rows,
  (SELECT COUNT(*) FROM (SELECT DISTINCT {_PLACE} FROM tx)) AS locations""")
ORACLE["q6_card_sizes_from_the_write"] = ORACLE["q6_card_sizes"]
card("q12_card_keys", f"""
SELECT 'fact_transaction' AS table_name, 0::BIGINT AS duplicate_keys, COUNT(*) FILTER (transaction_id IS NULL) AS null_keys FROM tx
UNION ALL SELECT 'br_transaction_error', COUNT(*), 0 FROM br
  WHERE transaction_id % 167 = 5 AND transaction_id % 139 <> 12 AND transaction_id % 149 <> 13
UNION ALL SELECT 'dim_client', COUNT(*), 0 FROM dim_client WHERE client_id % 151 = 1
UNION ALL SELECT 'dim_card', COUNT(*), 0 FROM dim_card WHERE card_id % 151 = 1
UNION ALL SELECT 'dim_location', COUNT(*), 0 FROM (SELECT DISTINCT {_PLACE} FROM tx WHERE transaction_id % 137 <> 2) WHERE zip % 7 = 1
UNION ALL SELECT 'dim_mcc', COUNT(*) - COUNT(DISTINCT mcc), 0 FROM codes
UNION ALL SELECT 'dim_mcc, codes beyond four digits', COUNT(*) FILTER (mcc > 9999), 0 FROM codes""")

card("q12_ids_where_they_lie", """
SELECT 'transactions' AS table_name, COUNT(*) FILTER (transaction_id % 173 = 6 OR (labelled AND transaction_id % 179 = 6)) AS duplicate_keys, 0::BIGINT AS null_keys FROM tx
UNION ALL SELECT 'fraud_labels', COUNT(*) FILTER (o_orderkey % 179 = 6), 0 FROM orders WHERE o_orderstatus <> 'P'""")
ORACLE["j1_co_located_labels"] = ORACLE["p1_stage_transactions"]
ORACLE["p21_window_calendar_from_the_manifest"] = ORACLE["p21_window_calendar"]
card("p20_month_of_a_clustered_fact", """
SELECT date_key, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount FROM tx
WHERE date_key BETWEEN 20180301 AND 20180531 GROUP BY date_key""")

_D = "CAST({} AS DOUBLE)"
_MEASURE = {
    "transactions": "COUNT(*)",
    "total_spend": "CAST(SUM(amount) AS DECIMAL(18,2))",
    "gross_spend": "CAST(SUM(abs_amount) AS DECIMAL(18,2))",
    "refund_value": "CAST(SUM(CASE WHEN amount < 0 THEN abs_amount END) AS DECIMAL(18,2))",
    "avg_ticket": f"{_D.format('SUM(abs_amount)')} / COUNT(*)",
    "failed_transactions": f"CAST({_FAILED} AS BIGINT)",
    "failure_rate": f"{_D.format(_FAILED)} / COUNT(*)",
    "approval_rate": f"1.0::DOUBLE - {_D.format(_FAILED)} / COUNT(*)",
    "failed_value": "CAST(SUM(CASE WHEN is_failed THEN abs_amount END) AS DECIMAL(18,2))",
    "issuer_owned_failed_value":
        "CAST(SUM(CASE WHEN may_fail AND (k % 17 = 0 OR k % 19 = 0) THEN abs_amount END) AS DECIMAL(18,2))",
    "labelled_transactions": f"CAST({_LABELLED} AS BIGINT)",
    "label_coverage": f"{_D.format(_LABELLED)} / COUNT(*)",
    "fraud_transactions": f"CAST({_FRAUDS} AS BIGINT)",
    "fraud_rate": f"{_D.format(_FRAUDS)} / NULLIF({_D.format(_LABELLED)}, 0)",
    "fraud_loss": "CAST(SUM(CASE WHEN fraud THEN abs_amount END) AS DECIMAL(18,2))",
    "avg_fraud_ticket": f"{_D.format('SUM(CASE WHEN fraud THEN abs_amount END)')} / NULLIF({_D.format(_FRAUDS)}, 0)",
    "fraud_loss_bps": f"{_D.format('SUM(CASE WHEN fraud THEN abs_amount END)')} / NULLIF({_D.format('SUM(abs_amount)')}, 0) * 10000",
    "stale_credential_transactions": f"CAST({_STALE} AS BIGINT)",
    "stale_credential_value": "CAST(SUM(CASE WHEN is_stale THEN abs_amount END) AS DECIMAL(18,2))",
    "stale_credential_rate": f"{_D.format(_STALE)} / COUNT(*)",
    "cards_with_stale_credential": "COUNT(DISTINCT CASE WHEN is_stale THEN card_id END)",
}


def _measured(names: str, by: str, source: str) -> str:
    listed = ", ".join(f"{_MEASURE[m]} AS {m}" for m in names.split())
    if not by:
        return f"SELECT {listed} FROM {source}"
    return f"SELECT {by}, {listed} FROM {source} GROUP BY {by}"


_CORE = (
    "transactions total_spend gross_spend refund_value avg_ticket failed_transactions failure_rate approval_rate "
    "failed_value issuer_owned_failed_value labelled_transactions label_coverage fraud_transactions fraud_rate "
    "fraud_loss avg_fraud_ticket fraud_loss_bps"
)
_STALES = "stale_credential_transactions stale_credential_value stale_credential_rate cards_with_stale_credential"
card("m1_m17_core_by_year", _measured(_CORE, "year", "bi"))
card("m1_m17_core_by_category_and_channel", _measured(
    "transactions gross_spend failure_rate fraud_rate issuer_owned_failed_value",
    "spend_category, channel_name", "bi JOIN codes USING (mcc)"))
card("m10_issuer_value_by_card_type", _measured(
    "failed_value issuer_owned_failed_value", "card_type", "bi JOIN dim_card USING (card_id)"))
card("m28_m31_stale_by_credit_band", _measured(_STALES, "credit_band", "bi JOIN dim_client USING (client_id)"))
card("m28_m31_stale_overall", _measured(_STALES, "", "bi"))
card("m28_stale_cards_from_stored_sets", """
, s AS (SELECT bi.card_id, bi.year, cl.credit_band, ca.card_type FROM bi JOIN dim_client cl ON cl.client_id = bi.client_id
  JOIN dim_card ca ON ca.card_id = bi.card_id WHERE is_stale)
SELECT 'credit_band' AS grouped_by, credit_band AS label, COUNT(DISTINCT card_id) AS cards FROM s GROUP BY credit_band
UNION ALL SELECT 'card_type / year', card_type || ' / ' || year, COUNT(DISTINCT card_id) FROM s GROUP BY card_type, year
UNION ALL SELECT '', 'all', COUNT(DISTINCT card_id) FROM s""")
card("m18_spend_per_day_by_month", """
, s AS (SELECT year(d) AS y, month(d) AS m, SUM(amount) AS v FROM bi GROUP BY 1, 2),
c AS (SELECT year(full_date) AS y, month(full_date) AS m, COUNT(*) AS c FROM bidays GROUP BY 1, 2)
SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, CAST(v AS DECIMAL(18,2)) AS total_spend,
  CAST(v AS DOUBLE) / c AS spend_per_day FROM s JOIN c USING (y, m)""")
card("m18_spend_per_day_overall", """
SELECT CAST(SUM(amount) AS DECIMAL(18,2)) AS total_spend,
  CAST(SUM(amount) AS DOUBLE) / (SELECT COUNT(*) FROM bidays) AS spend_per_day FROM bi""")
card("m_filtered_domestic_by_state", """
SELECT COALESCE(state, '') AS state, CASE WHEN city <> 'ONLINE' THEN state NOT IN ('Mexico', 'Italy') END AS is_domestic,
  COUNT(*) AS transactions, CAST(SUM(CASE WHEN amount < 0 THEN abs_amount END) AS DECIMAL(18,2)) AS refund_value,
  CAST(SUM(abs_amount) AS DOUBLE) / COUNT(*) AS avg_ticket FROM bi WHERE amount <> 0 GROUP BY 1, 2""")
_DAILY = """
, per AS (SELECT d, SUM(amount) AS v, COUNT(*) AS c, SUM(CASE WHEN is_failed THEN 1 ELSE 0 END) AS f FROM bi GROUP BY d),
cal AS (SELECT full_date, COALESCE(v, 0) AS v, COALESCE(c, 0) AS c, COALESCE(f, 0) AS f
  FROM bidays LEFT JOIN per ON per.d = full_date)"""


def _money_over(window: str, name: str) -> str:
    return f"CAST(SUM(v) OVER ({window}) AS DECIMAL(18,2)) AS {name}"


_TO_DATE = ", ".join([
    _money_over("PARTITION BY year(full_date), month(full_date) ORDER BY full_date", "{0}mtd"),
    _money_over("PARTITION BY year(full_date) ORDER BY full_date", "{0}ytd"),
    _money_over("ORDER BY full_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW", "{0}rolling_30d"),
    "CAST(SUM(v) OVER (ORDER BY full_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS DOUBLE) / 30 AS {0}rolling_30d_avg",
])
card("m19_m27_daily_spend", _DAILY + f"""
SELECT full_date::VARCHAR AS full_date, CAST(v AS DECIMAL(18,2)) AS total_spend, {_TO_DATE.format('spend_')},
  {_money_over('ORDER BY full_date', 'spend_running_total')} FROM cal""")
for _grain in ("year", "month", "day"):
    card(f"m21_m24_prior_year_by_{_grain}", _DAILY + f"""
, p AS (SELECT CAST(date_trunc('{_grain}', full_date) AS DATE) AS s, SUM(v) AS v,
    CAST(SUM(f) AS DOUBLE) / NULLIF(CAST(SUM(c) AS DOUBLE), 0) AS r FROM cal GROUP BY 1)
SELECT a.s::VARCHAR AS period_start, CAST(a.v AS DECIMAL(18,2)) AS total_spend, CAST(b.v AS DECIMAL(18,2)) AS spend_py,
  CAST(a.v - b.v AS DOUBLE) / NULLIF(CAST(b.v AS DOUBLE), 0) AS spend_yoy, a.r AS failure_rate, b.r AS failure_rate_py,
  (a.r - b.r) * 100 AS failure_rate_yoy_pp
FROM p a LEFT JOIN p b ON b.s = CAST(a.s - INTERVAL 1 YEAR AS DATE)""")

_GROUP_DAYS = """
, per AS (SELECT {0} AS g, d, SUM(amount) AS v, COUNT(*) AS c, SUM(CASE WHEN is_failed THEN 1 ELSE 0 END) AS f FROM {1} GROUP BY 1, 2),
cal AS (SELECT gs.g, full_date, COALESCE(v, 0) AS v, COALESCE(c, 0) AS c, COALESCE(f, 0) AS f
  FROM (SELECT DISTINCT g FROM per) AS gs CROSS JOIN bidays LEFT JOIN per ON per.d = full_date AND per.g = gs.g)"""
card("m19_m27_by_channel_and_month", _GROUP_DAYS.format("channel_name", "bi") + """
, run AS (SELECT *, date_trunc('month', full_date)::DATE AS m,
    SUM(v) OVER (PARTITION BY g, year(full_date), month(full_date) ORDER BY full_date) AS mtd,
    SUM(v) OVER (PARTITION BY g, year(full_date) ORDER BY full_date) AS ytd,
    SUM(v) OVER (PARTITION BY g ORDER BY full_date) AS run,
    SUM(v) OVER (PARTITION BY g ORDER BY full_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS roll FROM cal),
p AS (SELECT g, m, SUM(v) AS v, CAST(SUM(f) AS DOUBLE) / NULLIF(CAST(SUM(c) AS DOUBLE), 0) AS r, arg_max(mtd, full_date) AS mtd,
    arg_max(ytd, full_date) AS ytd, arg_max(run, full_date) AS run, arg_max(roll, full_date) AS roll FROM run GROUP BY g, m)
SELECT a.g AS channel_name, a.m::VARCHAR AS month_start, CASE WHEN EXISTS (SELECT 1 FROM bi WHERE channel_name = a.g AND date_trunc('month', d)::DATE = a.m) THEN CAST(a.v AS DECIMAL(18,2)) END AS total_spend,
  CAST(a.mtd AS DECIMAL(18,2)) AS spend_mtd, CAST(a.ytd AS DECIMAL(18,2)) AS spend_ytd,
  CAST(a.run AS DECIMAL(18,2)) AS spend_running_total, CAST(a.roll AS DECIMAL(18,2)) AS spend_rolling_30d,
  CAST(a.roll AS DOUBLE) / 30 AS spend_rolling_30d_avg, CAST(b.v AS DECIMAL(18,2)) AS spend_py,
  CAST(a.v - b.v AS DOUBLE) / NULLIF(CAST(b.v AS DOUBLE), 0) AS spend_yoy, b.r AS failure_rate_py,
  (a.r - b.r) * 100 AS failure_rate_yoy_pp
FROM p a LEFT JOIN p b ON b.g = a.g AND b.m = CAST(a.m - INTERVAL 1 YEAR AS DATE)""")
card("m21_m24_by_category_and_year", _GROUP_DAYS.format("spend_category", "bi JOIN codes USING (mcc)") + """
, p AS (SELECT g, year(full_date) AS y, SUM(v) AS v, CAST(SUM(f) AS DOUBLE) / NULLIF(CAST(SUM(c) AS DOUBLE), 0) AS r FROM cal GROUP BY 1, 2)
SELECT a.g AS spend_category, a.y AS year, CAST(b.v AS DECIMAL(18,2)) AS spend_py,
  CAST(a.v - b.v AS DOUBLE) / NULLIF(CAST(b.v AS DOUBLE), 0) AS spend_yoy, b.r AS failure_rate_py,
  (a.r - b.r) * 100 AS failure_rate_yoy_pp
FROM p a LEFT JOIN p b ON b.g = a.g AND b.y = a.y - 1""")
card("m_filtered_by_card_type_and_category", """
SELECT CAST(year AS BIGINT) AS year, COUNT(*) AS transactions, CAST(SUM(amount) AS DECIMAL(18,2)) AS total_spend,
  CAST(SUM(CASE WHEN is_failed THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS failure_rate
FROM bi JOIN codes USING (mcc) JOIN dim_card USING (card_id)
WHERE card_type = 'Credit' AND spend_category IN ('Restaurants & Bars', 'Fuel & Automotive') GROUP BY 1""")

# -- bill payments ------------------------------------------------------------

_BILLS = """
WITH b AS (
  SELECT o_orderkey AS o, o_custkey AS c, CAST(o_orderdate AS DATE) AS d,
    (['Listrik','Air','Internet','Asuransi','Telepon'])[1 + o_custkey % 5] AS kind,
    (['ATM','EDC','Teller','Mobile Banking','Internet Banking'])[CAST(o_orderpriority[1] AS INTEGER)] AS channel,
    CASE WHEN o_orderstatus <> 'P' THEN 'Sukses' WHEN o_orderkey % 2 = 0 THEN 'Gagal' ELSE 'Pending' END AS status,
    CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS nominal,
    CASE WHEN o_orderkey % 103 = 0 THEN 0 ELSE 1000 + (o_orderkey % 5) * 500 END AS fee,
    CASE WHEN o_orderkey % 997 = 5 THEN 1 ELSE 0 END AS off
  FROM orders),
r AS (SELECT *, kind || ' ' || (c % 3) AS biller, nominal + fee + off AS total,
    CASE WHEN status = 'Sukses' THEN 1 ELSE 0 END AS ok FROM b),
rep AS (SELECT *, ok * total AS gmv, ok * fee AS net FROM r)
"""


def bill(name: str, sql: str) -> None:
    ORACLE[name] = _BILLS + sql


_OK_RATE = pct("SUM(ok)", "COUNT(*)", 2) + " AS success_rate_pct"
bill("b2_q1_volume_per_month", f"""
SELECT CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, monthname(d) AS month_name,
  COUNT(*) AS total_transactions, COUNT(DISTINCT d) AS days_with_data,
  CAST({pct('COUNT(*)', 'COUNT(DISTINCT d)', 0, 1)} AS BIGINT) AS avg_txn_per_day,
  CASE WHEN COUNT(DISTINCT d) < 28 THEN 'PARTIAL MONTH' END AS data_note FROM rep GROUP BY 1, 2, 3""")
_Q2 = f"""
SELECT CAST(year(d) AS BIGINT) AS year, monthname(d) AS month_name, {{}}CAST(SUM(gmv) AS BIGINT) AS gmv,
  CAST(SUM(net) AS BIGINT) AS net_revenue, {pct('SUM(net)', 'SUM(gmv)', 2)} AS take_rate_pct
FROM rep GROUP BY year(d), month(d), monthname(d)"""
bill("b2_q2_revenue_per_month", _Q2.format("CAST(SUM(ok) AS BIGINT) AS settled_transactions, "))
bill("s15_csv_export", _Q2.format(""))
bill("b2_q3_top_billers", f"""
SELECT biller AS nama_biller, kind AS jenis_biller, COUNT(*) AS total_transactions, CAST(SUM(net) AS BIGINT) AS net_revenue,
  {_OK_RATE} FROM rep GROUP BY 1, 2 ORDER BY total_transactions DESC, nama_biller, jenis_biller LIMIT 5""")
bill("b2_q4_channel_breakdown", f"""
, t AS (SELECT channel, COUNT(*) AS c, SUM(net) AS v, {_OK_RATE} FROM rep GROUP BY channel)
SELECT channel AS channel_name, c AS total_transactions, {share('c', 2)} AS share_of_volume_pct, CAST(v AS BIGINT) AS net_revenue,
  {share('v', 2)} AS share_of_revenue_pct, success_rate_pct FROM t""")
bill("b2_q5_status_split", f"""
, t AS (SELECT status, COUNT(*) AS c, SUM(fee) AS f, SUM((1 - ok) * fee) AS g FROM rep GROUP BY status)
SELECT status, c AS transactions, {share('c', 2)} AS share_pct, CAST(f AS BIGINT) AS fees_at_stake,
  CAST(g AS BIGINT) AS fees_forgone FROM t""")
bill("b2_q6_success_by_dimension", f"""
SELECT 'channel' AS dimension, channel AS segment, COUNT(*) AS transactions, {_OK_RATE} FROM rep GROUP BY channel
UNION ALL SELECT 'biller', biller, COUNT(*), {_OK_RATE} FROM rep GROUP BY biller
UNION ALL SELECT 'weekday', dayname(d), COUNT(*), {_OK_RATE} FROM rep GROUP BY dayname(d)""")
bill("b2_q7_daily_trend", """
SELECT d::VARCHAR AS full_date, COUNT(*) AS total_transactions, CAST(SUM(ok) AS BIGINT) AS settled_transactions,
  CAST(SUM(net) AS BIGINT) AS net_revenue FROM rep WHERE d < DATE '2001-08-01' GROUP BY d""")
_STAGED = """
SELECT 'TX' || o AS id_transaksi, d::VARCHAR AS transaction_date_clean, CAST(month(d) AS BIGINT) AS transaction_month,
  CAST(year(d) AS BIGINT) AS transaction_year, c AS no_rekening, {}kind AS jenis_biller, biller AS nama_biller,
  c * 7 + 100000 AS nomor_pelanggan, nominal, fee AS biaya_admin, total AS total_bayar, channel, status,
  CAST(ok AS BIGINT) AS is_success FROM r"""
bill("p4_stage_bills", _STAGED.format("'Nasabah ' || c AS nama_nasabah, "))
bill("s2_semicolon_csv_bills", _STAGED.format(""))
bill("k2_harvested_calendar", """
SELECT DISTINCT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d::VARCHAR AS full_date, CAST(day(d) AS BIGINT) AS day_of_month,
  dayname(d) AS day_name, CAST(dayofweek(d) AS BIGINT) AS day_of_week, CAST(month(d) AS BIGINT) AS month,
  monthname(d) AS month_name, CAST(quarter(d) AS BIGINT) AS quarter, CAST(year(d) AS BIGINT) AS year FROM r""")
bill("k4_channel_keys", """
SELECT ROW_NUMBER() OVER (ORDER BY channel) AS channel_key, channel AS channel_name FROM (SELECT DISTINCT channel FROM r)""")
bill("k4_biller_keys", """
SELECT ROW_NUMBER() OVER (ORDER BY kind, biller) AS biller_key, kind AS jenis_biller, biller AS nama_biller
FROM (SELECT DISTINCT kind, biller FROM r)""")
ORACLE["k4_dense_keys_over_customers"] = """
SELECT ROW_NUMBER() OVER (ORDER BY c_mktsegment, c_name) AS member_key, c_mktsegment, c_name FROM customer"""
_KEYED = """
, ch AS (SELECT channel, ROW_NUMBER() OVER (ORDER BY channel) AS channel_key FROM (SELECT DISTINCT channel FROM r)),
bl AS (SELECT biller, ROW_NUMBER() OVER (ORDER BY kind, biller) AS biller_key FROM (SELECT DISTINCT kind, biller FROM r))"""
bill("k13_bill_fact", _KEYED + """
SELECT 'TX' || o AS transaction_id, CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, channel_key, biller_key,
  c AS no_rekening, c * 7 + 100000 AS nomor_pelanggan, nominal, fee AS biaya_admin, total AS total_bayar, status,
  CAST(ok AS BIGINT) AS is_success FROM r JOIN ch USING (channel) JOIN bl USING (biller)""")
bill("k14_report_view", """
SELECT 'TX' || o AS transaction_id, d::VARCHAR AS full_date, dayname(d) AS day_name, CAST(month(d) AS BIGINT) AS month,
  monthname(d) AS month_name, CAST(quarter(d) AS BIGINT) AS quarter, CAST(year(d) AS BIGINT) AS year, channel AS channel_name,
  kind AS jenis_biller, biller AS nama_biller, nominal, fee AS biaya_admin, total AS total_bayar, status,
  CAST(ok AS BIGINT) AS is_success, gmv AS gmv_settled, net AS net_revenue FROM rep""")
# Bills without a biller sort first, as do those without a channel: the dropped second key is the first name.
bill("k10_bill_references", """
, f AS (SELECT CASE WHEN o % 13 <> 5 THEN biller END AS biller, CASE WHEN o % 17 <> 6 THEN channel END AS channel, kind FROM r),
used AS (SELECT biller, ROW_NUMBER() OVER (ORDER BY kind, biller NULLS FIRST) AS k FROM (SELECT DISTINCT kind, biller FROM f)),
uch AS (SELECT channel, ROW_NUMBER() OVER (ORDER BY channel NULLS FIRST) AS k FROM (SELECT DISTINCT channel FROM f))
SELECT 'date_key' AS key, 0::BIGINT AS facts_without_key, 0::BIGINT AS missing
UNION ALL SELECT 'channel_key', (SELECT COUNT(*) FROM f WHERE channel IS NULL), (SELECT COUNT(*) FROM uch WHERE k = 2 AND channel IS NOT NULL)
UNION ALL SELECT 'biller_key', (SELECT COUNT(*) FROM f WHERE biller IS NULL), (SELECT COUNT(*) FROM used WHERE k = 2 AND biller IS NOT NULL)""")
bill("q3_bill_staging_gate", """
SELECT COUNT(*) FILTER (d IS NULL) AS null_dates, COUNT(*) FILTER (COALESCE(channel, '') = '') AS null_channels,
  COUNT(*) FILTER (COALESCE(status, '') = '') AS null_status, COUNT(*) FILTER (off = 1) AS amount_mismatch FROM r""")
ORACLE["q4_bill_load_check"] = """
SELECT COUNT(*) AS raw_rows, COUNT(*) AS staged_rows, COUNT(*) AS fact_rows,
  COUNT(*) FILTER (o_orderkey % 13 <> 5 AND o_orderkey % 17 <> 6) AS report_rows FROM orders"""

# -- hospitals ----------------------------------------------------------------

_HOSPITALS = f"""
WITH st AS (SELECT ['AK','AL','AR','AZ','CA','CO','CT','DC','DE','FL','GA','HI','IA','ID','IL','IN','KS','KY','LA','MA',
  'MD','ME','MI','PR','GU'] AS codes),
raw AS (
  SELECT 'H' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, 'Hospital ' || (c_custkey % 700) AS name,
    (c_custkey % 350) || ' Main St' AS address, CASE WHEN c_custkey % 90 <> 7 THEN 'Town ' || (c_custkey % 70) END AS city,
    codes[1 + c_nationkey] AS state, (['GENERAL ACUTE CARE','CRITICAL ACCESS','PSYCHIATRIC'])[1 + c_custkey % 3] AS type,
    CASE WHEN c_custkey % 29 = 4 THEN 'CLOSED' ELSE 'OPEN' END AS status,
    (2500 + (c_custkey * 37) % 2400) / 1e2 AS lat, (-12400 + (c_custkey * 91) % 5700) / 1e2 AS lon,
    CASE WHEN c_custkey % 11 <> 0 THEN 10 + c_custkey % 400 END AS beds,
    CASE WHEN c_custkey % 4 = 0 THEN 'LEVEL IV' WHEN c_custkey % 203 = 9 THEN 'SOMETHING NEW' ELSE 'NOT AVAILABLE' END AS trauma,
    CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS pad,
    (['GOVERNMENT - LOCAL','NON-PROFIT',NULL,'GOVERNMENT - FEDERAL'])[1 + c_custkey % 4] AS owner,
    (['GOVERNMENT','NON-PROFIT',NULL,'GOVERNMENT'])[1 + c_custkey % 4] AS owner_group, c_custkey AS n
  FROM customer, st
  UNION ALL
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'Centre ' || s_suppkey, s_suppkey || ' High St',
    'Town ' || (s_suppkey % 70), codes[1 + s_nationkey], 'GENERAL ACUTE CARE', 'OPEN',
    (2500 + (s_suppkey * 53) % 2400) / 1e2, (-12400 + (s_suppkey * 71) % 5700) / 1e2, 100 + s_suppkey % 900,
    (['LEVEL I','LEVEL II','LEVEL I ADULT, LEVEL II PEDIATRIC','RTC','LEVEL III','PEDIATRIC'])[1 + s_suppkey % 6],
    TRUE, 'NON-PROFIT', 'NON-PROFIT', s_suppkey
  FROM supplier, st),
lv(trauma, category, adult, child, has_child) AS (VALUES
  ('NOT AVAILABLE', 'NOT REPORTED', NULL, NULL, FALSE), ('LEVEL I', 'ADULT', 1, NULL, FALSE),
  ('LEVEL II', 'ADULT', 2, NULL, FALSE), ('LEVEL III', 'ADULT', 3, NULL, FALSE), ('LEVEL IV', 'ADULT', 4, NULL, FALSE),
  ('LEVEL I ADULT, LEVEL II PEDIATRIC', 'ADULT', 1, 2, TRUE), ('RTC', 'STATE DESIGNATION', 2, NULL, FALSE),
  ('PEDIATRIC', 'PEDIATRIC ONLY', NULL, NULL, TRUE)),
hos AS (
  SELECT raw.*, category, adult, child, has_child, COUNT(*) OVER (PARTITION BY name, address, city) AS units,
    state NOT IN ('PR', 'GU') AS in_us
  FROM raw LEFT JOIN lv USING (trauma)),
base AS (SELECT * FROM hos WHERE status = 'OPEN' AND in_us),
ctr AS (SELECT * FROM base WHERE adult <= 2),
pairs AS (SELECT b.id, c.id AS cid, c.name AS cname, c.state AS cstate, round({_km('b', 'c')}, 6) AS km FROM base b CROSS JOIN ctr c),
near AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY km, cid) AS place FROM pairs) WHERE place = 1),
acc AS (SELECT base.*, cid, cname, cstate, km, CAST(floor(km * 10 + 0.5) AS BIGINT) AS tenths FROM base JOIN near USING (id))
"""


def hospital(name: str, sql: str) -> None:
    ORACLE[name] = _HOSPITALS + sql


hospital("p5_stage_hospitals", """
SELECT id AS hospital_id, name AS hospital_name, CASE WHEN n % 2 = 1 THEN 'Alt ' || n END AS alt_name, type AS hospital_type, status,
  owner AS owner_type, owner_group, address, city, state, lpad(CAST(n % 99999 AS VARCHAR), 5, '0') AS zip,
  'County ' || (n % 30) AS county, CAST(n % 30 AS VARCHAR) AS county_fips, CAST(n % 56 AS VARCHAR) AS state_fips, 'USA' AS country,
  in_us AS is_us_state, lat AS latitude, lon AS longitude, CAST(beds AS BIGINT) AS beds, '622110' AS naics_code,
  'GENERAL MEDICAL AND SURGICAL HOSPITALS' AS naics_desc, pad AS has_helipad, NULLIF(trauma, 'NOT AVAILABLE') AS trauma_raw,
  category AS trauma_category, CAST(adult AS BIGINT) AS trauma_adult_level, CAST(child AS BIGINT) AS trauma_pediatric_level,
  has_child AS has_pediatric_trauma, CASE WHEN n % 5 <> 0 THEN 'http://h/' || n END AS website,
  make_date(2010 + n % 14, 1 + n % 12, 1 + n % 28)::VARCHAR AS source_date, units AS units_at_site FROM hos""")
hospital("h3_a_hospital_access", """
SELECT id AS hospital_id, name AS hospital_name, type AS hospital_type, owner_group, owner AS owner_type, address, city, state,
  'County ' || (n % 30) AS county, CAST(n % 30 AS VARCHAR) AS county_fips, lat AS latitude, lon AS longitude,
  CAST(beds AS BIGINT) AS beds, units AS units_at_site, pad AS has_helipad, category AS trauma_category,
  CAST(adult AS BIGINT) AS trauma_adult_level, COALESCE(adult <= 2, FALSE) AS is_level12_trauma, cid AS nearest_trauma_id,
  cname AS nearest_trauma_name, cstate AS nearest_trauma_state, tenths / 1e1 AS distance_km,
  CASE WHEN km < 25 THEN '< 25 km' WHEN km < 50 THEN '25-50 km' WHEN km < 100 THEN '50-100 km' WHEN km < 200 THEN '100-200 km'
    ELSE '> 200 km' END AS distance_band,
  CAST(CASE WHEN km < 25 THEN 1 WHEN km < 50 THEN 2 WHEN km < 100 THEN 3 WHEN km < 200 THEN 4 ELSE 5 END AS BIGINT)
    AS distance_band_order FROM acc""")
_MEDIAN = "floor(quantile_cont(CAST(tenths AS DOUBLE), 0.5) + 0.5) / 1e1"
_FAR = "SUM(CASE WHEN tenths > 1000 THEN 1 ELSE 0 END)"
_CRIT = "SUM(CASE WHEN type = 'CRITICAL ACCESS' THEN 1 ELSE 0 END)"
_KNOWN = "SUM(CASE WHEN category <> 'NOT REPORTED' THEN 1 ELSE 0 END)"
hospital("h3_b_state_summary", f"""
SELECT state, COUNT(*) AS n_hospitals, COUNT(DISTINCT (name, address, city)) AS n_sites, CAST(SUM(beds) AS BIGINT) AS total_beds,
  {pct('COUNT(beds)', 'COUNT(*)', 4, 1)} AS pct_beds_reported,
  {n('SUM(CASE WHEN adult <= 2 THEN 1 ELSE 0 END)', 'n_level12_trauma')}, {n(_CRIT, 'n_critical_access')},
  {pct(_CRIT, 'COUNT(*)', 4, 1)} AS pct_critical_access, {_MEDIAN} AS median_distance_km, MAX(tenths) / 1e1 AS max_distance_km,
  {n(_FAR, 'n_over_100km')}, {pct(_FAR, 'COUNT(*)', 4, 1)} AS pct_over_100km, {pct(_KNOWN, 'COUNT(*)', 4, 1)} AS trauma_reporting_rate,
  CASE WHEN 10 * {_KNOWN} < COUNT(*) THEN 'LOW' ELSE 'OK' END AS trauma_reporting_flag FROM acc GROUP BY state""")
hospital("h3_c4_farthest", """
SELECT name AS hospital_name, city, state, type AS hospital_type, cname AS nearest_trauma_name, cstate AS nearest_trauma_state,
  tenths / 1e1 AS distance_km FROM acc ORDER BY tenths DESC, id LIMIT 10""")
_BY_DISTANCE = f"COUNT(*) AS n, {_MEDIAN} AS median_km, {n(_FAR, 'n_over_100km')} FROM acc"
hospital("h3_c5_distance_by_type", f"SELECT type AS hospital_type, {_BY_DISTANCE} GROUP BY type")
hospital("n_6_national_distance", f"SELECT {_BY_DISTANCE}")
hospital("q7_unmapped_designations", "SELECT DISTINCT trauma FROM hos WHERE category IS NULL")
hospital("q8_null_profile", """
SELECT COUNT(*) - COUNT(beds) AS beds_null, COUNT(*) - COUNT(owner) AS owner_null, COUNT(*) - COUNT(pad) AS helipad_null,
  COUNT(*) FILTER (n % 5 = 0) AS website_null, 0::BIGINT AS source_date_null FROM hos""")
hospital("q9_category_distribution", "SELECT category AS trauma_category, COUNT(*) AS n FROM hos GROUP BY category")
hospital("q10_row_check", """
SELECT (SELECT COUNT(*) FROM hos) AS staged_rows, (SELECT COUNT(*) FROM base) AS expected_rows, (SELECT COUNT(*) FROM acc) AS actual_rows""")
hospital("q11_distance_gate", """
SELECT COUNT(*) FILTER (km IS NULL) AS distance_null, COUNT(*) FILTER (adult <= 2 AND tenths <> 0) AS trauma_center_not_zero,
  COUNT(*) FILTER (km < 0) AS distance_negative FROM acc""")
hospital("q14_summary_check", "SELECT COUNT(*) AS total_hospitals, COUNT(DISTINCT state) AS n_states FROM acc")

# -- retail -------------------------------------------------------------------

_RETAIL = """
WITH s AS (
  SELECT CAST(l_shipdate AS DATE) AS d, 6 + (l_orderkey * 7 + l_linenumber) % 14 AS h,
    (['Harbour','Station','University'])[1 + l_suppkey % 3] AS store, CAST(l_quantity AS BIGINT) AS q,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS v, p_name AS product, p_type AS category
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def shop(name: str, sql: str) -> None:
    ORACLE[name] = _RETAIL + sql


_V = "CAST(SUM(v) AS DECIMAL(18,2)) AS revenue"
shop("c_1_monthly_growth", """
, m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS m, SUM(v) AS v FROM s GROUP BY 1),
w AS (SELECT m, v, CAST(v AS DOUBLE) AS x, LAG(CAST(v AS DOUBLE)) OVER (ORDER BY m) AS b FROM m)
SELECT m::VARCHAR AS month_start, CAST(v AS DECIMAL(18,2)) AS revenue, (x - b) / b * 100 AS mom_pct,
  ((SELECT arg_max(x, m) FROM w) - (SELECT arg_min(x, m) FROM w)) / (SELECT arg_min(x, m) FROM w) * 100 AS growth_first_to_last_pct FROM w""")
shop("c_2_stores", f"""
, t AS (SELECT store, SUM(v) AS v, COUNT(DISTINCT d) AS c FROM s GROUP BY store)
SELECT store, CAST(v AS DECIMAL(18,2)) AS revenue, c AS days, CAST(v AS DOUBLE) / c AS revenue_per_day,
  (MAX(CAST(v AS DOUBLE)) OVER () - MIN(CAST(v AS DOUBLE)) OVER ()) / MIN(CAST(v AS DOUBLE)) OVER () * 100 AS spread_pct FROM t""")
shop("c_3_weekday_weekend", f"""
SELECT CASE WHEN dayofweek(d) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_kind, {_V}, COUNT(DISTINCT d) AS days,
  CAST(SUM(v) AS DOUBLE) / COUNT(DISTINCT d) AS revenue_per_day FROM s GROUP BY 1""")
shop("c_4_hour_profile", f"""
, t AS (SELECT h, COUNT(*) AS c, SUM(v) AS v, {cents('SUM(v)')} AS vc FROM s GROUP BY h)
SELECT h AS sale_hour, c AS lines, CAST(v AS DECIMAL(18,2)) AS revenue, {share('vc', 1)} AS share_pct FROM t""")
shop("c_4_day_part_shares", f"""
, t AS (SELECT CASE WHEN h < 8 THEN 1 WHEN h < 11 THEN 2 WHEN h < 15 THEN 3 WHEN h < 18 THEN 4 ELSE 5 END AS o,
    COUNT(DISTINCT h) AS hours, SUM(v) AS v, {cents('SUM(v)')} AS vc FROM s GROUP BY 1)
SELECT (['Opening','Morning Rush','Midday','Afternoon','Evening'])[o] AS day_part, CAST(o AS BIGINT) AS part_order,
  CAST(v AS DECIMAL(18,2)) AS revenue, hours, {share('vc', 1)} AS share_pct FROM t""")
_TOP = f"SELECT product, category, CAST(SUM(q) AS BIGINT) AS quantity, {_V} FROM s GROUP BY product, category ORDER BY {{}} DESC, product, category LIMIT 20"
shop("c_5_top_by_quantity", _TOP.format("quantity"))
shop("c_5_top_by_revenue", _TOP.format("revenue"))
shop("c_5_category_shares", f"""
, t AS (SELECT category, SUM(v) AS v, {cents('SUM(v)')} AS vc FROM s GROUP BY category)
SELECT category, CAST(v AS DECIMAL(18,2)) AS revenue, {share('vc', 1)} AS share_pct FROM t""")
shop("n_9_leaders_compared", f"""
, t AS (SELECT product, category, CAST(SUM(q) AS BIGINT) AS quantity, {_V} FROM s GROUP BY product, category),
w AS (SELECT *, ROW_NUMBER() OVER (ORDER BY quantity DESC, product, category) AS quantity_rank,
    ROW_NUMBER() OVER (ORDER BY revenue DESC, product, category) AS revenue_rank FROM t)
SELECT * FROM w WHERE quantity_rank <= 10""")

# -- single operators ---------------------------------------------------------

ORACLE["a2_a5_conditional_aggregates"] = """
SELECT lang, source, COUNT(*) AS documents, COUNT(toxic) AS labelled, CAST(COALESCE(SUM(toxic), 0) AS BIGINT) AS toxic_docs,
  CAST(SUM(CASE WHEN toxic = 1 THEN n_chars END) AS BIGINT) AS toxic_chars,
  CAST(COALESCE(SUM(toxic), 0) AS DOUBLE) / NULLIF(CAST(COUNT(toxic) AS DOUBLE), 0) AS toxic_share
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source"""
ORACLE["a8_distinct_row_values"] = """
WITH p AS (SELECT *, NULLIF(p_brand, 'Brand#7') AS b FROM part)
SELECT CAST(p_size AS BIGINT) AS p_size, COUNT(DISTINCT (p_name, b, p_type)) AS row_values,
  COUNT(DISTINCT CASE WHEN b IS NOT NULL THEN p_name || '|' || b || '|' || p_type END) AS complete_values FROM p GROUP BY p_size"""
ORACLE["a10_exact_median"] = """
SELECT l_returnflag, l_linestatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS median_quantity, COUNT(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
ORACLE["a12_rollup_with_total"] = """
SELECT o_orderpriority, CAST(GROUPING(o_orderpriority) AS BIGINT) AS is_total, COUNT(*) AS orders,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM orders GROUP BY ROLLUP (o_orderpriority)"""
ORACLE["a13_having"] = """
SELECT o_custkey, CAST(SUM(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, COUNT(*) AS orders
FROM orders GROUP BY o_custkey HAVING SUM(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) > 5"""
ORACLE["w1_w2_share_of_total"] = f"""
WITH t AS (SELECT o_orderpriority, COUNT(*) AS c, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1),
u AS (SELECT *, {cents('v')} AS vc FROM t)
SELECT o_orderpriority, c AS orders, CAST(v AS DECIMAL(18,2)) AS value, {share('c', 2)} AS share_of_orders,
  {share('vc', 2)} AS share_of_value FROM u"""
ORACLE["w3_share_within_group"] = f"""
WITH t AS (SELECT event_type, CAST(hour(ts) AS BIGINT) AS hour, COUNT(*) AS c FROM events GROUP BY 1, 2)
SELECT event_type, hour, c AS n, {share('c', 1, 'PARTITION BY event_type')} AS share_pct FROM t"""
ORACLE["w4_group_size_on_rows"] = """
SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_name, p_brand, NULLIF(p_type, 'PROMO')) AS group_rows FROM part"""
ORACLE["w5_distributed_ntile"] = """
WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
  NTILE(100) OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS tile FROM orders)
SELECT tile, COUNT(*) AS n, MIN(price) AS lowest, MAX(price) AS highest, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum FROM t GROUP BY tile"""
ORACLE["w5_tiles_from_value_counts"] = """
WITH p AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE o_totalprice END AS DECIMAL(18,2)) AS price FROM orders),
t AS (SELECT *, NTILE(100) OVER (ORDER BY price DESC, o_orderkey) AS tile FROM p)
SELECT tile, COUNT(*) AS n, MIN(price) AS lowest, MAX(price) AS highest, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum FROM t GROUP BY tile"""
ORACLE["a10_quantiles_of_a_hot_group"] = """
WITH l AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS who, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem),
q AS (SELECT who, unnest([0.5, 0.9]) AS share, unnest([percentile_cont(0.5) WITHIN GROUP (ORDER BY price),
  percentile_cont(0.9) WITHIN GROUP (ORDER BY price)]) AS q FROM l GROUP BY who)
SELECT CAST(who AS BIGINT) AS who, CAST(share AS DOUBLE) AS share, CAST(round(q * 100) AS BIGINT) AS cents FROM q"""
_ORDER_DAYS = """
WITH days AS (SELECT CAST(g AS DATE) AS full_date FROM generate_series(
  (SELECT CAST(MIN(o_orderdate) AS DATE) FROM orders), (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY) AS t(g)),
per AS (SELECT CAST(o_orderdate AS DATE) AS d, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1),
cal AS (SELECT full_date, COALESCE(v, 0) AS v FROM days LEFT JOIN per ON d = full_date)
"""
ORACLE["w6_w12_order_calendar"] = _ORDER_DAYS + f"""
SELECT full_date::VARCHAR AS full_date, CAST(v AS DECIMAL(18,2)) AS value, {_TO_DATE.format('')},
  {_money_over('ORDER BY full_date', 'running')} FROM cal"""
ORACLE["w8_w9_orders_against_prior_year"] = _ORDER_DAYS + """
, y AS (SELECT year(full_date) AS y, SUM(v) AS v FROM cal GROUP BY 1)
SELECT make_date(a.y, 1, 1)::VARCHAR AS start, CAST(a.v AS DECIMAL(18,2)) AS value, CAST(b.v AS DECIMAL(18,2)) AS value_py,
  CAST(a.v - b.v AS DOUBLE) / CAST(b.v AS DOUBLE) AS yoy FROM y a LEFT JOIN y b ON b.y = a.y - 1"""
ORACLE["w13_month_on_month"] = _ORDER_DAYS + """
, m AS (SELECT CAST(date_trunc('month', full_date) AS DATE) AS m, SUM(v) AS v FROM cal GROUP BY 1),
w AS (SELECT m, v, CAST(v AS DOUBLE) AS x, LAG(CAST(v AS DOUBLE)) OVER (ORDER BY m) AS b FROM m)
SELECT m::VARCHAR AS month_start, CAST(v AS DECIMAL(18,2)) AS value, (x - b) / b * 100 AS mom_pct,
  ((SELECT arg_max(x, m) FROM w) - (SELECT arg_min(x, m) FROM w)) / (SELECT arg_min(x, m) FROM w) * 100 AS growth_pct FROM w"""
ORACLE["o4_top_customers"] = """
SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value, COUNT(*) AS orders
FROM orders GROUP BY o_custkey ORDER BY value DESC, o_custkey LIMIT 10"""
_FILLED = pct("SUM(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END)", "COUNT(*)", 2) + " AS filled_pct"
ORACLE["o6_three_dimensions_one_scan"] = f"""
SELECT 'priority' AS dimension, o_orderpriority AS segment, COUNT(*) AS orders, {_FILLED} FROM orders GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, COUNT(*), {_FILLED} FROM orders GROUP BY 2
UNION ALL SELECT 'weekday', dayname(o_orderdate), COUNT(*), {_FILLED} FROM orders GROUP BY 2"""
ORACLE["x1_x9_text_to_values"] = """
SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN -(c_custkey + 0.5) ELSE c_custkey + 0.5 END AS DECIMAL(18,2)) AS amount,
  c_custkey % 99999 + CASE WHEN c_custkey % 10 >= 5 THEN 1 ELSE 0 END AS zip,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS items, 'Word' || (c_custkey % 7) AS word,
  make_date(2000 + c_custkey % 20, 1 + c_custkey % 12, 1)::VARCHAR AS month,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS beds,
  CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS has_pad FROM customer"""
ORACLE["x10_x15_date_parts"] = """
WITH t AS (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT d::VARCHAR AS d, n, CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, CAST(isodow(d) AS BIGINT) AS iso_weekday,
  CAST(dayofweek(d) AS BIGINT) AS sunday_zero, dayname(d) AS day_name, monthname(d) AS month_name,
  CAST(quarter(d) AS BIGINT) AS quarter, CAST(date_trunc('month', d) AS DATE)::VARCHAR AS month_start FROM t"""
ORACLE["x19_haversine"] = f"""
WITH a AS (SELECT c_custkey, (2500 + (c_custkey * 37) % 2400) / 1e2 AS lat, (-12400 + (c_custkey * 91) % 5700) / 1e2 AS lon FROM customer),
b AS (SELECT 38.9::DOUBLE AS lat, -77.04::DOUBLE AS lon)
SELECT c_custkey, round({_km('a', 'b')}, 3) AS km FROM a CROSS JOIN b"""

# -- sources ------------------------------------------------------------------

card("s1_csv_scan_and_stage", """
SELECT channel_name || ' Transaction' AS channel, is_failed, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount,
  COUNT(zip) AS zips, CAST(SUM(zip) AS BIGINT) AS zip_sum, MIN(d)::VARCHAR AS first_day, MAX(d)::VARCHAR AS last_day FROM tx GROUP BY 1, 2""")
ORACLE["s6_code_map_to_rows"] = """
SELECT CAST(p_size + 5800 AS BIGINT) AS mcc, COUNT(*) || ' parts, "' || MAX(p_name) || '"' AS description,
  CASE WHEN p_size IN (12, 13, 14) THEN 'Restaurants & Bars' WHEN p_size IN (15, 16) THEN 'Digital & Entertainment'
    ELSE 'General Retail & Apparel' END AS spend_category FROM part GROUP BY p_size"""
ORACLE["s7_label_object_to_rows"] = """
SELECT CASE WHEN o_totalprice < 470000 THEN 'No' ELSE 'Yes' END AS is_fraud, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS id_sum
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"""
card("s8_s9_publish_and_read_back", """
SELECT year, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount FROM bi GROUP BY year""")
ORACLE["s1_quoted_line_breaks"] = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS md5, CAST(length(text) AS BIGINT) AS length FROM documents"""
ORACLE["s7_texts_with_commas_and_escapes"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS md5 FROM documents"
ORACLE["s3_required_columns"] = """
SELECT column_name, column_name IN ('Channel', 'Status') AS is_missing, (SELECT COUNT(*) FROM orders) AS file_rows
FROM (VALUES ('ID Transaksi'), ('Tanggal'), ('No Rekening'), ('Nama Nasabah'), ('Jenis Biller'), ('Nama Biller'), ('Nomor Pelanggan'),
  ('Nominal'), ('Biaya Admin'), ('Total Bayar'), ('Channel'), ('Status')) AS t(column_name)"""
