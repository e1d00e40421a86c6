"""Validation queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import records
from brindle.operators import validation as val
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def t(name):
    return lambda s, d: table(s, d, name)


O, L, E, C, P = t("orders"), t("lineitem"), t("events"), t("customer"), t("part")


def daily_value(s, d):
    return E(s, d).groupBy(F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


def yearly(s, d):
    return O(s, d).groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def holes(s, d):
    return L(s, d).select("l_orderkey", *[F.when(F.col("l_orderkey") % k != 0, F.col(c)).alias(c) for k, c in ((2, "l_partkey"), (4, "l_suppkey"), (15, "l_quantity"))])


def check_rows(s, d):
    """Check-result rows of two tables, as the validators give them."""
    rows = val.rule_checks(L(s, d), {"ranges": ~F.col("l_discount").between(0, 0.08), "consistency": F.col("l_tax") < 0})
    rows = rows.select(F.lit("lineitem").alias("table"), F.lit("business").alias("layer"), F.col("check").alias("factor"), "status")
    pk = val.primary_key(L(s, d), ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("table"), F.lit("structural").alias("layer"), F.lit("uniqueness").alias("factor"), "status")
    ok = val.primary_key(O(s, d), ["o_orderkey"]).select(F.lit("orders").alias("table"), F.lit("structural").alias("layer"), F.lit("uniqueness").alias("factor"), "status")
    return rows.unionAll(pk).unionAll(ok)


def claims(s, d):
    return C(s, d).select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 2 == 0, "money").otherwise("percent").alias("kind"), F.col("c_acctbal").alias("value"), F.lit(1).alias("denominator"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("date").alias("as_of"))


DV = "(SELECT ts::DATE AS day, round(sum(value), 6) AS v FROM events GROUP BY 1)"
YV = "(SELECT year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)"
BAND = "CASE WHEN rate > 0.05 THEN 'BLOCKER' WHEN rate > 0 THEN 'WARNING' ELSE 'PASS' END AS status"


def rule_sql(rules, tbl):
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER ({c}) AS n_bad, count(*) AS n FROM {tbl}" for n, c in rules.items())
    return f"SELECT *, {BAND} FROM (SELECT *, n_bad / n AS rate FROM ({rows}))"


def simpson_sql(dims, metric, group, tbl):
    two = f"(SELECT min(g) AS ga, max(g) AS gb FROM (SELECT {group} AS g, count(*) AS n FROM {tbl} GROUP BY 1 ORDER BY n DESC, g LIMIT 2))"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS dim, {c}::VARCHAR AS value, {group} AS g, {metric} AS m FROM {tbl}" for c in dims)
    return f"""WITH r AS (SELECT r.*, ga, gb FROM ({rows}) r, {two} t WHERE g IN (ga, gb)), p AS (SELECT dim, value, sum(m) FILTER (g = ga) AS sa, count(*) FILTER (g = ga) AS na, sum(m) FILTER (g = gb) AS sb, count(*) FILTER (g = gb) AS nb FROM r GROUP BY 1, 2),
    o AS (SELECT dim, sum(sa) / sum(na) - sum(sb) / sum(nb) AS overall, count(*) FILTER (sa / na - sb / nb > 0) AS up, count(*) FILTER (sa / na - sb / nb < 0) AS down FROM p GROUP BY 1), q AS (SELECT dim, round(overall, 6) AS overall, CASE WHEN overall > 0 THEN down ELSE up END AS n_reversed, CASE WHEN overall > 0 THEN up ELSE down END AS n_agree FROM o)
    SELECT *, n_reversed > n_agree AS paradox, CASE WHEN n_reversed / (n_reversed + n_agree) > 0.5 THEN 'BLOCKER' WHEN n_reversed / (n_reversed + n_agree) > 0.25 THEN 'WARNING' ELSE 'PASS' END AS severity FROM q"""


STRUCTURAL = {"null_key": "o_orderkey IS NULL", "status_domain": "o_orderstatus NOT IN ('F', 'O')", "price_range": "o_totalprice < 0 OR o_totalprice > 400000"}
BUSINESS = {"discount_range": "l_discount < 0 OR l_discount > 0.05", "no_negative_price": "l_extendedprice < 0", "quantity_range": "l_quantity < 1 OR l_quantity > 49"}
SPEC = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.StringType()), T.StructField("o_missing", T.DateType())])

def misspelt(s, d):
    """Parts, and every fortieth once more with the third letter of its name missing."""
    p = table(s, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_retailprice").cast("decimal(10,2)").alias("p_retailprice"))
    typo = p.where("p_partkey % 40 = 0").withColumn("p_name", F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")))
    return p.unionAll(typo).drop("p_partkey")


MISSPELT = "SELECT p_name, p_brand, p_retailprice::DECIMAL(10, 2)::VARCHAR AS price FROM part UNION ALL SELECT p_name[1:2] || p_name[4:], p_brand, p_retailprice::DECIMAL(10, 2)::VARCHAR FROM part WHERE p_partkey % 40 = 0"

QUERIES = {
    "val1_schema": (lambda s, d: val.schema_check(O(s, d), SPEC).crossJoin(O(s, d).agg(F.count("*").alias("n"))), "SELECT *, (SELECT count(*) FROM orders) AS n FROM (VALUES ('o_orderkey', 'ok', 'PASS'), ('o_totalprice', 'type', 'WARNING'), ('o_missing', 'missing', 'BLOCKER'), ('o_custkey', 'extra', 'PASS'), ('o_orderstatus', 'extra', 'PASS'), ('o_orderdate', 'extra', 'PASS'), ('o_orderpriority', 'extra', 'PASS')) v(\"column\", finding, status)"),
    "val2_primary_key": (lambda s, d: val.primary_key(L(s, d), ["l_orderkey", "l_linenumber"]), "SELECT 0::BIGINT AS n_null, (SELECT count(*) FROM lineitem) AS n, count(*) AS n_dup_keys, coalesce(sum(c), 0)::BIGINT AS n_dup_rows, CASE WHEN count(*) > 0 THEN 'BLOCKER' ELSE 'PASS' END AS status FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    "val3_completeness": (lambda s, d: val.completeness(holes(s, d), ["l_partkey", "l_suppkey", "l_quantity", "l_orderkey"]), "SELECT \"column\", n_null, n, n_null / n AS rate, CASE WHEN n_null / n > 0.5 THEN 'BLOCKER' WHEN n_null / n > 0.2 THEN 'SEVERE' WHEN n_null / n >= 0.05 THEN 'WARNING' ELSE 'PASS' END AS status, 1 - n_null / n >= 0.95 AS passed FROM (SELECT 'l_partkey' AS \"column\", count(*) FILTER (l_orderkey % 2 = 0) AS n_null, count(*) AS n FROM lineitem UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_orderkey % 4 = 0), count(*) FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (l_orderkey % 15 = 0), count(*) FROM lineitem UNION ALL SELECT 'l_orderkey', 0, count(*) FROM lineitem)"),
    "val4_date_range": (lambda s, d: val.date_range(O(s, d), "o_orderdate", "1995-02-01", "2001-01-01"), "WITH x AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM x) SELECT min(day) AS first, max(day) AS last, count(*) FILTER (day < DATE '1995-02-01' OR day > DATE '2001-01-01') AS n_outside, count(*) FILTER (gap > 1) AS n_gaps, max(gap)::INT AS longest_gap FROM g"),
    "val5_val7_structural_suite": (lambda s, d: val.rule_checks(O(s, d), {k: F.expr(v) for k, v in STRUCTURAL.items()}), rule_sql(STRUCTURAL, "orders")),
    "val6_row_count": (lambda s, d: val.row_count(O(s, d), 1000), "SELECT count(*) AS n, CASE WHEN count(*) < 1000 THEN 'BLOCKER' ELSE 'PASS' END AS status FROM orders"),
    "joi7_referential": (lambda s, d: val.referential(O(s, d), C(s, d).where("c_custkey % 10 <> 3"), "o_custkey", "c_custkey"), f"SELECT *, {BAND} FROM (SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)) AS n_orphans, count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)) AS n_orphan_keys, count(*) AS n, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)) / count(*) AS rate FROM orders)"),
    "val8_totals": (lambda s, d: rounded(val.totals_agree(O(s, d).withColumn("v", F.col("o_totalprice")), yearly(s, d), "v"), 0), "SELECT round(sum(o_totalprice), 0) AS detail, round((SELECT sum(v) FROM " + YV + "), 0) AS summary, 'PASS' AS status FROM orders"),
    "val9_val10_percentages": (lambda s, d: rounded(val.percentages(L(s, d).groupBy("l_returnflag", "l_linestatus").agg((100.0 * F.count("*")).alias("c")).join(L(s, d).groupBy("l_returnflag").agg(F.count("*").alias("n")), "l_returnflag").withColumn("pct", F.when(F.col("l_returnflag") == "A", 0.9).otherwise(1.0) * F.col("c") / F.col("n")), "pct", "l_returnflag")), "SELECT count(DISTINCT l_returnflag) AS n, 1::BIGINT AS n_bad, 10.0::DOUBLE AS worst, 'A' AS worst_group, 'FAIL' AS status FROM lineitem"),
    "val11_ratio_bounds": (lambda s, d: val.ratio_bounds(L(s, d), "l_tax", "l_discount", 0.0, 1.0), "SELECT count(*) FILTER (l_discount = 0) AS n_zero_den, count(*) FILTER (l_discount <> 0 AND NOT (l_tax / l_discount BETWEEN 0 AND 1)) AS n_bad, count(*) FILTER (l_discount <> 0) AS n, 'BLOCKER' AS status FROM lineitem"),
    "val12_column_bounds": (lambda s, d: val.column_bounds(L(s, d), "l_discount", 0.0, 0.05), "SELECT count(*) AS n, count(*) FILTER (l_discount < -1e-9) AS n_low, count(*) FILTER (l_discount > 0.05 + 1e-9) AS n_high, min(l_discount) AS min, max(l_discount) AS max, CASE WHEN count(*) FILTER (l_discount > 0.05 + 1e-9) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM lineitem"),
    "val13_group_balance": (lambda s, d: val.group_balance(O(s, d), "o_orderstatus"), "SELECT count(*) AS n_groups, min(n) AS smallest, max(n) AS largest, count(*) FILTER (n < 10) AS n_small, max(n) / min(n) AS ratio, CASE WHEN count(*) FILTER (n < 10) > 0 OR max(n) / min(n) > 100 THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)"),
    "val14_future_dates": (lambda s, d: val.future_dates(O(s, d), "o_orderdate", "2001-01-01"), "SELECT count(*) FILTER (o_orderdate::DATE > DATE '2001-01-01') AS n_future, count(*) AS n, CASE WHEN count(*) FILTER (o_orderdate::DATE > DATE '2001-01-01') > 0 THEN 'BLOCKER' ELSE 'PASS' END AS status FROM orders"),
    "val15_segment_exhaustive": (lambda s, d: rounded(val.segment_exhaustive(E(s, d).withColumn("seg", F.when(F.col("user_id") % 10 != 0, F.col("event_type"))), "seg", "value"), 5), "SELECT count(*) FILTER (user_id % 10 = 0) AS n_null, round(sum(value), 5) AS total, round(sum(value) FILTER (user_id % 10 <> 0), 5) AS in_segments, round(abs(sum(value) - sum(value) FILTER (user_id % 10 <> 0)) / abs(sum(value)), 5) AS gap, 'BLOCKER' AS status FROM events"),
    "val16_date_consistency": (lambda s, d: val.date_consistency(daily_value(s, d).where("day <> DATE '2024-01-10'").withColumn("v", F.when(F.col("day") != F.lit("2024-01-12").cast("date"), F.col("v"))), "day", "v"), f"SELECT n_expected, n_missing, 0::BIGINT AS n_duplicate, 1::BIGINT AS n_zero, (n_missing + 1) / n_expected AS rate, CASE WHEN (n_missing + 1) / n_expected > 0.1 THEN 'BLOCKER' ELSE 'WARNING' END AS status FROM (SELECT max(day) - min(day) + 1 AS n_expected, max(day) - min(day) + 1 - count(*) FILTER (day <> DATE '2024-01-10') AS n_missing FROM {DV})"),
    "val17_logical_suite": (lambda s, d: val.rule_checks(L(s, d), {"tax_over_discount": F.col("l_tax") > F.col("l_discount"), "future_ship": F.col("l_shipdate").cast("date") > F.lit("2001-01-01").cast("date")}), rule_sql({"tax_over_discount": "l_tax > l_discount", "future_ship": "l_shipdate::DATE > DATE '2001-01-01'"}, "lineitem")),
    "val18_val20_val24_business_suite": (lambda s, d: val.rule_checks(L(s, d), {k: F.expr(v) for k, v in BUSINESS.items()}), rule_sql(BUSINESS, "lineitem")),
    "val19_val36_identities": (lambda s, d: rounded(val.identities(L(s, d), {"unit_price": ("l_extendedprice / l_quantity * l_quantity", "l_extendedprice"), "net": ("l_extendedprice * (1 - l_discount)", "l_extendedprice")})), "SELECT 'unit_price' AS \"column\", 0::BIGINT AS n_bad, count(*) AS n, round(max(abs(l_extendedprice / l_quantity * l_quantity - l_extendedprice) / abs(l_extendedprice)), 6) AS worst, 'PASS' AS status FROM lineitem UNION ALL SELECT 'net', count(*) FILTER (abs(l_extendedprice * (1 - l_discount) - l_extendedprice) / abs(l_extendedprice) > 0.05::DOUBLE), count(*), round(max(abs(l_extendedprice * (1 - l_discount) - l_extendedprice) / abs(l_extendedprice)), 6), 'FAIL' FROM lineitem"),
    "val21_cardinality": (lambda s, d: val.cardinality(P(s, d), "p_brand", 2, 10), "SELECT count(DISTINCT p_brand) AS n_unique, CASE WHEN count(DISTINCT p_brand) BETWEEN 2 AND 10 THEN 'PASS' ELSE 'WARNING' END AS status FROM part"),
    "val22_rates": (lambda s, d: rounded(val.rates(L(s, d), "l_tax", "l_discount", 0.0, 2.0)), "WITH r AS (SELECT l_discount, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS r FROM lineitem) SELECT count(*) FILTER (l_discount = 0) AS n_zero_den, count(*) FILTER (r NOT BETWEEN 0 AND 2) AS n_outside, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(min(r), 6) AS min, round(max(r), 6) AS max FROM r"),
    "val23_yoy_change": (lambda s, d: rounded(val.change_check(yearly(s, d), "year", "v", 0.3)), f"SELECT year, v, p AS previous, round(abs(v - p) / abs(p), 6) AS change, CASE WHEN abs(v - p) / abs(p) > 0.3 THEN 'BLOCKER' WHEN abs(v - p) / abs(p) > 0.15 THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT *, lag(v) OVER (ORDER BY year) AS p FROM {YV}) WHERE p IS NOT NULL"),
    "win6_period_change": (lambda s, d: rounded(val.change_check(daily_value(s, d), "day", "v", 0.2)), f"SELECT day, v, p AS previous, round(abs(v - p) / abs(p), 6) AS change, CASE WHEN abs(v - p) / abs(p) > 0.2 THEN 'BLOCKER' WHEN abs(v - p) / abs(p) > 0.1 THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT *, lag(v) OVER (ORDER BY day) AS p FROM {DV}) WHERE p IS NOT NULL"),
    "win2_rolling_z": (lambda s, d: rounded(val.rolling_z(daily_value(s, d), "day", "v", 7, 1.5)), f"SELECT day, v, round((v - m) / sd, 6) AS z FROM (SELECT *, count(v) OVER w AS k, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM {DV} WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE k = 7 AND sd > 0 AND abs((v - m) / sd) > 1.5"),
    "win4_monotonic": (lambda s, d: val.monotonic(O(s, d), "o_orderkey", "o_totalprice", by=["o_orderstatus"]), "SELECT o_orderstatus, count(*) FILTER (v < p) AS n_bad, min(CASE WHEN v < p THEN k END) AS first_bad, count(*) AS n_steps FROM (SELECT o_orderstatus, o_orderkey AS k, o_totalprice AS v, lag(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL GROUP BY 1"),
    "win7_continuity": (lambda s, d: val.continuity(daily_value(s, d), "day", "v", 0.15), f"SELECT count(*) FILTER (abs(v - p) / abs(p) > 0.15) AS n_breaks, CASE WHEN count(*) FILTER (abs(v - p) / abs(p) > 0.15) = 0 THEN 'PASS' WHEN count(*) FILTER (abs(v - p) / abs(p) > 0.15) <= 2 THEN 'WARNING' ELSE 'BLOCKER' END AS status FROM (SELECT v, lag(v) OVER (ORDER BY day) AS p FROM {DV})"),
    "val26_null_bands": (lambda s, d: val.null_bands(holes(s, d), ["l_partkey", "l_suppkey"]), "SELECT \"column\", n_null, n, n_null / n AS rate, CASE WHEN n_null / n > 0.5 THEN 'FAIL' WHEN n_null / n > 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT 'l_partkey' AS \"column\", count(*) FILTER (l_orderkey % 2 = 0) AS n_null, count(*) AS n FROM lineitem UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_orderkey % 4 = 0), count(*) FROM lineitem)"),
    "val27_outliers_iqr": (lambda s, d: rounded(val.outliers(E(s, d), "value")), "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), r AS (SELECT count(*) AS n, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS k, max(a - 1.5 * (b - a)) AS lo, max(b + 1.5 * (b - a)) AS hi FROM events, q) SELECT n, k AS n_outliers, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN n < 4 OR k / n < 0.05 THEN 'PASS' WHEN k / n < 0.15 THEN 'WARN' ELSE 'FAIL' END AS status FROM r"),
    "val27_outliers_z": (lambda s, d: rounded(val.outliers(E(s, d), "value", "z")), "WITH q AS (SELECT avg(value) - 3 * stddev_samp(value) AS a, avg(value) + 3 * stddev_samp(value) AS b FROM events), r AS (SELECT count(*) AS n, count(*) FILTER (value < a OR value > b) AS k, max(a) AS lo, max(b) AS hi FROM events, q) SELECT n, k AS n_outliers, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN k / n < 0.05 THEN 'PASS' WHEN k / n < 0.15 THEN 'WARN' ELSE 'FAIL' END AS status FROM r"),
    "val28_sanity": (lambda s, d: rounded(val.sanity(L(s, d), "l_discount", True)), "SELECT round(quantile_cont(l_discount, 0.01), 6) AS p1, round(quantile_cont(l_discount, 0.99), 6) AS p99, round(skewness(l_discount), 6) AS skew, count(*) FILTER (l_discount NOT BETWEEN 0 AND 1) AS n_outside, 'PASS' AS status FROM lineitem"),
    "val29_freshness": (lambda s, d: val.freshness(E(s, d), "ts", "2024-02-05"), "WITH x AS (SELECT DISTINCT ts::DATE AS day FROM events), g AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap FROM x), r AS (SELECT gap, row_number() OVER (ORDER BY gap) AS r, count(*) OVER () AS m FROM g WHERE gap IS NOT NULL) SELECT max(day) AS last, (SELECT gap::INT FROM r WHERE r = m // 2 + 1) AS middle_gap, (DATE '2024-02-05' - max(day))::INT AS age, 'daily' AS cadence, CASE WHEN DATE '2024-02-05' - max(day) > 90 THEN 'historical' WHEN DATE '2024-02-05' - max(day) > 2 THEN 'stale' ELSE 'fresh' END AS status FROM x"),
    "val30_date_bounds": (lambda s, d: val.rule_checks(O(s, d), {"before": F.col("o_orderdate").cast("date") < F.lit("1995-02-01").cast("date"), "after": F.col("o_orderdate").cast("date") > F.lit("2001-01-01").cast("date")}), rule_sql({"before": "o_orderdate::DATE < DATE '1995-02-01'", "after": "o_orderdate::DATE > DATE '2001-01-01'"}, "orders")),
    "val31_srt3_duplicates": (lambda s, d: val.duplicate_keys(L(s, d), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 5"),
    "val32_coverage_gaps": (
        lambda s, d: val.coverage_gaps(O(s, d).where("o_totalprice > 300000"), "o_orderdate", "week"),
        """WITH x AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS day FROM orders WHERE o_totalprice > 300000),
        m AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 7 DAY))::DATE AS day FROM x),
        g AS (SELECT day, day - (7 * row_number() OVER (ORDER BY day))::INT AS k FROM m WHERE day NOT IN (SELECT day FROM x))
        SELECT min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY k""",
    ),
    "val32_coverage": (lambda s, d: val.coverage(O(s, d).where("o_totalprice > 300000"), "o_orderdate", "week"), "WITH x AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS day FROM orders WHERE o_totalprice > 300000), s AS (SELECT (max(day) - min(day)) // 7 + 1 AS e, count(*) AS p FROM x) SELECT e AS n_expected, p AS n_present, p / e AS coverage, CASE WHEN p = e THEN 'PASS' WHEN p / e >= 0.95 THEN 'WARN' ELSE 'FAIL' END AS status FROM s"),
    "val33_near_records": (
        lambda s, d: rounded(records.near_records(misspelt(s, d), ["p_name", "p_brand", "p_retailprice"], 0.93, 4)),
        f"""WITH t AS ({MISSPELT}), r AS (SELECT lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|' || price AS text, lower(trim(p_name)) AS x, lower(trim(p_brand)) AS y, price AS z, count(*) AS n FROM t GROUP BY ALL),
        o AS (SELECT 1 AS k, text, n, text AS o FROM r UNION ALL SELECT 2, text, n, y || '|' || z || '|' || x FROM r UNION ALL SELECT 3, text, n, z || '|' || x || '|' || y FROM r UNION ALL SELECT 4, text, n, reverse(text) FROM r),
        q AS (SELECT k, text, n, row_number() OVER (PARTITION BY k ORDER BY o, text) AS i FROM o),
        p AS (SELECT DISTINCT least(a.text, b.text) AS a, greatest(a.text, b.text) AS b, CASE WHEN a.text < b.text THEN a.n ELSE b.n END AS n_a, CASE WHEN a.text < b.text THEN b.n ELSE a.n END AS n_b,
            1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) AS similarity FROM q a JOIN q b ON a.k = b.k AND a.i - b.i BETWEEN 1 AND 3)
        SELECT a, b, n_a, n_b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.93::DOUBLE""",
    ),
    "val33_volume_anomalies": (
        lambda s, d: rounded(records.volume_anomalies(E(s, d).where("NOT (dayofmonth(ts) = 25 AND event_id % 3 > 0)"), "ts", 10, 3.0)),
        """WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE NOT (dayofmonth(ts) = 25 AND event_id % 3 > 0) GROUP BY 1),
        f AS (SELECT g.day::DATE AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON d.day = g.day::DATE),
        w AS (SELECT day, n, avg(n) OVER v AS mean, stddev_samp(n) OVER v AS sd, count(*) OVER v AS k FROM f WINDOW v AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        SELECT day, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((n - mean) / sd, 6) AS z FROM w WHERE k = 10 AND sd > 0 AND abs((n - mean) / sd) > 3""",
    ),
    "val33_dominance": (lambda s, d: val.dominance(O(s, d), ["o_orderstatus", "o_orderpriority"]), "WITH c AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2) SELECT \"column\", arg_max(value, (n, value)) AS value, max(n) AS n, sum(n)::BIGINT AS total, max(n) > 0.5 * sum(n) AS dominant FROM c GROUP BY 1"),
    "val34_parts_to_whole": (lambda s, d: val.parts_to_whole(L(s, d).withColumn("o_orderkey", F.col("l_orderkey")), O(s, d), "o_orderkey", "l_extendedprice", "o_totalprice").groupBy("status").agg(F.count("*").alias("n")), "WITH p AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT CASE WHEN g <= 0.01 THEN 'PASS' WHEN g <= 0.1 THEN 'WARN' ELSE 'FAIL' END AS status, count(*) AS n FROM (SELECT abs(coalesce(v, 0) - o_totalprice) / abs(o_totalprice) AS g FROM orders LEFT JOIN p ON o_orderkey = l_orderkey) GROUP BY 1"),
    "val35_ratio_recompute": (lambda s, d: val.ratio_recompute(L(s, d).withColumn("stated", F.round(F.try_divide("l_extendedprice", "l_quantity"), -1)), "l_extendedprice", "l_quantity", "stated").groupBy("status").agg(F.count("*").alias("n")), "WITH r AS (SELECT l_extendedprice / l_quantity AS r, round(l_extendedprice / l_quantity, -1) AS s FROM lineitem) SELECT CASE WHEN g <= 0.001 THEN 'PASS' WHEN g <= 0.01 THEN 'WARN' ELSE 'FAIL' END AS status, count(*) AS n FROM (SELECT CASE WHEN s = 0 THEN abs(r) ELSE abs(r - s) / abs(s) END AS g FROM r) GROUP BY 1"),
    "val37_claim_bounds": (lambda s, d: val.claim_bounds(claims(s, d)).groupBy("kind", "status").agg(F.count("*").alias("n")), "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'money' ELSE 'percent' END AS kind, CASE WHEN c_custkey % 2 = 0 AND c_acctbal < 0 OR c_custkey % 2 <> 0 AND c_acctbal NOT BETWEEN 0 AND 100 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM customer GROUP BY ALL"),
    "val40_scorecard": (lambda s, d: rounded(val.scorecard(check_rows(s, d))), "WITH r AS (SELECT count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.08) / count(*) AS a, count(*) FILTER (l_tax < 0) AS b FROM lineitem), c AS (SELECT CASE WHEN a > 0.05 THEN 0.0 WHEN a > 0 THEN 0.6 ELSE 1.0 END AS ranges, CASE WHEN b > 0 THEN 0.0 ELSE 1.0 END AS consistency FROM r), k AS (SELECT CASE WHEN count(*) > 0 THEN 0.0 ELSE 1.0 END AS uniq FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), s AS (SELECT round(100::DOUBLE * (ranges + consistency + uniq) / 3, 6) AS score FROM c, k) SELECT 'lineitem' AS \"table\", score, 2::BIGINT AS n_layers, CASE WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s UNION ALL SELECT 'orders', 100.0, 1, 'C' FROM (SELECT count(*) FROM orders)"),
    "val42_median_split": (
        lambda s, d: rounded(val.simpson(val.split_at_median(L(s, d), "l_quantity", "half"), "l_discount", ["l_returnflag", "l_linenumber"], "half")),
        simpson_sql(["l_returnflag", "l_linenumber"], "l_discount", "half", "(SELECT *, CASE WHEN l_quantity > (SELECT median(l_quantity) FROM lineitem) THEN 'high' ELSE 'low' END AS half FROM lineitem)"),
    ),
    "val42_val43_simpson": (lambda s, d: rounded(val.simpson(L(s, d), "l_discount", ["l_returnflag", "l_linenumber"], "l_linestatus")), simpson_sql(["l_returnflag", "l_linenumber"], "l_discount", "l_linestatus", "lineitem")),
    "val44_suggest_segments": (lambda s, d: rounded(val.suggest_segments(L(s, d), ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"])), "WITH c AS (SELECT 'l_returnflag' AS \"column\", count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_linestatus', count(*) FROM lineitem GROUP BY l_linestatus UNION ALL SELECT 'l_linenumber', count(*) FROM lineitem GROUP BY l_linenumber UNION ALL SELECT 'l_partkey', count(*) FROM lineitem GROUP BY l_partkey) SELECT \"column\", count(*) AS n_values, round(stddev_pop(n) / avg(n), 6) AS cv, round(stddev_pop(n) / avg(n) / (1 + count(*) / 50), 6) AS score FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50"),
    "val46_reproducibility": (lambda s, d: val.reproducible(O(s, d), O(s, d).orderBy(F.desc("o_orderkey"))), "SELECT count(*) AS n_a, count(*) AS n_b, 'identical' AS verdict FROM orders"),
}
