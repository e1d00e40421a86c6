"""Profiling queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import profiling as prof
from brindle.sources.tables import table


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def changed_snapshot(s, d):
    t = {"orders": table(s, d, "orders"), "part": table(s, d, "part")}
    new = {"orders": t["orders"].drop("o_orderpriority").withColumn("o_orderstatus", F.lit(1)).withColumn("extra", F.lit("x")).where("o_orderkey % 2 = 0"), "part": t["part"]}
    return prof.snapshot(t), prof.snapshot(new)


def _profile_sql(t, nums, texts, others):
    rows = []
    for c, kind in nums.items():
        rows.append(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) FILTER ({c} IS NULL) AS n_null, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, NULL::DOUBLE AS min_length, NULL::DOUBLE AS max_length, NULL::DOUBLE AS mean_length FROM {t}")
    for c in texts:
        rows.append(f"SELECT '{c}', 'string', count(*) FILTER ({c} IS NULL), 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), count(DISTINCT {c}), NULL, NULL, NULL, NULL, min(length({c}))::DOUBLE, max(length({c}))::DOUBLE, round(avg(length({c})), 6) FROM {t}")
    for c, kind in others.items():
        rows.append(f"SELECT '{c}', '{kind}', count(*) FILTER ({c} IS NULL), 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {t}")
    return " UNION ALL ".join(rows)


ORDERS_PROFILE = _profile_sql("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}, ["o_orderstatus", "o_orderpriority"], {"o_orderdate": "timestamp_ntz"})
NUMBERS = ("int", "bigint", "double")
KINDS = {
    t: dict(x.split(":") for x in columns.split())
    for t, columns in {
        "region": "r_regionkey:int r_name:string",
        "nation": "n_nationkey:int n_name:string n_regionkey:int",
        "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
        "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
        "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
        "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
        "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
        "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
        "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
        "embeddings": "vec_id:bigint embedding:array<float> label:int",
        "pages": "page_id:bigint url:string html:string",
        "benchmark": "item_id:bigint text:string",
        "labels": "doc_id:bigint quality:int toxic:int",
        "conversations": "conv_id:bigint turn:bigint role:string text:string",
    }.items()
}
DAILY = "(SELECT ts::DATE AS day, avg(value) AS value FROM events GROUP BY 1)"


def dist_sql(t, c):
    return f"""WITH v AS (SELECT {c}::DOUBLE AS v FROM {t} WHERE {c} IS NOT NULL), s AS (SELECT count(*) AS n, count(DISTINCT v) AS n_unique, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS min, max(v) AS max, skewness(v) AS skew, kurtosis(v) AS kurtosis,
    quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM v)
    SELECT '{c}' AS "column", n, n_unique, round(mean, 6) AS mean, round(sd, 6) AS sd, round(min, 6) AS min, round(max, 6) AS max, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(p1, 6) AS p1, round(p5, 6) AS p5, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p95, 6) AS p95, round(p99, 6) AS p99, round(p75 - p25, 6) AS iqr,
    (SELECT count(*) FROM v WHERE v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS n_outliers,
    CASE WHEN abs(skew) < 0.5 AND kurtosis < -1 THEN 'uniform' WHEN kurtosis > 3 THEN 'heavy_tailed' WHEN skew > 1 THEN 'right_skewed' WHEN skew < -1 THEN 'left_skewed' ELSE 'normal' END AS shape,
    CASE WHEN skew > 1 AND min > 0 THEN 'log' WHEN skew > 1 AND min >= 0 THEN 'sqrt' ELSE 'none' END AS transform FROM s"""


HIST = "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 21))::INT AS bin) b LEFT JOIN (SELECT least(20, floor((value - lo) / (hi - lo) * 20)::INT + 1) AS bin, count(*) AS n FROM events, e GROUP BY 1) USING (bin))"
PEAKS = "SELECT bin, n FROM (SELECT bin, n, coalesce(lag(n) OVER (ORDER BY bin), -1) AS l, coalesce(lead(n) OVER (ORDER BY bin), -1) AS r FROM {}) WHERE n > l AND n > r"

QUERIES = {
    "prf1_column_profile": (lambda s, d: prof.columns_profile(table(s, d, "orders")), ORDERS_PROFILE),
    "prf1_sample_values": (
        lambda s, d: prof.sample_values(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).withColumn("values", F.array_join("values", ",")),
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", array_to_string(list(v ORDER BY v)[1:5], ',') AS values FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM orders WHERE {c} IS NOT NULL)" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")),
    ),
    "prf6_bimodal": (
        lambda s, d: prof.shape_class(table(s, d, "events").select(F.when(F.col("event_id") % 4 == 0, 400 + F.col("value") / 5).otherwise(F.col("value") / 5).alias("x")), "x").select("n_unique", "shape"),
        f"""WITH x AS (SELECT CASE WHEN event_id % 4 = 0 THEN 400 + value / 5 ELSE value / 5 END AS x FROM events), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
        h AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 51))::INT AS bin) b LEFT JOIN (SELECT least(50, floor((x - lo) / (hi - lo) * 50)::INT + 1) AS bin, count(*) AS n FROM x, e GROUP BY 1) USING (bin)),
        sm AS (SELECT bin, avg(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM h), p AS ({PEAKS.format('sm')}), b AS (SELECT count(*) AS n_peaks, min(bin) AS a, max(bin) AS b, min(n) AS lower FROM (SELECT * FROM p ORDER BY n DESC, bin LIMIT 2)),
        t AS (SELECT coalesce(n_peaks = 2 AND (SELECT min(n) FROM sm WHERE bin > a AND bin < b) < 0.6::DOUBLE * lower, false) AS two FROM b), m AS (SELECT count(DISTINCT x) AS u, skewness(x) AS sk, kurtosis(x) AS ku FROM x)
        SELECT u AS n_unique, CASE WHEN abs(sk) < 0.5 AND ku < -1 THEN 'uniform' WHEN ku > 3 THEN 'heavy_tailed' WHEN two THEN 'bimodal' WHEN sk > 1 THEN 'right_skewed' WHEN sk < -1 THEN 'left_skewed' ELSE 'normal' END AS shape FROM m, t""",
    ),
    "prf2_table_profile": (lambda s, d: prof.date_span(table(s, d, "orders"), "orders"), "SELECT 'orders' AS \"table\", count(*) AS n_rows, 1 AS n_date_columns, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders"),
    "prf3_source_profile": (
        lambda s, d: prof.source_profile({t: table(s, d, t) for t in KINDS}),
        " UNION ALL ".join(f"SELECT '{t}' AS \"table\", * FROM ({_profile_sql(t, {c: k for c, k in kinds.items() if k in NUMBERS}, [c for c, k in kinds.items() if k == 'string'], {c: k for c, k in kinds.items() if k not in (*NUMBERS, 'string')})})" for t, kinds in KINDS.items()),
    ),
    "prf4_snapshot_diff": (lambda s, d: prof.snapshot_diff(*changed_snapshot(s, d)), "SELECT * FROM (VALUES ('orders', 'o_orderpriority', 'string', NULL, 'removed', true), ('orders', 'extra', NULL, 'string', 'added', false), ('orders', 'o_orderstatus', 'string', 'int', 'type_changed', false)) v(\"table\", \"column\", old_type, new_type, change, breaking) WHERE (SELECT count(*) FROM orders) > 0"),
    "prf4_row_change": (lambda s, d: prof.row_change(*changed_snapshot(s, d)), "SELECT 'orders' AS \"table\", count(*) AS old_rows, count(*) FILTER (o_orderkey % 2 = 0) AS new_rows, 100.0::DOUBLE * (count(*) FILTER (o_orderkey % 2 = 0) - count(*)) / count(*) AS change_pct FROM orders UNION ALL SELECT 'part', count(*), count(*), 0 FROM part"),
    "prf5_prf6_prf8_distribution": (lambda s, d: rounded(prof.distributions(table(s, d, "events"), ["value"])), dist_sql("events", "value")),
    "prf5_lineitem_price": (lambda s, d: rounded(prof.distributions(table(s, d, "lineitem"), ["l_extendedprice"]), 4), dist_sql("lineitem", "l_extendedprice").replace(", 6)", ", 4)")),
    "prf6_histogram": (lambda s, d: prof.histogram(table(s, d, "events"), "value", 20), f"{HIST} SELECT * FROM h"),
    "prf7_two_peaks": (lambda s, d: prof.two_peaks(prof.histogram(table(s, d, "events"), "value", 20)), f"{HIST}, sm AS (SELECT bin, avg(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM h), p AS ({PEAKS.format('sm')}), b AS (SELECT count(*) AS n_peaks, min(bin) AS a, max(bin) AS b, min(n) AS lower FROM (SELECT * FROM p ORDER BY n DESC, bin LIMIT 2)) SELECT n_peaks, coalesce(n_peaks = 2 AND (SELECT min(n) FROM sm WHERE bin > a AND bin < b) < 0.6::DOUBLE * lower, false) AS bimodal FROM b"),
    "prf9_temporal": (lambda s, d: prof.temporal(table(s, d, "orders"), "o_orderdate"), "WITH x AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), s AS (SELECT min(day) AS lo, max(day) AS hi, count(*) AS present FROM x), m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM s EXCEPT SELECT day FROM x), g AS (SELECT count(*) AS n FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS g FROM m) GROUP BY g) SELECT lo, hi, present, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS missing, (SELECT count(*) FROM g) AS n_gaps, (SELECT coalesce(max(n), 0) FROM g) AS longest_gap, present / (present + (SELECT coalesce(sum(n), 0) FROM g))::DOUBLE AS coverage FROM s"),
    "prf9_weekday_pattern": (lambda s, d: prof.pattern(table(s, d, "events"), "ts", "value", "EEEE"), "SELECT dayname(ts) AS period, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1"),
    "prf10_trend": (lambda s, d: rounded(prof.trend(table(s, d, "events"), "ts", "value")), f"WITH x AS (SELECT value, (row_number() OVER (ORDER BY day) - 1)::DOUBLE AS x FROM {DAILY}), f AS (SELECT count(*) AS n, regr_slope(value, x) AS sl, regr_intercept(value, x) AS ic, avg(value) AS m FROM x), r AS (SELECT stddev_pop(value - ic - sl * x) AS rs FROM x, f) SELECT n, round(sl / abs(m), 6) AS relative, round(rs / abs(m), 6) AS cv, CASE WHEN n < 5 THEN 'unknown' WHEN rs / abs(m) > 0.5 THEN 'volatile' WHEN sl / abs(m) > 0.01 THEN 'up' WHEN sl / abs(m) < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM f, r"),
    "prf11_seasonality": (lambda s, d: rounded(prof.seasonality(table(s, d, "orders"), "o_orderdate", "o_totalprice")), "WITH m AS (SELECT month(o_orderdate), avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT count(*) AS n_months, round(stddev_pop(v) / avg(v), 6) AS cv, count(*) >= 3 AND stddev_pop(v) / avg(v) > 0.2 AS seasonal FROM m"),
    "prf12_correlations": (lambda s, d: rounded(prof.correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.5)), "WITH r AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem) SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM r WHERE abs(r) >= 0.5"),
    "prf13_completeness": (lambda s, d: prof.completeness(table(s, d, "lineitem").select("l_discount", "l_returnflag", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_partkey")).alias("holes"))), "SELECT 'l_discount' AS \"column\", count(*) AS n, count(*) FILTER (l_discount IS NULL) AS n_null, count(*) FILTER (l_discount = 0) AS n_zero, 0::BIGINT AS n_blank, false AS constant, 'complete' AS band FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), 0, 0, count(*) FILTER (trim(l_returnflag) = ''), false, 'complete' FROM lineitem UNION ALL SELECT 'holes', count(*), count(*) FILTER (l_orderkey % 10 = 0), count(*) FILTER (l_orderkey % 10 <> 0 AND l_partkey = 0), 0, false, CASE WHEN count(*) FILTER (l_orderkey % 10 = 0) / count(*) < 0.05 THEN 'minor' ELSE 'major' END FROM lineitem"),
    "prf14_win1_anomalies": (lambda s, d: rounded(prof.anomalies(table(s, d, "events").withColumn("one", F.lit(1.0)), "ts", ["value", "one"], 14, 0.1), 4), "WITH r AS (SELECT ts::DATE AS day, 'value' AS metric, sum(value) AS value FROM events GROUP BY 1 UNION ALL SELECT ts::DATE, 'one', count(*)::DOUBLE FROM events GROUP BY 1), w AS (SELECT *, CASE WHEN count(value) OVER x >= 3 THEN avg(value) OVER x END AS mean, CASE WHEN count(value) OVER x >= 3 THEN stddev_samp(value) OVER x END AS sd FROM r WINDOW x AS (PARTITION BY metric ORDER BY day ROWS 13 PRECEDING)) SELECT day, metric, round(value, 4) AS value, round(mean, 4) AS mean, round(sd, 4) AS sd, round((value - mean) / abs(mean), 4) AS deviation FROM w WHERE mean <> 0 AND abs((value - mean) / abs(mean)) > 0.1"),
    "prf15_modality": (lambda s, d: prof.peaks(prof.histogram(table(s, d, "events"), "value", 20)), f"{HIST} {PEAKS.format('h')}"),
    "prf17_schema_checksum": (lambda s, d: s.createDataFrame([(t, prof.schema_checksum(table(s, d, t))) for t in ("orders", "part")], "table string, checksum string").join(prof.snapshot({t: table(s, d, t) for t in ("orders", "part")}).groupBy("table").agg(F.max("n_rows").alias("n_rows")), "table"), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", substr(sha256('{','.join(sorted(f'{c}:{k}' for c, k in KINDS[t].items()))}'), 1, 16) AS checksum, count(*) AS n_rows FROM {t}" for t in ("orders", "part"))),
    "prf18_schema_drift": (lambda s, d: prof.drift(s, {t: table(s, d, t) for t in ("orders", "part")}, {"orders": "0" * 16, "part": prof.schema_checksum(table(s, d, "part"))}).select("table", "quarantined").join(prof.snapshot({t: table(s, d, t) for t in ("orders", "part")}).groupBy("table").agg(F.max("n_rows").alias("n_rows")), "table"), "SELECT 'orders' AS \"table\", true AS quarantined, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', false, count(*) FROM part"),
    "win8_missing_date_islands": (lambda s, d: prof.islands(table(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderdate").cast("date").alias("day")).distinct()), "SELECT min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS g FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_totalprice > 300000)) GROUP BY g"),
}
