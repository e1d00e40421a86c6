"""Queries of the semantic layer, sources and projections on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import semantic as sem
from brindle.operators import sets
from brindle.operators.ordering import one_row
from brindle.sources import tables as src
from brindle.sources.tables import table

ORDER_VALUE = sem.Metric(
    "round(sum(o_totalprice), 2)",
    dimensions={"status": "o_orderstatus", "year": "year(o_orderdate)", "priority": "o_orderpriority"},
    filters={"completed": "o_orderstatus = 'F'", "large": "o_totalprice > 100000"},
    grain=("o_orderkey",),
)
URGENT_RATE = sem.Metric("count_if(o_orderpriority = '1-URGENT')", dimensions=ORDER_VALUE.dimensions, filters=ORDER_VALUE.filters, denominator="count(*)", grain=("o_orderkey",))


def life(s, d):
    """Lifecycle rows from events: a signup opens and an error closes a user's span."""
    e = table(s, d, "events").where(F.col("event_type").isin("signup", "error"))
    return e.select(F.col("user_id"), F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("role"), "ts")


def flag_by_status(s, d):
    returned = table(s, d, "lineitem").where("l_returnflag = 'R'")
    flagged = sem.related_flag(table(s, d, "orders"), returned, {"o_orderkey": "l_orderkey"}, "has_return")
    return flagged.groupBy("o_orderstatus", "has_return").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))


def interval_counts(s, d):
    flagged = sem.interval_flag(table(s, d, "events"), sem.intervals(life(s, d), "user_id", "role", "ts"), "user_id", "ts")
    return flagged.groupBy("event_type", "inside").agg(F.count("*").alias("n"))


def retention(s, d):
    return sem.first_return(table(s, d, "orders"), "o_custkey", "o_orderdate", ("1995-01-01", "1995-07-01"), ("1995-07-01", "1996-01-01"))


def presented(s, d):
    m = ORDER_VALUE.compile(table(s, d, "orders"), ["status", "year"])
    return sem.present(m, {"order_status": ("status", None), "order_year": ("year", None), "value_rounded": ("value", 0)}, ["order_status", "order_year"])


def presented_gap(s, d):
    m = ORDER_VALUE.compile(table(s, d, "orders"), ["status", "year"])
    p = sem.present(m, {"status": ("status", None), "year": ("year", None), "value": ("value", 0)})
    return sem.multiset_difference(m.withColumn("value", F.round("value", 0)), p).agg(F.count("*").alias("n_different"))


def predicates(s, d):
    bound = sem.bind({"least": {"type": "decimal", "min": 0}, "status": {"type": "string", "allowed": ["F", "O", "P"]}}, {"least": 150000.0, "status": "F"})
    o = table(s, d, "orders").where(sem.predicate([("o_totalprice", ">=", bound["least"]), ("o_orderstatus", "=", bound["status"])]))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def role_filtered(s, d):
    return table(s, d, "events").where(sem.role_filter([("event_type", "in", ["view", "click"])])).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def expression(s, d):
    e = "CASE WHEN coalesce(nullif(l_discount, 0), 0) = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END"
    return table(s, d, "lineitem").groupBy(F.expr(e).alias("band")).agg(F.count("*").alias("n"), F.round(F.sum(F.expr("round(l_extendedprice * greatest(1 - l_discount, 0), 4)")), 2).alias("net"))


def numbers(s, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit("%"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("k")))
    raw = raw.when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.col("p_size").cast("string"), F.lit(" million"))).otherwise(F.col("p_type"))
    value, unit, status = scalars.parse_number(F.col("raw"))
    return table(s, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.round(value, 6).alias("value"), unit.alias("unit"), status.alias("status"))


def tolerance(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", scalars.within(F.col("l_extendedprice"), F.col("l_quantity") * 1000, absolute=100.0, relative=0.1).alias("ok"))
    return li.groupBy("l_returnflag").agg(F.count_if("ok").alias("n_within"), F.count("*").alias("n"))


def winsorised(s, d):
    e = table(s, d, "events").select("event_type", "value")
    cut = one_row(e, {"value": F.col("value")}, {"low": 0.01, "high": 0.99}).toDF("low", "high")
    w = e.crossJoin(F.broadcast(cut)).select("event_type", F.greatest(F.least("value", "high"), "low").alias("w"))  # one row
    return w.groupBy("event_type").agg(F.round(F.avg("w"), 6).alias("mean_w"), F.round(F.min("w"), 6).alias("min_w"), F.round(F.max("w"), 6).alias("max_w"))


def decomposition(s, d):
    return sets.grouping_sets(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("total", F.round("total", 2))


def dates(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.round(scalars.date_diff("week", F.lit("1995-01-01").cast("timestamp"), F.col("o_orderdate")), 6).alias("weeks"), F.date_format("o_orderdate", "EEEE").alias("weekday"), F.month("o_orderdate").alias("month_no"), scalars.parse_yyyymmdd(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("day"))


def lenient_dates(s, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(s, d, "orders").select(F.col("o_orderkey"), scalars.parse_date(raw).alias("day"))


def checksums(s, d):
    return table(s, d, "nation").select("n_nationkey", scalars.row_checksum(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("checksum"))


def strings(s, d):
    p = table(s, d, "part")
    return p.groupBy("p_brand").agg(F.min(F.length("p_name")).alias("shortest"), F.max(F.length("p_name")).alias("longest"), F.round(F.avg(F.length("p_name")), 4).alias("mean_length"), F.count_if(F.trim("p_name") == "").alias("blank"))


def joined_names(s, d):
    return table(s, d, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"))


def parameterised(s, d):
    table(s, d, "orders").createOrReplaceTempView("brindle_orders")
    return src.query(s, "SELECT o_orderstatus, count(*) AS n FROM brindle_orders WHERE o_totalprice > ? AND o_orderpriority = ? GROUP BY o_orderstatus", 100000.0, "1-URGENT")


def set_operations(s, d):
    o, l = table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n("union_all", o.unionByName(l)).unionAll(n("union", o.union(l).distinct())).unionAll(n("intersect", o.intersect(l))).unionAll(n("except", o.exceptAll(l)))


def tagged(s, d):
    a = s.createDataFrame([("the of", "pair"), ("the", "article"), ("of-the", "pair2"), ("and the of", "triple"), ("and, the of the", "four")], "alias string, entity string")
    return sets.alias_tags(table(s, d, "documents"), a).groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


LIFE = "(SELECT user_id, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS role, ts FROM events WHERE event_type IN ('signup', 'error'))"
SPANS = f"(SELECT * FROM (SELECT user_id, min(CASE WHEN role = 'start' THEN ts END) AS a, min(CASE WHEN role = 'end' THEN ts END) AS b FROM {LIFE} GROUP BY 1) WHERE a IS NOT NULL)"

SOURCE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: the pairs that the name rules give for the test tables
KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey", 0.8),
    ("customer", "c_nationkey", "nation", "n_nationkey", 0.8),
    ("supplier", "s_nationkey", "nation", "n_nationkey", 0.8),
    ("orders", "o_custkey", "customer", "c_custkey", 0.8),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", 0.8),
    ("lineitem", "l_partkey", "part", "p_partkey", 0.8),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", 0.8),
    ("labels", "doc_id", "documents", "doc_id", 0.5),
]

QUERIES = {
    "agg1_declared_metric": (lambda s, d: ORDER_VALUE.compile(table(s, d, "orders"), ["status", "year"], ["large"]), "SELECT o_orderstatus AS status, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_totalprice > 100000 GROUP BY ALL"),
    "agg2_ratio_metric": (lambda s, d: URGENT_RATE.compile(table(s, d, "orders"), ["year"]), "SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderpriority = '1-URGENT') / nullif(count(*), 0) AS value FROM orders GROUP BY 1"),
    "agg2_out_of_bounds": (lambda s, d: URGENT_RATE.out_of_bounds(URGENT_RATE.compile(table(s, d, "orders"), ["year"])).agg(F.count("*").alias("n_outside")), "SELECT count(*) AS n_outside FROM (SELECT count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS v FROM orders GROUP BY year(o_orderdate)) WHERE v < 0 OR v > 1"),
    "agg3_fanout_guard": (lambda s, d: sem.Metric("count(*)", grain=("l_orderkey", "l_linenumber")).fanout(table(s, d, "lineitem")), "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS ok FROM lineitem"),
    "agg4_multi_measure": (lambda s, d: sem.multi_measure(table(s, d, "lineitem"), ["l_returnflag"], {"n": "count(*)", "least": "min(l_quantity)", "most": "max(l_quantity)", "late": "sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)"}, {"late_pct": ("late", "n", 100.0)}), "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS late, 100.0::DOUBLE * (sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0)) AS late_pct FROM lineitem GROUP BY 1"),
    "agg5_grain_checks": (lambda s, d: sem.grain_checks(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT 'duplicate_grain' AS \"check\", count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'null_grain', count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL"),
    "agg6_output_contract": (lambda s, d: sem.retention_contract(sem.output_contract(retention(s, d), ["eligible", "returning", "pct"])), "WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS f, max((o_orderdate::DATE >= DATE '1995-07-01' AND o_orderdate::DATE < DATE '1996-01-01')::INT) AS b FROM orders GROUP BY 1) SELECT count(*) AS eligible, coalesce(sum(b), 0)::BIGINT AS returning, 100.0::DOUBLE * sum(b) / nullif(count(*), 0) AS pct FROM f WHERE f >= DATE '1995-01-01' AND f < DATE '1995-07-01'"),
    "agg7_table_summary": (lambda s, d: sets.table_summary(table(s, d, "orders"), "o_totalprice", "o_orderdate"), "SELECT count(*) AS n_rows, count(*) FILTER (o_totalprice IS NULL) AS n_null, round(sum(o_totalprice), 2) AS total, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders"),
    "agg8_count_distinct": (lambda s, d: sets.count_distinct(table(s, d, "lineitem"), "l_partkey").select("exact", F.expr("abs(approximate - exact) <= 0.06 * exact").alias("approx_close")).withColumnRenamed("exact", "parts"), "SELECT count(DISTINCT l_partkey) AS parts, true AS approx_close FROM lineitem"),
    "agg9_string_agg": (joined_names, "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "agg10_segment_profile": (lambda s, d: sem.present(sets.segment_profile(table(s, d, "events"), "event_type", "value"), {"event_type": ("event_type", None), "n": ("n", None), "share": ("share", 9), "mean": ("mean", 6), "index": ("index", 6), "gap": ("gap", None), "small": ("small", None)}), "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, round(avg(value), 6) AS mean, round(avg(value) / (sum(sum(value)) OVER () / sum(count(value)) OVER ()), 6) AS index, abs(avg(value) / (sum(sum(value)) OVER () / sum(count(value)) OVER ()) - 1) > 0.2 AS gap, count(*) < 100 AS small FROM events GROUP BY 1"),
    "agg11_weighted_mean": (lambda s, d: sets.weighted_mean_gap(table(s, d, "lineitem"), "l_discount", "l_quantity", "l_returnflag").select(F.round("weighted", 8).alias("weighted"), F.round("unweighted", 8).alias("unweighted"), "differs"), "WITH o AS (SELECT * FROM lineitem WHERE l_quantity > 0), w AS (SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS w FROM o), u AS (SELECT avg(m) AS u FROM (SELECT avg(l_discount) AS m FROM o GROUP BY l_returnflag)) SELECT round(w, 8) AS weighted, round(u, 8) AS unweighted, abs(w - u) > 0.01 * greatest(abs(w), abs(u)) AS differs FROM w, u"),
    "agg12_top_values": (lambda s, d: sets.top_values(table(s, d, "part"), ["p_brand", "p_type"], 10), "WITH r AS (SELECT 'p_brand' AS \"column\", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), c AS (SELECT \"column\", value, count(*) AS n FROM r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)::INT AS rank FROM c QUALIFY rank <= 10"),
    "agg13_plausible_values": (lambda s, d: ORDER_VALUE.compile(table(s, d, "orders"), ["year"]).withColumn("mean", F.avg("value").over(Window.partitionBy())).select("year", F.when(~F.col("value").between(0, 1e12), "FAIL").when(F.abs(F.col("value") - F.col("mean")) > 0.5 * F.abs("mean"), "WARN").otherwise("PASS").alias("status")), "WITH m AS (SELECT year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) SELECT year, CASE WHEN v < 0 OR v > 1e12 THEN 'FAIL' WHEN abs(v - avg(v) OVER ()) > 0.5 * abs(avg(v) OVER ()) THEN 'WARN' ELSE 'PASS' END AS status FROM m"),
    "agg14_decomposition": (decomposition, "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))"),
    "win3_share_of_total": (lambda s, d: ORDER_VALUE.share(table(s, d, "orders"), ["priority"]).withColumn("value", F.round("value", 9)), "SELECT o_orderpriority AS priority, round(round(sum(o_totalprice), 2) / sum(round(sum(o_totalprice), 2)) OVER (), 9) AS value FROM orders GROUP BY 1"),
    "prj1_expression": (expression, "SELECT CASE WHEN coalesce(nullif(l_discount, 0), 0) = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' ELSE 'high' END AS band, count(*) AS n, round(sum(round(l_extendedprice * greatest(1 - l_discount, 0), 4)), 2) AS net FROM lineitem GROUP BY 1"),
    "prj2_prj3_bound_predicates": (predicates, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 150000.0 AND o_orderstatus = 'F' GROUP BY 1"),
    "prj4_role_filter": (role_filtered, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"),
    "prj5_presentation": (presented, "SELECT o_orderstatus AS order_status, year(o_orderdate)::INT AS order_year, round(round(sum(o_totalprice), 2), 0) AS value_rounded FROM orders GROUP BY ALL"),
    "prj6_presented_rows": (presented_gap, "SELECT 0::BIGINT AS n_different FROM (SELECT count(*) FROM orders)"),
    "prj7_winsorise": (winsorised, "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events), w AS (SELECT event_type, greatest(least(value, b), a) AS w FROM events, q) SELECT event_type, round(avg(w), 6) AS mean_w, round(min(w), 6) AS min_w, round(max(w), 6) AS max_w FROM w GROUP BY 1"),
    "prj8_parse_numbers": (numbers, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round(p_size * 0.01::DOUBLE, 6) WHEN 1 THEN p_size * 1e3 WHEN 2 THEN -p_size::DOUBLE WHEN 3 THEN p_size * 1e6 END AS value, CASE p_partkey % 5 WHEN 0 THEN 'rate' WHEN 1 THEN 'currency' WHEN 2 THEN 'number' WHEN 3 THEN 'number' END AS unit, CASE WHEN p_partkey % 5 < 4 THEN 'parsed' ELSE 'unparsed' END AS status FROM part"),
    "prj9_tolerance": (tolerance, "SELECT l_returnflag, count(*) FILTER (abs(l_extendedprice - l_quantity * 1000) <= greatest(100.0, 0.1::DOUBLE * abs(l_quantity * 1000))) AS n_within, count(*) AS n FROM lineitem GROUP BY 1"),
    "joi1_dimension_join": (lambda s, d: sem.join_dimension(table(s, d, "orders"), table(s, d, "customer"), {"o_custkey": "c_custkey"}).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value")), "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "joi2_unmatched": (lambda s, d: sem.unmatched(table(s, d, "orders"), table(s, d, "customer").where("c_custkey % 10 <> 0"), {"o_custkey": "c_custkey"}), "SELECT count(*) AS n_unmatched FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"),
    "joi3_related_flag": (flag_by_status, "SELECT o_orderstatus, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))::INT AS has_return, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL"),
    "joi4_interval_flag": (interval_counts, f"SELECT event_type, coalesce(ts >= a AND (b IS NULL OR ts < b), false)::INT AS inside, count(*) AS n FROM events LEFT JOIN {SPANS} s USING (user_id) GROUP BY ALL"),
    "joi4_interval_checks": (lambda s, d: sem.interval_checks(life(s, d), "user_id", "role", "ts"), f"WITH p AS (SELECT user_id, count(*) FILTER (role = 'start') AS s, count(*) FILTER (role = 'end') AS e, min(CASE WHEN role = 'start' THEN ts END) AS a, min(CASE WHEN role = 'end' THEN ts END) AS b FROM {LIFE} WHERE user_id IS NOT NULL GROUP BY 1) SELECT 'many_starts' AS \"check\", count(*) FILTER (s > 1) AS n FROM p UNION ALL SELECT 'many_ends', count(*) FILTER (e > 1) FROM p UNION ALL SELECT 'unpaired_end', count(*) FILTER (s = 0) FROM p UNION ALL SELECT 'open_start', count(*) FILTER (e = 0) FROM p UNION ALL SELECT 'inverted', count(*) FILTER (b < a) FROM p UNION ALL SELECT 'null_id', count(*) FROM {LIFE} WHERE user_id IS NULL"),
    "joi5_unpaired": (lambda s, d: sem.unpaired(life(s, d).where("role = 'start'"), life(s, d).where("role = 'end'"), "user_id"), f"SELECT user_id, CASE WHEN bool_or(role = 'start') THEN 'start' ELSE 'end' END AS only FROM {LIFE} GROUP BY 1 HAVING count(DISTINCT role) = 1"),
    "joi6_first_return": (retention, "WITH f AS (SELECT o_custkey, min(o_orderdate)::DATE AS f, max((o_orderdate::DATE >= DATE '1995-07-01' AND o_orderdate::DATE < DATE '1996-01-01')::INT) AS b FROM orders GROUP BY 1) SELECT count(*) AS eligible, coalesce(sum(b), 0)::BIGINT AS returning, 100.0::DOUBLE * sum(b) / nullif(count(*), 0) AS pct FROM f WHERE f >= DATE '1995-01-01' AND f < DATE '1995-07-01'"),
    "joi8_cardinality": (lambda s, d: sets.cardinality(table(s, d, "orders"), table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))), "SELECT (SELECT count(*) FROM orders) AS n_before, count(*) AS n_after, count(*) / (SELECT count(*) FROM orders) AS ratio, CASE WHEN count(*) / (SELECT count(*) FROM orders) > 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "joi9_detail_summary": (lambda s, d: sets.detail_against_summary(table(s, d, "orders").withColumn("v", F.round("o_totalprice", 2)), table(s, d, "orders").groupBy("o_orderpriority").agg((F.sum("o_totalprice") * F.when(F.col("o_orderpriority") == "1-URGENT", 1.1).otherwise(1.0)).alias("v")), "o_orderpriority", "v").select("o_orderpriority", F.round("detail", 1).alias("detail"), F.round("summary", 1).alias("summary"), "status"), "SELECT o_orderpriority, round(sum(round(o_totalprice, 2)), 1) AS detail, round(sum(o_totalprice) * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.1::DOUBLE ELSE 1.0 END, 1) AS summary, CASE WHEN o_orderpriority = '1-URGENT' THEN 'differs' ELSE 'equal' END AS status FROM orders GROUP BY 1"),
    "joi11_foreign_keys": (
        lambda s, d: sets.foreign_keys({t: table(s, d, t) for t in SOURCE}).withColumn("confidence", F.round("confidence", 6)),
        " UNION ALL ".join(
            f"""SELECT '{a}' AS from_table, '{x}' AS from_column, '{b}' AS to_table, '{y}' AS to_column, round(CASE WHEN shared > 0 THEN least(1.0, ({name}::DOUBLE + shared / f) / 2 + 0.1) ELSE {name}::DOUBLE END, 6) AS confidence,
            CASE WHEN shared > 0 THEN 'both' ELSE 'name_match' END AS method, f > 0 AND t > 0 AND f > 0.9 * t AS one_to_one
            FROM (SELECT (SELECT count(DISTINCT {x}) FROM {a}) AS f, (SELECT count(DISTINCT {y}) FROM {b}) AS t, (SELECT count(DISTINCT {x}) FROM {a} WHERE {x} IN (SELECT {y} FROM {b})) AS shared)"""
            for a, x, b, y, name in KEYS
        ),
    ),
    "joi12_calendar_join": (lambda s, d: table(s, d, "orders").groupBy(F.dayofweek("o_orderdate").isin(1, 7).alias("weekend")).agg(F.count("*").alias("n")), "SELECT dayofweek(o_orderdate) IN (0, 6) AS weekend, count(*) AS n FROM orders GROUP BY 1"),
    "joi13_alias_tags": (tagged, None),
    "fn1_fn2_fn6_fn9_dates": (dates, "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / (1e6 * 604800), 6) AS weeks, dayname(o_orderdate) AS weekday, month(o_orderdate)::INT AS month_no, o_orderdate::DATE AS day FROM orders"),
    "fn3_safe_divide": (lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(scalars.safe_divide(F.col("l_tax"), F.col("l_discount")).isNull()).alias("n_null")), "SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS n_null FROM lineitem GROUP BY 1"),
    "fn4_row_checksum": (checksums, "SELECT n_nationkey, md5(concat_ws(chr(31), n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS checksum FROM nation"),
    "fn7_lenient_dates": (lenient_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS day FROM orders"),
    "fn8_string_stats": (strings, "SELECT p_brand, min(length(p_name))::INT AS shortest, max(length(p_name))::INT AS longest, round(avg(length(p_name)), 4) AS mean_length, count(*) FILTER (trim(p_name) = '') AS blank FROM part GROUP BY 1"),
    "src6_whole_table": (lambda s, d: table(s, d, "region"), "SELECT * FROM region"),
    "src7_parameterised_query": (parameterised, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    "src9_inventory": (lambda s, d: src.inventory(table(s, d, "lineitem")).select("n_rows").agg(F.sum("n_rows").alias("n_rows")), "SELECT count(*) AS n_rows FROM lineitem"),
    "src10_row_sample": (lambda s, d: src.sample_rows(table(s, d, "customer"), ["c_custkey"], 20), None),
    "snk1_result_digest": (lambda s, d: src.result_digest(table(s, d, "orders")), None),
    "set1_set_operations": (set_operations, "SELECT 'union_all' AS op, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n UNION ALL SELECT 'union', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)"),
    "set2_value_sets": (lambda s, d: sets.value_sets(table(s, d, "orders"), "o_orderstatus", ["F", "O", "X"]), "SELECT coalesce(v, w) AS value, CASE WHEN w IS NULL THEN 'unexpected' ELSE 'missing' END AS status FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) FULL JOIN (SELECT unnest(['F', 'O', 'X']) AS w) ON v = w WHERE v IS NULL OR w IS NULL"),
    "set3_segment_coverage": (lambda s, d: sets.value_sets(table(s, d, "customer"), "c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY", "NAVAL"]), "SELECT coalesce(v, w) AS value, CASE WHEN w IS NULL THEN 'unexpected' ELSE 'missing' END AS status FROM (SELECT DISTINCT c_mktsegment AS v FROM customer) FULL JOIN (SELECT unnest(['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'NAVAL']) AS w) ON v = w WHERE v IS NULL OR w IS NULL"),
    "srt1_ordered": (lambda s, d: table(s, d, "nation").select("n_regionkey", "n_name").orderBy("n_regionkey", "n_name"), "SELECT n_regionkey, n_name FROM nation ORDER BY ALL"),
    "srt2_row_cap": (lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
}
