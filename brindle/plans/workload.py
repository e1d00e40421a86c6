"""The twenty acceptance questions, asked of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import product as pa
from brindle.operators import semantic as sem
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def t(name):
    return lambda s, d: table(s, d, name)


O, L, E, C, P = t("orders"), t("lineitem"), t("events"), t("customer"), t("part")
def month():
    return F.date_trunc("month", "o_orderdate").cast("date").alias("month")


def delays(s, d):
    j = L(s, d).join(O(s, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.withColumn("days", F.datediff("l_shipdate", "o_orderdate"))


def sessions(s, d):
    """Sessions of a user, split by gaps of two hours, with their events of interest flagged."""
    w = E(s, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    g = w.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.max((F.col("event_type") == "click").cast("int")).alias("clicked"), F.count("*").alias("n"))
    return g.select("user_id", "bought", "clicked", "n")


SESS = "(SELECT user_id, max((event_type = 'purchase')::INT) AS bought, max((event_type = 'click')::INT) AS clicked, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true)::INT AS g FROM events)) GROUP BY user_id, s)"
DEL = "(SELECT *, l_shipdate::DATE - o_orderdate::DATE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def gaps(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return E(s, d).withColumn("gap", gap).groupBy("event_type").agg(F.count("*").alias("n"), F.count("gap").alias("n_resolved"), F.percentile("gap", 0.5).alias("median_hours"))


def exposed(s, d):
    e = E(s, d)
    first = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("exposed_at"))
    buys = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), "value")
    j = first.join(buys, (F.col("user_id") == F.col("u")) & (F.col("at") >= F.col("exposed_at")) & (F.col("at") < F.lit("2024-01-20").cast("timestamp_ntz")), "left")
    per = j.groupBy("user_id").agg(F.count("at").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"))
    return per.groupBy((F.col("user_id") % 2).alias("variant")).agg(F.count("*").alias("assigned"), F.count_if(F.col("n") > 0).alias("purchasers"), F.try_divide(F.count_if(F.col("n") > 0), F.count("*")).alias("rate"), F.sum("v").alias("value"))


def tenure(s, d):
    per = O(s, d).groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    return per.join(C(s, d), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("days").alias("mean_days"))


QUERIES = {
    "q01_monthly_orders": (lambda s, d: O(s, d).where("o_orderstatus = 'F'").groupBy(month()).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value")), "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "q02_breach_rate": (lambda s, d: rounded(delays(s, d).groupBy(month()).agg(F.count("*").alias("n"), F.count_if(F.col("days") > 60).alias("n_late"), F.try_divide(F.count_if(F.col("days") > 60), F.count("*")).alias("rate"))), f"SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count(*) FILTER (days > 60) AS n_late, round(count(*) FILTER (days > 60) / count(*), 6) AS rate FROM {DEL} GROUP BY 1"),
    "q03_resolution": (lambda s, d: delays(s, d).withColumn("days", F.when(F.col("days") >= 0, F.col("days"))).groupBy(month()).agg(F.count("*").alias("n"), F.count("days").alias("n_resolved"), F.percentile("days", 0.5).alias("median_days")), f"SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count(*) FILTER (days >= 0) AS n_resolved, median(CASE WHEN days >= 0 THEN days END)::DOUBLE AS median_days FROM {DEL} GROUP BY 1"),
    "q04_nps": (lambda s, d: rounded(pa.nps(L(s, d).join(P(s, d), F.col("l_partkey") == F.col("p_partkey")).join(O(s, d), F.col("l_orderkey") == F.col("o_orderkey")).join(C(s, d), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", F.col("p_size") % 11)), "SELECT c_mktsegment, count(*) AS n, round(100.0 * (count(*) FILTER (p_size % 11 >= 9) - count(*) FILTER (p_size % 11 <= 6)) / count(p_size), 6) AS nps FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "q05_session_conversion": (lambda s, d: rounded(sessions(s, d).agg(F.count("*").alias("sessions"), F.sum("bought").alias("purchasing"), F.try_divide(F.sum("bought"), F.count("*")).alias("rate"))), f"SELECT count(*) AS sessions, sum(bought)::BIGINT AS purchasing, round(sum(bought) / count(*), 6) AS rate FROM {SESS}"),
    "q06_value_by_flag": (lambda s, d: rounded(O(s, d).groupBy((F.col("o_orderpriority") == "1-URGENT").alias("urgent")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("value"), F.avg("o_totalprice").alias("mean")), 2), "SELECT o_orderpriority = '1-URGENT' AS urgent, count(*) AS n, round(sum(o_totalprice), 2) AS value, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1"),
    "q07_repeat_rate": (lambda s, d: rounded(O(s, d).groupBy("o_custkey").agg(F.count("*").alias("n")).join(C(s, d), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.try_divide(F.count_if(F.col("n") >= 2), F.count("*")).alias("repeat_rate"))), "SELECT c_mktsegment, count(*) AS customers, round(count(*) FILTER (n >= 2) / count(*), 6) AS repeat_rate FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "q08_gaps_by_type": (lambda s, d: rounded(gaps(s, d)), "SELECT event_type, count(*) AS n, count(gap) AS n_resolved, round(median(gap), 6) AS median_hours FROM (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 3.6e9 AS gap FROM events) GROUP BY 1"),
    "q09_clicked_sessions": (lambda s, d: rounded(sessions(s, d).groupBy("clicked").agg(F.count("*").alias("sessions"), F.avg("bought").alias("rate"))), f"SELECT clicked, count(*) AS sessions, round(avg(bought), 6) AS rate FROM {SESS} GROUP BY 1"),
    "q10_returns": (lambda s, d: rounded(L(s, d).withColumn("win", F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "early").otherwise("late")).groupBy("win").agg(F.count_if(F.col("l_returnflag") == "N").alias("kept"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("returned_value"), F.try_divide(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("share")), 2), "SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS win, count(*) FILTER (l_returnflag = 'N') AS kept, count(*) FILTER (l_returnflag = 'R') AS returned, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS returned_value, round(count(*) FILTER (l_returnflag = 'R') / count(*), 2) AS share FROM lineitem GROUP BY 1"),
    "q11_category_profit": (lambda s, d: rounded(L(s, d).join(P(s, d), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("l_quantity").alias("units"), F.sum("l_extendedprice").alias("value"), F.sum(F.col("p_retailprice") * F.col("l_quantity")).alias("cost"), F.sum(F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity")).alias("profit")).withColumn("margin", F.try_divide("profit", "value")), 2), "SELECT p_type, round(sum(l_quantity), 2) AS units, round(sum(l_extendedprice), 2) AS value, round(sum(p_retailprice * l_quantity), 2) AS cost, round(sum(l_extendedprice - p_retailprice * l_quantity), 2) AS profit, round(sum(l_extendedprice - p_retailprice * l_quantity) / sum(l_extendedprice), 2) AS margin FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "q12_acquisition": (lambda s, d: rounded(sem.join_dimension(O(s, d), C(s, d), {"o_custkey": "c_custkey"}, "inner").groupBy("c_mktsegment").agg(F.count_distinct("o_custkey").alias("purchasers"), F.count("*").alias("orders"), F.sum("o_totalprice").alias("value"), F.avg("o_totalprice").alias("mean")), 2), "SELECT c_mktsegment, count(DISTINCT o_custkey) AS purchasers, count(*) AS orders, round(sum(o_totalprice), 2) AS value, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "q13_unknown_kept": (lambda s, d: rounded(E(s, d).groupBy(F.coalesce(F.when(F.col("user_id") % 7 != 0, F.col("event_type")), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("value") > 20), F.count("*")).alias("high_share"), F.percentile("value", 0.5).alias("median"))), "SELECT CASE WHEN user_id % 7 <> 0 THEN event_type ELSE 'unknown' END AS kind, count(*) AS n, round(count(*) FILTER (value > 20) / count(*), 6) AS high_share, round(median(value), 6) AS median FROM events GROUP BY 1"),
    "q14_weekend": (lambda s, d: rounded(O(s, d).groupBy(F.when(F.dayofweek("o_orderdate").isin(1, 7), "weekend").otherwise("weekday").alias("kind")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 2), "SELECT CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS kind, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1"),
    "q15_new_repeat": (lambda s, d: pa.new_returning(O(s, d).where("o_orderstatus <> 'P'"), "o_custkey", "o_orderdate"), "WITH e AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT month, min(month) OVER (PARTITION BY u) AS fi FROM e) SELECT month, count(*) FILTER (month = fi) AS n_new, count(*) FILTER (month > fi) AS n_returning FROM f GROUP BY 1"),
    "q16_tenure": (lambda s, d: rounded(tenure(s, d)), "SELECT c_mktsegment, count(*) AS n, round(avg(days), 6) AS mean_days FROM (SELECT o_custkey, max(o_orderdate)::DATE - min(o_orderdate)::DATE AS days FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "q17_exp20_exposure": (lambda s, d: rounded(exposed(s, d)), "WITH f AS (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT f.user_id, count(e.ts) AS n, coalesce(sum(e.value), 0) AS v FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.event_type = 'purchase' AND e.ts >= a AND e.ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT user_id % 2 AS variant, count(*) AS assigned, count(*) FILTER (n > 0) AS purchasers, round(count(*) FILTER (n > 0) / count(*), 6) AS rate, round(sum(v), 6) AS value FROM p GROUP BY 1"),
    "q18_status_rate": (lambda s, d: rounded(O(s, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("o_orderstatus") == "P"), F.count("*")).alias("rate"))), "SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS rate FROM orders GROUP BY 1"),
    "q19_funnel": (lambda s, d: pa.funnel(E(s, d), "user_id", "ts", "event_type", ["signup", "view", "purchase"]).select("step", "name", "users"), "WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, min(e.ts) AS t FROM a JOIN events e USING (user_id) WHERE event_type = 'view' AND e.ts >= a.t GROUP BY 1), c AS (SELECT user_id, min(e.ts) AS t FROM b JOIN events e USING (user_id) WHERE event_type = 'purchase' AND e.ts >= b.t GROUP BY 1) SELECT 0 AS step, 'signup' AS name, count(*) AS users FROM a UNION ALL SELECT 1, 'view', count(*) FROM b UNION ALL SELECT 2, 'purchase', count(*) FROM c"),
    "q20_status_mix": (lambda s, d: rounded(O(s, d).groupBy(month()).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice")), 2), "SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS \"O\", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS \"P\" FROM orders GROUP BY 1"),
}
