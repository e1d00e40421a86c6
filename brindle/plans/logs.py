"""Log and run-comparison queries on logs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import logs as lo
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


SOURCE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def entries(s, d):
    """A query log: one entry an event."""
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("query_id"), F.col("ts").alias("at"), F.col("user_id").alias("by"), F.col("value"), F.to_date("ts").alias("bucket"))


def claims(s, d):
    """Claims: every seventh event restated; some cite a query, some a wrong id, some a changed value."""
    e = entries(s, d).where("query_id % 7 = 0")
    cited = F.when(F.col("query_id") % 3 == 0, F.array("query_id")).when(F.col("query_id") % 3 == 1, F.array(F.col("query_id") + F.lit(10**9))).otherwise(F.array().cast("array<bigint>"))
    return e.select((F.col("query_id") + 1).alias("claim_id"), (F.col("value") * F.when(F.col("query_id") % 5 == 0, 1000.0).otherwise(1.0)).alias("value"), cited.alias("cited"), "bucket", "by", "at")


def trials(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("question"), F.round("l_discount", 2).alias("v"))


def edges(s, d):
    """A lineage: nation n was made from nation n div 2 and its region."""
    n = table(s, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.expr("n_nationkey div 2"), F.col("n_regionkey") + 1000)).alias("parent")).where("id <> parent")


def run(s, d, shift):
    o = table(s, d, "orders")
    return o.where(f"o_orderkey % 11 <> {shift}").select(F.col("o_orderkey").alias("case_id"), ((F.col("o_orderkey") + shift) % 5 > 0).alias("passed"), (F.col("o_totalprice") / 1000 + shift).alias("latency"), F.when(F.col("o_orderkey") % 4 > 0, F.lit(1.0 + shift)).alias("cost"))


ENT = "(SELECT event_id AS query_id, ts AS tm, user_id AS usr, value, ts::DATE AS bucket FROM events)"
CLM = f"(SELECT query_id + 1 AS claim_id, query_id AS q, value * CASE WHEN query_id % 5 = 0 THEN 1000 ELSE 1 END AS value, bucket, usr, tm FROM {ENT} WHERE query_id % 7 = 0)"
MAT = f"m AS (SELECT claim_id, usr, tm, CASE WHEN q % 3 = 0 THEN q END AS cited, (SELECT min(query_id) FROM {ENT} e WHERE e.bucket = c.bucket AND abs(e.value - c.value) <= 0.001::DOUBLE * abs(c.value)) AS near FROM {CLM} c), r AS (SELECT claim_id, usr, tm, coalesce(cited, near) AS query_id, CASE WHEN cited IS NOT NULL THEN 'cited' WHEN near IS NOT NULL THEN 'value' END AS how FROM m)"
REC = f"{MAT}, x AS (SELECT claim_id, coalesce(query_id, (SELECT arg_max(query_id, (tm, query_id)) FROM {ENT} e WHERE e.usr = r.usr AND e.tm <= r.tm)) AS query_id, CASE WHEN query_id IS NULL THEN 'latest' ELSE how END AS how FROM r)"
TRI = "(SELECT l_orderkey % 50 AS question, round(l_discount, 2) AS v FROM lineitem)"


def reconciled(s, d):
    return lo.reconcile(claims(s, d), entries(s, d))


QUERIES = {
    "log1_match_claims": (lambda s, d: lo.match_claims(entries(s, d), claims(s, d)).fillna({"query_id": -1}), f"WITH {MAT} SELECT claim_id, coalesce(query_id, -1) AS query_id, how FROM r"),
    "log2_coverage": (lambda s, d: rounded(lo.coverage(lo.match_claims(entries(s, d), claims(s, d)))), f"WITH {MAT} SELECT count(*) AS n, count(query_id) AS n_matched, round(count(query_id) / count(*), 6) AS coverage, CASE WHEN count(query_id) / count(*) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status FROM r"),
    "log3_reconcile": (reconciled, f"WITH {REC} SELECT claim_id, query_id, how FROM x"),
    "log3_unused_queries": (lambda s, d: lo.unused(entries(s, d), reconciled(s, d)).groupBy("bucket").agg(F.count("*").alias("n")), f"WITH {REC} SELECT bucket, count(*) AS n FROM {ENT} WHERE query_id NOT IN (SELECT query_id FROM x) GROUP BY 1"),
    "log4_lineage": (lambda s, d: lo.ancestors(edges(s, d), table(s, d, "nation").where("n_nationkey >= 20").select(F.col("n_nationkey").alias("id"))).select("root", F.col("id").cast("long").alias("id"), "depth"), "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS id, unnest([n_nationkey // 2, n_regionkey + 1000])::BIGINT AS parent FROM nation), w AS (SELECT n_nationkey AS root, n_nationkey::BIGINT AS id, 0 AS depth FROM nation WHERE n_nationkey >= 20 UNION SELECT root, parent, depth + 1 FROM w JOIN e USING (id) WHERE e.id <> e.parent) SELECT root, id, min(depth)::INT AS depth FROM w GROUP BY 1, 2"),
    "log5_miss_rate": (lambda s, d: rounded(lo.miss_rate(table(s, d, "events"), "ts", "event_type", "2024-01-25", 7)), "SELECT event_type, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25') AS recent, round(count(*) FILTER (ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25') / 7, 6) AS per_day FROM events GROUP BY 1"),
    "log6_fingerprint": (lambda s, d: lo.fingerprint(table(s, d, "customer")), None),
    "log7_reliability": (lambda s, d: rounded(lo.reliability(trials(s, d), "question", "v", 0.02)), f"WITH c AS (SELECT question, v, count(*) AS c FROM {TRI} GROUP BY 1, 2), m AS (SELECT question, max(c) AS modal, count(*) AS k FROM c GROUP BY 1), d AS (SELECT question, median(v) AS med, count(v) AS n, stddev_pop(v) AS sd FROM {TRI} GROUP BY 1), w AS (SELECT question, count(*) FILTER (abs(v - med) <= greatest(0.02::DOUBLE, 0.01::DOUBLE * abs(med))) AS nn FROM {TRI} JOIN d USING (question) GROUP BY 1) SELECT question, n, round(med, 6) AS median, round(sd, 6) AS sd, round(modal / n, 6) AS exact_share, round(nn / n, 6) AS near_share, CASE WHEN n < 2 THEN 'unknown' WHEN k = 1 THEN 'exactly_stable' WHEN nn = n THEN 'stable_within_tolerance' ELSE 'variable' END AS verdict FROM d JOIN m USING (question) JOIN w USING (question)"),
    "log8_grade_numeric": (lambda s, d: lo.grade_numeric(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("observed")), table(s, d, "part").where("p_partkey % 9 > 0").select("p_partkey", (F.col("p_retailprice") * F.when(F.col("p_partkey") % 2 == 0, 1.0005).otherwise(1.5)).alias("expected"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_retailprice"))).alias("alternatives")), "p_partkey", 0.01, 0.001).groupBy("grade").agg(F.count("*").alias("n")), "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS grade, count(*) AS n FROM part GROUP BY 1"),
    "log9_grade_exact": (lambda s, d: lo.grade_exact(table(s, d, "nation").select("n_nationkey", F.upper("n_name").alias("observed")), table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 > 0, F.lower("n_name")).otherwise("x").alias("expected")), "n_nationkey"), "SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN 'pass' ELSE 'fail' END AS grade FROM nation"),
    "log10_grade_fields": (lambda s, d: table(s, d, "events").select(lo.grade_fields("props", ["k"], ["z"]).alias("grade")).groupBy("grade").agg(F.count("*").alias("n")), "SELECT CASE WHEN json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.z') IS NULL THEN 'pass' ELSE 'fail' END AS grade, count(*) AS n FROM events GROUP BY 1"),
    "log11_compare_tables": (lambda s, d: lo.compare_tables(table(s, d, "customer").where("c_custkey % 13 <> 0"), table(s, d, "customer").where("c_custkey % 17 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1.0).otherwise(0.0)), ["c_custkey"]), "SELECT 'only_left' AS what, count(*) FILTER (c_custkey % 13 <> 0 AND c_custkey % 17 = 0) AS n FROM customer UNION ALL SELECT 'only_right', count(*) FILTER (c_custkey % 13 = 0 AND c_custkey % 17 <> 0) FROM customer UNION ALL SELECT 'c_name', 0 FROM customer GROUP BY 1 UNION ALL SELECT 'c_nationkey', 0 FROM customer GROUP BY 1 UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 10 = 0) FROM customer UNION ALL SELECT 'c_mktsegment', 0 FROM customer GROUP BY 1"),
    "log11b_dataset_fingerprint": (lambda s, d: lo.dataset_fingerprint({t: table(s, d, t) for t in SOURCE}), "SELECT sha256(" + " || ';' || ".join(f"'{t}=' || (SELECT count(*) FROM {t})" for t in sorted(SOURCE)) + ") AS fingerprint"),
    "log13_alignment": (lambda s, d: rounded(lo.alignment(table(s, d, "labels").select(F.col("quality").alias("human"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("grader")), "human", "grader")), "WITH g AS (SELECT quality AS human, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS grader, count(*) AS n FROM labels GROUP BY 1, 2) SELECT human, grader, n, round(sum(CASE WHEN human = grader THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS agreement FROM g"),
    "log14_label_stability": (lambda s, d: lo.label_stability(table(s, d, "lineitem"), "l_orderkey", "l_returnflag"), "SELECT count(*) AS n_repeated, count(*) FILTER (k > 1) AS n_unstable FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_orderkey) WHERE n > 1"),
    "log16_compare_runs": (lambda s, d: rounded(lo.compare_runs(run(s, d, 0), run(s, d, 1), "case_id"), 5), "WITH a AS (SELECT o_orderkey AS k, o_orderkey % 5 > 0 AS p, o_totalprice / 1000 AS l, CASE WHEN o_orderkey % 4 > 0 THEN 1.0::DOUBLE END AS c FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, (o_orderkey + 1) % 5 > 0 AS p, o_totalprice / 1000 + 1 AS l, CASE WHEN o_orderkey % 4 > 0 THEN 2.0::DOUBLE END AS c FROM orders WHERE o_orderkey % 11 <> 1) SELECT count(a.k) AS n_a, count(b.k) AS n_b, round(avg(a.p::INT), 5) AS pass_a, round(avg(b.p::INT), 5) AS pass_b, round(median(a.l), 5) AS latency_a, round(median(b.l), 5) AS latency_b, sum(a.c) AS cost_a, sum(b.c) AS cost_b, count(*) FILTER (a.p <> b.p) AS n_changed, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_unpaired FROM a FULL JOIN b ON a.k = b.k"),
}
