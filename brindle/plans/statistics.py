"""Statistics and experiment queries; oracles check the sufficient and test statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import statistics as st
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def t(name):
    return lambda s, d: table(s, d, name)


O, L, E, C = t("orders"), t("lineitem"), t("events"), t("customer")


def ab(s, d):
    """Events with a variant by user."""
    return E(s, d).withColumns({"variant": (F.col("user_id") % 2).cast("int"), "bought": (F.col("event_type") == "purchase").cast("int")})


def users(s, d):
    """Per user: value before and after the middle of the month."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return E(s, d).groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("ts") < cut, F.col("value"))), F.lit(0.0)).alias("pre"), F.coalesce(F.sum(F.when(F.col("ts") >= cut, F.col("value"))), F.lit(0.0)).alias("post"), F.count("*").cast("double").alias("n")).withColumn("variant", (F.col("user_id") % 2).cast("int"))


def pvalues(s, d):
    p = O(s, d).groupBy("o_orderpriority").agg((F.count("*") % 97 / 1000.0).alias("p")).withColumnRenamed("o_orderpriority", "test")
    return st.adjust(p)


def posteriors(s, d):
    return E(s, d).groupBy(F.col("event_type").alias("variant")).agg(F.avg("value").alias("mean"), (F.var_samp("value") / F.count("*")).alias("var"))


AB = "(SELECT *, (user_id % 2)::INT AS variant, (event_type = 'purchase')::INT AS bought FROM events)"
US = "(SELECT user_id, coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-16'), 0) AS pre, coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 0) AS post, count(*)::DOUBLE AS n, (user_id % 2)::INT AS variant FROM events GROUP BY 1)"
G = "g AS (SELECT count(value) FILTER (variant = 0) AS n_a, avg(value) FILTER (variant = 0) AS m_a, var_samp(value) FILTER (variant = 0) AS v_a, count(value) FILTER (variant = 1) AS n_b, avg(value) FILTER (variant = 1) AS m_b, var_samp(value) FILTER (variant = 1) AS v_b FROM " + AB + ")"
WELCH = f"WITH {G} SELECT n_a, round(m_a, 6) AS m_a, round(v_a, 6) AS v_a, n_b, round(m_b, 6) AS m_b, round(v_b, 6) AS v_b, round(m_b - m_a, 6) AS diff_b_minus_a, round(sqrt(v_a / n_a + v_b / n_b), 6) AS se, round(power(v_a / n_a + v_b / n_b, 2) / (power(v_a / n_a, 2) / (n_a - 1) + power(v_b / n_b, 2) / (n_b - 1)), 4) AS df, round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS t_a_minus_b, round((m_b - m_a) / abs(m_a), 6) AS lift, round((m_b - m_a) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS cohens_d FROM g"
PROP = f"WITH g AS (SELECT count(*) FILTER (variant = 0) AS n_a, count(*) FILTER (variant = 0 AND bought = 1) AS k_a, count(*) FILTER (variant = 1) AS n_b, count(*) FILTER (variant = 1 AND bought = 1) AS k_b FROM {AB}), p AS (SELECT *, k_a / n_a AS p_a, k_b / n_b AS p_b, (k_a + k_b) / (n_a + n_b) AS pp FROM g), q AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b) AS h FROM p) SELECT n_a, k_a, n_b, k_b, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_b - p_a, 6) AS difference, round((p_b - p_a) / sqrt(pp * (1 - pp) * (1 / n_a + 1 / n_b)), 6) AS z, round(p_b - p_a - h, 6) AS low, round(p_b - p_a + h, 6) AS high, round((p_b - p_a) / p_a, 6) AS lift FROM q"
RANKS = "r AS (SELECT x, ka, ties, sum(ties) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - (ties - 1) / 2 AS rank FROM (SELECT value AS x, count(*) FILTER (variant = 0) AS ka, count(*) AS ties FROM " + AB + " GROUP BY 1))"

QUERIES = {
    "sta1_exp2_proportions": (lambda s, d: rounded(st.proportions(ab(s, d), "variant", F.col("bought") == 1, 0, 1, tails=False)), PROP),
    "sta2_exp1_exp14_welch": (lambda s, d: rounded(st.welch(ab(s, d), "variant", "value", 0, 1, tails=False).withColumn("df", F.round("df", 4))), WELCH),
    "sta2_welch_p": (lambda s, d: st.welch(ab(s, d), "variant", "value", 0, 1).select("t_a_minus_b", "df", "p", "low", "high"), None),
    "sta3_win9_mann_whitney": (lambda s, d: rounded(st.mann_whitney(ab(s, d), "variant", "value", 0, 1, tails=False), 4), f"WITH {RANKS}, g AS (SELECT sum(ka)::BIGINT AS n_a, sum(ties - ka)::BIGINT AS n_b, sum(rank * ka) AS r, sum(power(ties, 3) - ties) AS tie FROM r), u AS (SELECT *, r - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n, n_a * n_b AS pr FROM g) SELECT n_a, n_b, round(u, 4) AS u, round(sign(u - pr / 2) * greatest(abs(u - pr / 2) - 0.5, 0) / sqrt(pr / 12.0 * (n + 1 - tie / (n * (n - 1.0)))), 4) AS z, round(2 * u / pr - 1, 4) AS rank_biserial, (SELECT round(median(value), 4) FROM {AB} WHERE variant = 0) AS median_a, (SELECT round(median(value), 4) FROM {AB} WHERE variant = 1) AS median_b FROM u"),
    "win9_average_ranks": (lambda s, d: st.average_ranks(table(s, d, "part"), "p_size").select(F.col("_v").alias("size"), "ties", F.col("rank").cast("double").alias("rank")), "SELECT p_size AS size, count(*) AS ties, (sum(count(*)) OVER (ORDER BY p_size ROWS UNBOUNDED PRECEDING) - (count(*) - 1) / 2)::DOUBLE AS rank FROM part GROUP BY 1"),
    "sta4_mean_interval": (lambda s, d: rounded(st.mean_interval(E(s, d), "value", by=["event_type"], tails=False)), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY 1"),
    "sta5_chi_square": (lambda s, d: rounded(st.chi_square(O(s, d), "o_orderstatus", "o_orderpriority", tails=False)), "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT a.r, b.c, coalesce(n, 0) AS n, nr * nc / t AS e FROM (SELECT r, sum(n) AS nr FROM c GROUP BY 1) a CROSS JOIN (SELECT c, sum(n) AS nc FROM c GROUP BY 1) b CROSS JOIN (SELECT sum(n) AS t FROM c) LEFT JOIN c ON c.r = a.r AND c.c = b.c) SELECT round(sum(power(n - e, 2) / e), 6) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df, sum(n)::BIGINT AS n FROM g"),
    "sta6_bootstrap": (lambda s, d: st.bootstrap(E(s, d), "event_id", "value", 100), None),
    "sta7_adjusted_p": (lambda s, d: rounded(pvalues(s, d), 9), "WITH t AS (SELECT o_orderpriority AS test, (count(*) % 97 / 1000.0)::DOUBLE AS p FROM orders GROUP BY 1), k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS k FROM t) SELECT test, p, round(least(1.0, p * m), 9) AS bonferroni, round(least(1.0, max(p * (m - k + 1)) OVER (ORDER BY p, test)), 9) AS holm, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC, test DESC)), 9) AS bh FROM k"),
    "sta8_normality": (lambda s, d: rounded(st.jarque_bera(E(s, d), "value", ["event_type"], tails=False), 3), "WITH x AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL), g AS (SELECT event_type, count(*) AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS sk, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS ku FROM x GROUP BY 1) SELECT event_type, n, round(sk, 3) AS skew, round(ku, 3) AS kurtosis, round(n / 6.0 * (sk * sk + ku * ku / 4), 3) AS jb FROM g"),
    "prf16_describe_shape": (lambda s, d: rounded(st.describe_shape(E(s, d), "value")), "WITH x AS (SELECT value, avg(value) OVER () AS m FROM events WHERE value IS NOT NULL), g AS (SELECT count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS sd, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS sk, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3 AS ku FROM x) SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(sk, 6) AS skew, round(ku, 6) AS kurtosis, CASE WHEN abs(sk) < 0.5 THEN 'symmetric' WHEN sk > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape FROM g"),
    "sta9_rank_dimensions": (lambda s, d: rounded(st.rank_dimensions(L(s, d), "l_extendedprice", ["l_returnflag", "l_linenumber", "l_partkey"], tails=False)), "WITH x AS (SELECT 'l_returnflag' AS dim, l_returnflag AS v, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_extendedprice FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey::VARCHAR, l_extendedprice FROM lineitem), t AS (SELECT dim, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS st FROM x GROUP BY 1), g AS (SELECT dim, v, count(*) AS k, avg(x) AS m FROM x GROUP BY 1, 2 HAVING count(*) > 1), b AS (SELECT dim, sum(k * power(m - mean, 2)) AS sb, count(*) AS gr FROM g JOIN t USING (dim) GROUP BY 1) SELECT dim, n, gr AS groups, round(sb / st, 6) AS eta2, round((sb / (gr - 1)) / ((st - sb) / (n - gr)), 6) AS f FROM t JOIN b USING (dim)"),
    "exp3_ratio_metric": (lambda s, d: rounded(st.ratio_metric(users(s, d), "variant", "post", "n", 0, 1, tails=False)), f"WITH g AS (SELECT variant, count(*) AS n, avg(post) AS x, avg(n) AS y, var_samp(post) AS vx, var_samp(n) AS vy, covar_samp(post, n) AS c FROM {US} GROUP BY 1), r AS (SELECT variant, n, x / y AS r, (vx - 2 * x / y * c + power(x / y, 2) * vy) / (power(y, 2) * n) AS v FROM g) SELECT a.n AS n_a, b.n AS n_b, round(a.r, 6) AS r_a, round(b.r, 6) AS r_b, round(b.r - a.r, 6) AS difference, round((b.r - a.r) / sqrt(a.v + b.v), 6) AS z FROM r a, r b WHERE a.variant = 0 AND b.variant = 1"),
    "exp4_srm": (lambda s, d: rounded(st.srm(users(s, d), "variant", {0: 0.5, 1: 0.5}, tails=False)), f"SELECT count(*) AS n, round(power(count(*) FILTER (variant = 0) - count(*) / 2, 2) / (count(*) / 2) + power(count(*) FILTER (variant = 1) - count(*) / 2, 2) / (count(*) / 2), 6) AS chi2, 1 AS df FROM {US}"),
    "exp4_srm_verdict": (lambda s, d: st.srm(users(s, d), "variant", {0: 0.5, 1: 0.5}), None),
    "exp5_srm_by_segment": (lambda s, d: rounded(st.srm(st.by_segment(ab(s, d).withColumn("hour", F.hour("ts")), ["event_type", "hour"], ["variant"]), "variant", {0: 0.5, 1: 0.5}, by=["dim", "value"], tails=False)), f"WITH x AS (SELECT 'event_type' AS dim, event_type AS value, variant FROM {AB} UNION ALL SELECT 'hour', hour(ts)::VARCHAR, variant FROM {AB}) SELECT dim, value, count(*) AS n, round(power(count(*) FILTER (variant = 0) - count(*) / 2, 2) / (count(*) / 2) + power(count(*) FILTER (variant = 1) - count(*) / 2, 2) / (count(*) / 2), 6) AS chi2, 1 AS df FROM x GROUP BY 1, 2"),
    "exp5_srm_all_segments": (
        lambda s, d: rounded(st.srm_by_segments(ab(s, d).withColumns({"weekday": F.dayofweek("ts"), "hour": F.hour("ts")}).drop("props", "user_id"), "variant", {0: 0.5, 1: 0.5}, tails=False)),
        f"""WITH e AS (SELECT *, dayofweek(ts) + 1 AS weekday FROM {AB}), x AS (SELECT 'event_type' AS dim, event_type AS value, variant FROM e UNION ALL SELECT 'bought', bought::VARCHAR, variant FROM e UNION ALL SELECT 'weekday', weekday::VARCHAR, variant FROM e)
        SELECT dim, value, count(*) AS n, round(power(count(*) FILTER (variant = 0) - count(*) / 2, 2) / (count(*) / 2) + power(count(*) FILTER (variant = 1) - count(*) / 2, 2) / (count(*) / 2), 6) AS chi2, 1 AS df FROM x GROUP BY 1, 2""",
    ),
    "exp6_cuped": (lambda s, d: rounded(st.cuped(users(s, d), "variant", "pre", "post", 0, 1, tails=False), 4), f"WITH a AS (SELECT covar_samp(pre, post) / var_samp(pre) AS theta, avg(pre) AS xm, power(corr(pre, post), 2) AS red FROM {US}), g AS (SELECT variant, count(*) AS n, avg(pre) AS x, avg(post) AS y, var_samp(pre) AS vx, var_samp(post) AS vy, covar_samp(pre, post) AS c FROM {US} GROUP BY 1), m AS (SELECT variant, n, y - theta * (x - xm) AS m, (vy - 2 * theta * c + theta * theta * vx) / n AS s FROM g, a) SELECT round(theta, 4) AS theta, round(red, 4) AS reduction, round(p.m, 4) AS m_a, round(q.m, 4) AS m_b, round(q.m - p.m, 4) AS effect, round(sqrt(p.s + q.s), 4) AS se, round(power(p.s + q.s, 2) / (p.s * p.s / (p.n - 1) + q.s * q.s / (q.n - 1)), 4) AS df FROM a, m p, m q WHERE p.variant = 0 AND q.variant = 1"),
    "exp8_confidence_sequence": (lambda s, d: rounded(st.confidence_sequence(E(s, d), "value", "event_type", ["ts", "event_id"]).drop("ts", "x", "mean"), 4), "WITH r AS (SELECT event_type, event_id, value AS x, count(value) OVER w AS n, avg(value) OVER w AS mean, var_samp(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), h AS (SELECT *, sqrt(2 * v * ln(2 * log2(2 * n) / 0.05::DOUBLE * 1.7::DOUBLE) / n * 1.1::DOUBLE) AS h FROM r) SELECT event_type, event_id, n, CASE WHEN n >= 2 THEN round(mean - h, 4) END AS low, CASE WHEN n >= 2 THEN round(mean + h, 4) END AS high FROM h"),
    "exp9_e_value": (lambda s, d: rounded(st.e_value(E(s, d), "value", "event_type", ["ts", "event_id"], 10.0).groupBy("event_type").agg(F.max("log_e").alias("top_log_e"), F.min("p").alias("least_p")), 4), "WITH r AS (SELECT event_type, ts, event_id, value - 10 AS d FROM events), s AS (SELECT *, coalesce(sum(d) OVER w, 0) AS s1, coalesce(sum(d * d) OVER w, 0) AS s2 FROM r WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, ln(greatest(1e-10, 1 + CASE WHEN s2 > 0 THEN greatest(-0.5, least(0.5, s1 / s2)) ELSE 0 END * d)) AS gain FROM s), l AS (SELECT event_type, least(500.0, sum(gain) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS e FROM g) SELECT event_type, round(max(e), 4) AS top_log_e, round(least(1.0, exp(-max(e))), 4) AS least_p FROM l GROUP BY 1"),
    "exp10_beta_posterior": (lambda s, d: rounded(st.beta_posterior(ab(s, d), "variant", F.col("bought") == 1, 0, 1, tails=False), 8), f"WITH g AS (SELECT variant, count(*) FILTER (bought = 1) + 1.0::DOUBLE AS al, count(*) FILTER (bought = 0) + 1.0::DOUBLE AS be FROM {AB} GROUP BY 1), m AS (SELECT *, al / (al + be) AS m, al * be / (power(al + be, 2) * (al + be + 1)) AS v FROM g) SELECT a.al AS al_a, a.be AS be_a, b.al AS al_b, b.be AS be_b, round(a.m, 8) AS mean_a, round(a.v, 8) AS var_a, round(b.m, 8) AS mean_b, round(b.v, 8) AS var_b, round((b.m - a.m) / sqrt(a.v + b.v), 8) AS z FROM m a, m b WHERE a.variant = 0 AND b.variant = 1"),
    "exp11_normal_posterior": (lambda s, d: rounded(st.normal_posterior(ab(s, d), "variant", "value", 0, 1, tails=False)), f"WITH {G}, p AS (SELECT 1 / (1 / 1e6 + n_a / v_a) AS pv_a, 1 / (1 / 1e6 + n_b / v_b) AS pv_b, * FROM g), q AS (SELECT pv_a, pv_b, pv_a * n_a * m_a / v_a AS pm_a, pv_b * n_b * m_b / v_b AS pm_b FROM p) SELECT round(pm_a, 6) AS pm_a, round(pm_b, 6) AS pm_b, round(pv_a, 6) AS pv_a, round(pv_b, 6) AS pv_b, round(sqrt(pv_a + pv_b), 6) AS sd, round((pm_b - pm_a) / sqrt(pv_a + pv_b), 6) AS z FROM q"),
    "exp12_prob_best": (lambda s, d: rounded(st.prob_best(posteriors(s, d))), None),
    "exp15_sizing": (lambda s, d: rounded(st.sizing(E(s, d).withColumn("pre", F.pmod("user_id", F.lit(13)).cast("double")), "event_type", F.col("value") > 20, "value", "pre", "ts", [0.05, 0.1]), 4), None),
    "exp17_segment_effects": (lambda s, d: rounded(st.by_segment(ab(s, d).withColumnRenamed("value", "v"), ["event_type"], ["variant", "v"]).withColumnRenamed("value", "seg").groupBy("dim", "seg").agg(F.avg(F.when(F.col("variant") == 0, F.col("v"))).alias("m_a"), F.avg(F.when(F.col("variant") == 1, F.col("v"))).alias("m_b"))), f"SELECT 'event_type' AS dim, event_type AS seg, round(avg(value) FILTER (variant = 0), 6) AS m_a, round(avg(value) FILTER (variant = 1), 6) AS m_b FROM {AB} GROUP BY 2"),
    "exp18_accumulation": (lambda s, d: rounded(st.accumulation(E(s, d), "ts", 8000)), "WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT day, (sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS total, avg(n) OVER (ORDER BY day ROWS 6 PRECEDING) AS pace FROM d) SELECT day, total, round(pace, 6) AS pace, CASE WHEN total >= 8000 THEN 0 ELSE ceil((8000 - total) / pace)::BIGINT END AS days_left FROM r"),
    "exp19_guardrails": (lambda s, d: ab(s, d).groupBy("event_type").agg((F.avg(F.when(F.col("variant") == 1, F.col("value"))) / F.avg(F.when(F.col("variant") == 0, F.col("value"))) - 1).alias("change")).select("event_type", F.round("change", 6).alias("change"), st.guardrail(F.abs("change"), 0.02, 0.05).alias("status")), f"WITH c AS (SELECT event_type, avg(value) FILTER (variant = 1) / avg(value) FILTER (variant = 0) - 1 AS c FROM {AB} GROUP BY 1) SELECT event_type, round(c, 6) AS change, CASE WHEN abs(c) >= 0.05 THEN 'RED' WHEN abs(c) >= 0.02 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM c"),
}
