"""Causal queries: treated users are odd ids, the second half of the month is after."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import causal as ca
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def panel(s, d):
    e = table(s, d, "events")
    g = e.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("n"))
    return g.withColumns({"t": (F.col("user_id") % 2).cast("int"), "post": (F.col("day") >= 16).cast("int"), "week": F.expr("(day - 16) div 5 - CASE WHEN day < 16 AND (16 - day) % 5 <> 0 THEN 1 ELSE 0 END").cast("int")})


def users(s, d):
    return panel(s, d).groupBy("user_id", "t").agg(F.sum(F.when(F.col("post") == 0, F.col("y")).otherwise(0.0)).alias("pre"), F.sum(F.when(F.col("post") == 1, F.col("y")).otherwise(0.0)).alias("outcome"), F.sum("n").alias("n"))


def holes(s, d):
    return table(s, d, "orders").withColumn("partial", F.when((F.col("o_orderdate") < "1998-01-01") | (F.col("o_orderkey") % 7 > 0), F.col("o_totalprice")))


def scored(s, d):
    return ca.propensity(users(s, d), "t", ["pre", "n"])


def matched(s, d):
    return ca.match(scored(s, d), "t", "user_id")


PAN = "(SELECT *, (user_id % 2)::INT AS t, (day >= 16)::INT AS post, floor((day - 16) / 5)::INT AS week FROM (SELECT user_id, dayofmonth(ts)::INT AS day, sum(value) AS y, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2))"
USR = f"(SELECT user_id, t, sum(CASE WHEN post = 0 THEN y ELSE 0 END) AS pre, sum(CASE WHEN post = 1 THEN y ELSE 0 END) AS outcome, sum(n) AS n FROM {PAN} GROUP BY 1, 2)"
OLS = f"WITH u AS (SELECT outcome AS y, t::DOUBLE AS x FROM {USR}), m AS (SELECT x, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS sse FROM u GROUP BY 1), a AS (SELECT max(CASE WHEN x = 0 THEN m END) AS m0, max(CASE WHEN x = 1 THEN m END) AS m1, sum(n) AS n, max(CASE WHEN x = 0 THEN sse / n / n END) AS v0, max(CASE WHEN x = 1 THEN sse / n / n END) AS v1 FROM m) SELECT 'intercept' AS term, round(m0, 4) AS estimate, round(sqrt(v0 * n / (n - 2)), 4) AS se, round(m0 / sqrt(v0 * n / (n - 2)), 4) AS z FROM a UNION ALL SELECT 't', round(m1 - m0, 4), round(sqrt((v0 + v1) * n / (n - 2)), 4), round((m1 - m0) / sqrt((v0 + v1) * n / (n - 2)), 4) FROM a"

SMD = "abs((avg({c}) FILTER (t = 1{w}) - avg({c}) FILTER (t = 0{w})) / sqrt((var_samp({c}) FILTER (t = 1{w}) + var_samp({c}) FILTER (t = 0{w})) / 2))"

QUERIES = {
    "cau1_did": (lambda s, d: rounded(ca.did(panel(s, d), "y", "t", "post", tails=False), 5), f"WITH c AS (SELECT t, post AS p, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS sse FROM {PAN} GROUP BY 1, 2), g AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN t = p THEN m ELSE -m END) AS e, sum(sse / n / n) AS v FROM c) SELECT n, round(e, 5) AS effect, round(sqrt(v * n / (n - 4)), 5) AS se, round(e / sqrt(v * n / (n - 4)), 5) AS z FROM g"),
    "cau1_did_p": (lambda s, d: ca.did(panel(s, d), "y", "t", "post"), None),
    "cau2_parallel_trends": (lambda s, d: rounded(ca.parallel_trends(panel(s, d), "y", "t", "day", 16, tails=False), 5), f"WITH r AS (SELECT t, day::DOUBLE AS x, y FROM {PAN} WHERE day < 16), f AS (SELECT t, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS xm, regr_sxx(y, x) AS sxx, count(*) AS n FROM r GROUP BY 1), m AS (SELECT t, sum(power((x - xm) * (y - a - b * x), 2)) AS meat FROM r JOIN f USING (t) GROUP BY 1), g AS (SELECT sum(CASE WHEN t = 1 THEN b ELSE -b END) AS d, sum(meat / sxx / sxx) AS v, sum(n)::BIGINT AS n FROM f JOIN m USING (t)) SELECT n, round(d, 5) AS difference, round(sqrt(v * n / (n - 4)), 5) AS se, round(d / sqrt(v * n / (n - 4)), 5) AS z FROM g"),
    "cau3_event_study": (lambda s, d: rounded(ca.event_study(panel(s, d), "y", "t", F.col("week"), -1, tails=False), 5), f"WITH c AS (SELECT week AS period, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS gap, var_pop(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_pop(y) FILTER (t = 0) / count(*) FILTER (t = 0) AS v FROM {PAN} GROUP BY 1) SELECT a.period, round(a.gap - b.gap, 5) AS effect, round(sqrt(a.v + b.v), 5) AS se, round((a.gap - b.gap) / sqrt(a.v + b.v), 5) AS z FROM c a, c b WHERE b.period = -1 AND a.period <> -1"),
    "cau5_propensity_match": (lambda s, d: matched(s, d), None),
    "cau5_att": (lambda s, d: ca.att(matched(s, d), users(s, d), "user_id", "outcome"), None),
    "cau5_match_among_ten": (lambda s, d: ca.match(scored(s, d), "t", "user_id", nearest_of=10), None),
    "cau5_match_with_replacement": (
        lambda s, d: rounded(ca.match(users(s, d).withColumn("score", F.round("pre", 2).cast("decimal(18,2)")), "t", "user_id", "score", replacement=True), 4),
        f"""WITH u AS (SELECT user_id, t, round(pre, 2) AS s FROM {USR}), w AS (SELECT 0.2::DOUBLE * stddev_samp(s) AS w FROM u),
        p AS (SELECT a.user_id AS treated_key, b.user_id AS control_key, abs(a.s - b.s) AS distance, row_number() OVER (PARTITION BY a.user_id ORDER BY round(abs(a.s - b.s), 6), b.s, b.user_id) AS k FROM u a, u b, w WHERE a.t = 1 AND b.t = 0 AND abs(a.s - b.s) <= w)
        SELECT treated_key, control_key, round(distance, 4) AS distance FROM p WHERE k = 1""",
    ),
    "cau6_common_support": (lambda s, d: rounded(ca.support(users(s, d), "pre", "t"), 4), f"WITH s AS (SELECT greatest(min(pre) FILTER (t = 1), min(pre) FILTER (t = 0)) AS low, least(max(pre) FILTER (t = 1), max(pre) FILTER (t = 0)) AS high FROM {USR}), r AS (SELECT low, high, count(*) AS n, count(*) FILTER (pre < low - 1e-9 * greatest(1, abs(low)) OR pre > high + 1e-9 * greatest(1, abs(high))) AS k FROM {USR}, s GROUP BY 1, 2) SELECT round(low, 4) AS low, round(high, 4) AS high, n, k AS n_outside, CASE WHEN k / n <= 0.05 THEN 'PASS' WHEN k / n <= 0.2 THEN 'WARNING' ELSE 'FAIL' END AS status FROM r"),
    "cau7_balance": (lambda s, d: rounded(ca.balance(users(s, d), ["pre", "n"], "t")), " UNION ALL ".join(f"SELECT '{c}' AS covariate, round(abs((avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2)), 6) AS smd, round(var_samp({c}) FILTER (t = 1) / var_samp({c}) FILTER (t = 0), 6) AS variance_ratio, abs((avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2)) < 0.1 AS balanced FROM {USR}" for c in ("pre", "n"))),
    "cau7_balance_change": (lambda s, d: ca.balance_change(ca.balance(users(s, d), ["pre", "n"], "t"), ca.balance(users(s, d).where("n > 10"), ["pre", "n"], "t")).select("covariate", "change"), " UNION ALL ".join(f"SELECT '{c}' AS covariate, CASE WHEN {SMD.format(c=c, w=' AND n > 10')} < {SMD.format(c=c, w='')} THEN 'improved' ELSE 'worsened' END AS change FROM {USR}" for c in ("pre", "n"))),
    "cau9_pre_post": (lambda s, d: rounded(ca.paired(users(s, d), "pre", "outcome", tails=False), 5), f"SELECT count(*) AS n, round(avg(outcome - pre), 5) AS effect, round(stddev_samp(outcome - pre) / sqrt(count(*)), 5) AS se, round(avg(outcome - pre) / (stddev_samp(outcome - pre) / sqrt(count(*))), 5) AS t FROM {USR}"),
    "cau10_timeseries_pre_post": (
        lambda s, d: rounded(ca.ols(panel(s, d).groupBy("day", "post").agg(F.sum("y").alias("y")), "y", {"post": F.col("post"), "trend": F.col("day")}, robust=False, tails=False), 4),
        f"""WITH d AS (SELECT day::DOUBLE AS x, post::DOUBLE AS p, sum(y) AS y FROM {PAN} GROUP BY 1, 2), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(p) AS mp, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(p) * count(*) AS pp, var_pop(y) * count(*) AS yy,
            covar_pop(x, p) * count(*) AS xp, covar_pop(x, y) * count(*) AS xy, covar_pop(p, y) * count(*) AS py FROM d),
        b AS (SELECT *, pp * xx - xp * xp AS det, (xx * py - xp * xy) / det AS bp, (pp * xy - xp * py) / det AS bx, (yy - bp * py - bx * xy) / (n - 3) AS s2, my - bp * mp - bx * mx AS b0 FROM m),
        t AS (SELECT 'intercept' AS term, b0 AS e, sqrt(s2 * (1 / n + (mp * mp * xx + mx * mx * pp - 2 * mp * mx * xp) / det)) AS se FROM b UNION ALL SELECT 'post', bp, sqrt(s2 * xx / det) FROM b UNION ALL SELECT 'trend', bx, sqrt(s2 * pp / det) FROM b)
        SELECT term, round(e, 4) AS estimate, round(se, 4) AS se, round(e / se, 4) AS z FROM t""",
    ),
    "cau11_regression": (lambda s, d: rounded(ca.ols(users(s, d), "outcome", {"t": F.col("t")}, tails=False), 4), OLS),
    "cau11_with_dummies": (lambda s, d: ca.ols(table(s, d, "orders"), "o_totalprice", {"late": (F.year("o_orderdate") >= 1998).cast("int"), **ca.dummies(table(s, d, "orders"), "o_orderpriority")}), None),
    "cau12_rosenbaum": (lambda s, d: rounded(ca.rosenbaum(users(s, d), "outcome", "pre", [1.0, 1.5, 2.0], tails=False), 5), f"WITH d AS (SELECT outcome - pre AS d FROM {USR} WHERE outcome <> pre), p AS (SELECT abs(d) AS a, count(*) AS ties, count(*) FILTER (d > 0) AS up FROM d GROUP BY 1), r AS (SELECT *, sum(ties) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) - (ties - 1) / 2 AS rank FROM p), s AS (SELECT sum(rank * up) AS t, sum(rank * ties) AS s1, sum(rank * rank * ties) AS s2 FROM r) SELECT g AS gamma, round(t, 5) AS t, round((t - g / (1 + g) * s1) / sqrt(g / (1 + g) * (1 / (1 + g)) * s2), 5) AS z_upper FROM s, (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS g)"),
    "cau14_confounds": (
        lambda s, d: rounded(ca.confounds(holes(s, d), "o_orderdate", "1998-01-01", ["o_totalprice", "o_custkey", "partial"]), 5),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(avg({c}) FILTER (NOT late), 5) AS before, round(avg({c}) FILTER (late), 5) AS after, round(stddev_samp({c}), 5) AS sd, round(count(*) FILTER (NOT late AND {c} IS NULL) / count(*) FILTER (NOT late), 5) AS null_before,
            round(count(*) FILTER (late AND {c} IS NULL) / count(*) FILTER (late), 5) AS null_after, round((avg({c}) FILTER (late) - avg({c}) FILTER (NOT late)) / stddev_samp({c}), 5) AS shift,
            abs((avg({c}) FILTER (late) - avg({c}) FILTER (NOT late)) / stddev_samp({c})) > 0.1 OR abs(count(*) FILTER (late AND {c} IS NULL) / count(*) FILTER (late) - count(*) FILTER (NOT late AND {c} IS NULL) / count(*) FILTER (NOT late)) > 0.05 AS flag
            FROM (SELECT *, o_orderdate >= DATE '1998-01-01' AS late, CASE WHEN o_orderdate < DATE '1998-01-01' OR o_orderkey % 7 > 0 THEN o_totalprice END AS partial FROM orders)"""
            for c in ("o_totalprice", "o_custkey", "partial")
        ),
    ),
    "cau1_did_covariates": (lambda s, d: rounded(ca.did_adjusted(panel(s, d), "y", "t", "post", {"n": F.col("n")}, tails=False), 6), None),
}
