"""Product analytics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import product as pa
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def t(name):
    return lambda s, d: table(s, d, name)


O, L, E = t("orders"), t("lineitem"), t("events")


def daily(s, d):
    return E(s, d).groupBy(F.col("ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


def weekly_cohorts(s, d):
    return pa.cohorts(E(s, d), "user_id", "ts", "week")


def monthly_cohorts(s, d):
    return pa.cohorts(O(s, d).where("o_custkey % 5 > 0 OR month(o_orderdate) <> 3"), "o_custkey", "o_orderdate", "month")


def year_is(y):
    return F.year("o_orderdate") == y


DV = "(SELECT ts::DATE AS day, round(sum(value), 6) AS v FROM events GROUP BY 1)"
COH = """e AS (SELECT DISTINCT user_id AS u, date_trunc('week', ts)::DATE AS p FROM events), fi AS (SELECT u, min(p) AS cohort FROM e GROUP BY 1), si AS (SELECT cohort, count(*) AS size FROM fi GROUP BY 1),
ce AS (SELECT cohort, ((p - cohort) // 7)::INT AS "offset", count(*) AS users FROM e JOIN fi USING (u) GROUP BY 1, 2), gr AS (SELECT cohort, size, unnest(range(0, ((SELECT max(p) FROM e) - cohort) // 7 + 1))::INT AS "offset" FROM si),
co AS (SELECT cohort, "offset", coalesce(users, 0) AS users, size, coalesce(users, 0) / size AS rate, size < 50 AS small FROM gr LEFT JOIN ce USING (cohort, "offset"))"""
LTV = """e AS (SELECT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS p, o_totalprice AS r FROM orders), fi AS (SELECT u, min(p) AS cohort FROM e GROUP BY 1), si AS (SELECT cohort, count(*) AS size FROM fi GROUP BY 1),
ce AS (SELECT cohort, datediff('month', cohort, p)::INT AS "offset", sum(r) AS r FROM e JOIN fi USING (u) GROUP BY 1, 2), lt AS (SELECT cohort, "offset", sum(r) OVER (PARTITION BY cohort ORDER BY "offset") / size AS ltv FROM ce JOIN si USING (cohort))"""


COM = """e AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS p FROM orders WHERE o_custkey % 5 > 0 OR month(o_orderdate) <> 3), fi AS (SELECT u, min(p) AS cohort FROM e GROUP BY 1), si AS (SELECT cohort, count(*) AS size FROM fi GROUP BY 1),
ce AS (SELECT cohort, datediff('month', cohort, p)::INT AS "offset", count(*) AS users FROM e JOIN fi USING (u) GROUP BY 1, 2), gr AS (SELECT cohort, size, unnest(range(0, datediff('month', cohort, (SELECT max(p) FROM e)) + 1))::INT AS "offset" FROM si),
co AS (SELECT cohort, "offset", coalesce(users, 0) AS users, size, coalesce(users, 0) / size AS rate FROM gr LEFT JOIN ce USING (cohort, "offset"))"""


def score_sql(c, name, reverse=False):
    """Quantile bins: the most of 5, 4, 3, 2 whose edges are distinct."""
    q = lambda n: f"(SELECT quantile_cont({c}, {[i / n for i in range(n + 1)]}) FROM p)"
    edges = "CASE " + " ".join(f"WHEN len(list_distinct({q(n)})) = {n + 1} THEN {q(n)}" for n in (5, 4, 3, 2)) + " END"
    above = f"len(list_filter(list_slice({edges}, 2, len({edges}) - 1), lambda e: e < {c}))"
    return f"(CASE WHEN {edges} IS NULL THEN 3 ELSE {'5 - ' + above if reverse else above + ' + 1'} END)::INT AS {name}"


RFM = f"p AS (SELECT o_custkey, (DATE '2001-12-31' - max(o_orderdate)::DATE)::INT AS recency, count(*) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1), s AS (SELECT *, {score_sql('recency', 'r', True)}, {score_sql('frequency', 'f')}, {score_sql('monetary', 'm')} FROM p)"
SHARES = "x AS (SELECT 'o_orderstatus' AS dim, o_orderstatus AS value, year(o_orderdate) = 2000 AS now, o_totalprice AS v FROM orders WHERE year(o_orderdate) IN (1999, 2000) UNION ALL SELECT 'o_orderpriority', o_orderpriority, year(o_orderdate) = 2000, o_totalprice FROM orders WHERE year(o_orderdate) IN (1999, 2000)), g AS (SELECT dim, value, coalesce(sum(v) FILTER (now), 0) AS now, coalesce(sum(v) FILTER (NOT now), 0) AS before FROM x GROUP BY 1, 2), sh AS (SELECT *, now - before AS excess, (now - before) / sum(now - before) OVER (PARTITION BY dim) AS share FROM g)"


def two_years(s, d):
    return O(s, d).where(F.year("o_orderdate").isin(1999, 2000))


QUERIES = {
    "pa4_lorenz": (
        lambda s, d: rounded(pa.lorenz(O(s, d), "o_totalprice", "o_custkey")),
        """WITH p AS (SELECT o_custkey AS e, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT row_number() OVER w AS rank, sum(v) OVER w AS running, count(*) OVER () AS n, sum(v) OVER () AS t FROM p WINDOW w AS (ORDER BY v, e ROWS UNBOUNDED PRECEDING))
        SELECT k::INT AS point, rank AS entities, round(running / t, 6) AS share FROM r JOIN range(1, 11) g(k) ON rank = ceil(n * k / 10)""",
    ),
    "pa6_trailing_chart": (
        lambda s, d: rounded(pa.trailing_chart(daily(s, d), "day", "v", 7, 1.5), 5),
        f"""WITH x AS (SELECT day, v, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd, count(*) OVER w AS k FROM {DV} WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)), y AS (SELECT day, v, CASE WHEN k = 7 THEN m END AS m, CASE WHEN k = 7 THEN sd END AS sd FROM x)
        SELECT day, round(v, 5) AS v, round(m, 5) AS mean, round(m - 1.5 * sd, 5) AS lcl, round(m + 1.5 * sd, 5) AS ucl, coalesce(abs(v - m) > 1.5 * sd, false) AS outside FROM y""",
    ),
    "pa14_three_oldest_cohorts": (
        lambda s, d: rounded(pa.cohort_benchmark(monthly_cohorts(s, d), 3, 0.001)),
        f"""WITH {COM}, r AS (SELECT *, dense_rank() OVER (ORDER BY cohort) AS k FROM co), b AS (SELECT "offset", avg(rate) AS benchmark FROM r WHERE k <= 3 GROUP BY 1)
        SELECT cohort, "offset", round(rate, 6) AS rate, round(benchmark, 6) AS benchmark FROM r JOIN b USING ("offset") WHERE k > 3 AND abs(rate - benchmark) > 0.001""",
    ),
    "pa15_cohort_gaps": (
        lambda s, d: pa.cohort_gaps(monthly_cohorts(s, d)),
        f"""WITH {COM}, h AS (SELECT DISTINCT cohort FROM co), g AS (SELECT unnest(generate_series(min(cohort)::TIMESTAMP, max(cohort)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS cohort FROM h),
        l AS (SELECT *, sum(users) OVER (PARTITION BY cohort ORDER BY "offset" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM co)
        SELECT 'cohort' AS kind, cohort, NULL::INT AS "offset" FROM g WHERE cohort NOT IN (SELECT cohort FROM h) UNION ALL SELECT 'offset', cohort, "offset" FROM l WHERE users = 0 AND later > 0""",
    ),
    "pa16_funnel_by_segment": (
        lambda s, d: rounded(pa.funnel(E(s, d).withColumn("seg", (F.col("user_id") % 3).cast("int")), "user_id", "ts", "event_type", ["view", "click", "purchase"], ["seg"]), 4),
        """WITH e AS (SELECT *, (user_id % 3)::INT AS seg FROM events), a AS (SELECT seg, user_id, min(ts) AS t0 FROM e WHERE event_type = 'view' GROUP BY 1, 2),
        b AS (SELECT a.seg, user_id, t0, min(ts) AS t1 FROM a LEFT JOIN (SELECT user_id, ts FROM e WHERE event_type = 'click') x USING (user_id) WHERE ts >= t0 GROUP BY 1, 2, 3),
        c AS (SELECT seg, user_id, t1, min(ts) AS t2 FROM b JOIN (SELECT user_id, ts FROM e WHERE event_type = 'purchase') x USING (user_id) WHERE ts >= t1 GROUP BY 1, 2, 3),
        n AS (SELECT seg, (SELECT count(*) FROM a x WHERE x.seg = s.seg) AS n0, (SELECT count(*) FROM b x WHERE x.seg = s.seg) AS n1, (SELECT count(*) FROM c x WHERE x.seg = s.seg) AS n2,
            (SELECT median((epoch_us(t1) - epoch_us(t0)) / 1e6) FROM b x WHERE x.seg = s.seg) AS s1, (SELECT median((epoch_us(t2) - epoch_us(t1)) / 1e6) FROM c x WHERE x.seg = s.seg) AS s2 FROM (SELECT DISTINCT seg FROM a) s)
        SELECT seg, 0 AS step, 'view' AS name, n0 AS users, 1.0::DOUBLE AS step_rate, 1.0::DOUBLE AS overall_rate, 0 AS drop, NULL::DOUBLE AS median_seconds FROM n
        UNION ALL SELECT seg, 1, 'click', n1, round(n1 / n0, 4), round(n1 / n0, 4), n0 - n1, round(s1, 4) FROM n UNION ALL SELECT seg, 2, 'purchase', n2, round(n2 / n1, 4), round(n2 / n0, 4), n1 - n2, round(s2, 4) FROM n""",
    ),
    "pa20_quarter_and_year": (
        lambda s, d: rounded(pa.comparisons(O(s, d), "o_orderdate", "quarter", F.col("o_totalprice"))),
        """WITH g AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1), l AS (SELECT day, v, lag(v) OVER (ORDER BY day) AS p, lag(v, 4) OVER (ORDER BY day) AS y FROM g)
        SELECT day, round(v, 6) AS value, round(p, 6) AS previous, round(y, 6) AS year_ago, round((v - p) / abs(p), 6) AS change, round((v - y) / abs(y), 6) AS change_of_year FROM l""",
    ),
    "pa20_rate_of_month_and_year": (
        lambda s, d: rounded(pa.comparisons(O(s, d), "o_orderdate", "month", (F.col("o_orderstatus") == "F").cast("int"), F.lit(1))),
        """WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, count(*) FILTER (o_orderstatus = 'F') / count(*) AS v FROM orders GROUP BY 1), l AS (SELECT day, v, lag(v) OVER (ORDER BY day) AS p, lag(v, 12) OVER (ORDER BY day) AS y FROM g)
        SELECT day, round(v, 6) AS value, round(p, 6) AS previous, round(y, 6) AS year_ago, CASE WHEN p <> 0 THEN round((v - p) / abs(p), 6) END AS change, CASE WHEN y <> 0 THEN round((v - y) / abs(y), 6) END AS change_of_year FROM l""",
    ),
    "pa1_rfm": (lambda s, d: rounded(pa.rfm(O(s, d), "o_custkey", "o_orderdate", "o_totalprice", "2001-12-31"), 2), f"WITH {RFM} SELECT o_custkey, recency, frequency, round(monetary, 2) AS monetary, r, f, m, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN f >= 4 THEN 'Loyal' WHEN r <= 2 AND f >= 3 THEN 'At Risk' WHEN r <= 2 AND f <= 2 THEN 'Lost' ELSE 'Other' END AS segment FROM s"),
    "pa4_concentration": (lambda s, d: rounded(pa.concentration(O(s, d), "o_totalprice", "o_custkey")), "WITH p AS (SELECT o_custkey AS e, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT v, row_number() OVER w AS rank, sum(v) OVER w AS running, count(*) OVER () AS n, sum(v) OVER () AS t FROM p WINDOW w AS (ORDER BY v DESC, e ROWS UNBOUNDED PRECEDING)) SELECT max(n) AS n, round(sum((n + 1 - 2 * rank) * v) / (max(n) * max(t)), 6) AS gini, round(max(CASE WHEN rank = ceil(n * 0.1) THEN running / t END), 6) AS top10, round(max(CASE WHEN rank = ceil(n * 0.2) THEN running / t END), 6) AS top20, round(max(CASE WHEN rank = ceil(n * 0.5) THEN running / t END), 6) AS top50, round(100.0 * min(CASE WHEN running >= 0.8 * t THEN rank END) / max(n), 6) AS pareto_pct FROM r"),
    "pa5_segment_pairs": (lambda s, d: rounded(pa.segment_pairs(O(s, d), "o_orderpriority", "o_totalprice"), 4), "WITH g AS (SELECT o_orderpriority AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.s AS a, b.s AS b, round(b.m - a.m, 4) AS difference, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS df, round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS d FROM g a JOIN g b ON a.s < b.s"),
    "pa6_control_chart": (lambda s, d: rounded(pa.control_chart(daily(s, d), "day", "v", 1.5), 5), f"WITH z AS (SELECT day, v, avg(v) OVER () AS mean, stddev_samp(v) OVER () AS sd, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z, row_number() OVER (ORDER BY day) AS n FROM {DV}), r AS (SELECT *, sum((z > 2)::INT) OVER a AS a, sum((-z > 2)::INT) OVER a AS b, sum((z > 1)::INT) OVER b AS c, sum((-z > 1)::INT) OVER b AS d, sum((z > 0)::INT) OVER c AS e, sum((-z > 0)::INT) OVER c AS f FROM z WINDOW a AS (ORDER BY day ROWS 2 PRECEDING), b AS (ORDER BY day ROWS 4 PRECEDING), c AS (ORDER BY day ROWS 7 PRECEDING)) SELECT day, round(v, 5) AS v, round(mean, 5) AS mean, round(sd, 5) AS sd, round(z, 5) AS z, round(mean + 1.5 * sd, 5) AS ucl, round(mean - 1.5 * sd, 5) AS lcl, abs(z) > 1.5 AS rule1, n >= 3 AND (a >= 2 OR b >= 2) AS rule2, n >= 5 AND (c >= 4 OR d >= 4) AS rule3, n >= 8 AND (e >= 8 OR f >= 8) AS rule4 FROM r"),
    "pa10_cohorts": (lambda s, d: rounded(weekly_cohorts(s, d), 9), f"WITH {COH} SELECT cohort, \"offset\", users, size, round(rate, 9) AS rate, small FROM co"),
    "pa11_retention_curve": (lambda s, d: rounded(pa.retention_curve(weekly_cohorts(s, d))), f"WITH {COH} SELECT \"offset\", round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS sd, count(*) AS n_cohorts FROM co GROUP BY 1"),
    "pa12_cohort_trend": (lambda s, d: rounded(pa.cohort_trend(weekly_cohorts(s, d))), f"WITH {COH}, r AS (SELECT *, dense_rank() OVER (PARTITION BY \"offset\" ORDER BY cohort)::DOUBLE AS x, avg(rate) OVER (PARTITION BY \"offset\") AS m, stddev_samp(rate) OVER (PARTITION BY \"offset\") AS sd FROM co) SELECT \"offset\", CASE WHEN count(*) > 1 THEN round(regr_slope(rate, x), 6) END AS slope, count(*) FILTER (abs(rate - m) > 2 * sd) AS n_outliers FROM r GROUP BY 1"),
    "pa13_cohort_ltv": (lambda s, d: rounded(pa.cohort_ltv(O(s, d), "o_custkey", "o_orderdate", "o_totalprice"), 0), f"WITH {LTV} SELECT cohort, \"offset\", round(ltv, 0) AS ltv FROM lt"),
    "pa13_ltv_maturity": (lambda s, d: pa.ltv_maturity(pa.cohort_ltv(O(s, d), "o_custkey", "o_orderdate", "o_totalprice")), f"WITH {LTV}, f AS (SELECT *, arg_max(ltv, \"offset\") OVER (PARTITION BY cohort) AS fin FROM lt) SELECT cohort, min(CASE WHEN ltv >= 0.8 * fin THEN \"offset\" END) AS mature_at FROM f GROUP BY 1"),
    "pa14_cohort_benchmark": (lambda s, d: rounded(pa.cohort_benchmark(weekly_cohorts(s, d), 1)), f"WITH {COH}, r AS (SELECT *, dense_rank() OVER (ORDER BY cohort) AS k FROM co), b AS (SELECT \"offset\", avg(rate) AS benchmark FROM r WHERE k <= 1 GROUP BY 1) SELECT cohort, \"offset\", round(rate, 6) AS rate, round(benchmark, 6) AS benchmark FROM r JOIN b USING (\"offset\") WHERE k > 1 AND abs(rate - benchmark) > 0.05"),
    "pa15_cohort_checks": (lambda s, d: rounded(pa.cohort_checks(weekly_cohorts(s, d))), f"WITH {COH}, r AS (SELECT *, rate > lag(rate) OVER (PARTITION BY cohort ORDER BY \"offset\") AS up FROM co) SELECT count(DISTINCT CASE WHEN small THEN cohort END) AS n_small, count(*) FILTER (up) AS n_rises, round(max(size) / min(size), 6) AS size_ratio, count(DISTINCT cohort) AS n_cohorts FROM r"),
    "pa16_funnel": (lambda s, d: rounded(pa.funnel(E(s, d), "user_id", "ts", "event_type", ["view", "click", "purchase"]), 4), "WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, t0, min(ts) AS t1 FROM a LEFT JOIN events e USING (user_id) WHERE e.event_type = 'click' AND e.ts >= t0 GROUP BY 1, 2), c AS (SELECT user_id, t1, min(ts) AS t2 FROM b JOIN events e USING (user_id) WHERE e.event_type = 'purchase' AND e.ts >= t1 GROUP BY 1, 2), n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM c) AS z, (SELECT median((epoch_us(t1) - epoch_us(t0)) / 1e6) FROM b) AS p, (SELECT median((epoch_us(t2) - epoch_us(t1)) / 1e6) FROM c) AS q) SELECT 0 AS step, 'view' AS name, x AS users, 1.0::DOUBLE AS step_rate, 1.0::DOUBLE AS overall_rate, 0::BIGINT AS \"drop\", NULL::DOUBLE AS median_seconds FROM n UNION ALL SELECT 1, 'click', y, round(y / x, 4), round(y / x, 4), x - y, round(p, 4) FROM n UNION ALL SELECT 2, 'purchase', z, round(z / y, 4), round(z / x, 4), y - z, round(q, 4) FROM n"),
    "pa16_largest_drops": (
        lambda s, d: rounded(pa.largest_drops(pa.funnel(E(s, d), "user_id", "ts", "event_type", ["view", "click", "purchase"])), 4),
        """WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY 1),
        b AS (SELECT user_id, min(ts) AS t1 FROM a JOIN events USING (user_id) WHERE event_type = 'click' AND ts >= t0 GROUP BY 1),
        c AS (SELECT user_id, min(ts) AS t2 FROM b JOIN events USING (user_id) WHERE event_type = 'purchase' AND ts >= t1 GROUP BY 1),
        n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM c) AS z)
        SELECT CASE WHEN x - y >= y - z THEN 'click' ELSE 'purchase' END AS most_users, greatest(x - y, y - z) AS users_lost,
        CASE WHEN 1 - y / x >= 1 - z / y THEN 'click' ELSE 'purchase' END AS most_share, round(greatest(1 - y / x, 1 - z / y), 4) AS share_lost FROM n""",
    ),
    "pa11_retention_interval": (lambda s, d: rounded(pa.retention_curve(weekly_cohorts(s, d), confidence=0.95, mature=1), 4), f"""WITH {COH}, k AS (SELECT cohort FROM co GROUP BY 1 HAVING max("offset") >= 1), g AS (SELECT "offset", avg(rate) AS m, stddev_samp(rate) AS sd, count(*) AS n FROM co WHERE cohort IN (SELECT cohort FROM k) GROUP BY 1),
        h AS (SELECT *, sd / sqrt(n) * CASE n WHEN 2 THEN 12.706204736432095 WHEN 3 THEN 4.302652729911275 WHEN 4 THEN 3.182446305284263 WHEN 5 THEN 2.776445105197799 WHEN 6 THEN 2.570581835636197 END AS h FROM g)
        SELECT "offset", round(m, 4) AS mean, round(sd, 4) AS sd, n AS n_cohorts, CASE WHEN h IS NOT NULL THEN round(greatest(0, m - h), 4) END AS low, CASE WHEN h IS NOT NULL THEN round(least(1, m + h), 4) END AS high FROM h"""),
    "pa17_drivers": (lambda s, d: rounded(pa.drivers(L(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])), "SELECT 'l_quantity' AS \"column\", round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem"),
    "pa18_high_low": (lambda s, d: rounded(pa.high_low(L(s, d), "l_extendedprice", ["l_quantity", "l_tax"])), "WITH c AS (SELECT median(l_extendedprice) AS m FROM lineitem) SELECT 'l_quantity' AS attribute, round(avg(l_quantity) FILTER (l_extendedprice > m), 6) AS high, round(avg(l_quantity) FILTER (l_extendedprice <= m), 6) AS low FROM lineitem, c UNION ALL SELECT 'l_tax', round(avg(l_tax) FILTER (l_extendedprice > m), 6), round(avg(l_tax) FILTER (l_extendedprice <= m), 6) FROM lineitem, c"),
    "pa19_feature_importance": (lambda s, d: rounded(pa.feature_importance(L(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])), None),
    "pa20_period_change": (lambda s, d: rounded(pa.period_change(O(s, d), "o_orderdate", "month", F.round(F.sum("o_totalprice"), 2))), "WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), f AS (SELECT s.day::DATE AS day, coalesce(v, 0) AS v FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 MONTH)) AS day FROM g) s LEFT JOIN g ON g.day = s.day), p AS (SELECT *, lag(v) OVER (ORDER BY day) AS previous FROM f) SELECT day, v, previous, round((v - previous) / abs(nullif(previous, 0)), 6) AS change, CASE WHEN previous = 0 AND v <> 0 THEN 'new' ELSE 'known' END AS kind FROM p"),
    "pa21_rolling": (lambda s, d: rounded(pa.rolling(daily(s, d), "day", "v", 7), 5), f"SELECT day, round(v, 5) AS v, round(avg(v) OVER (ORDER BY day ROWS 6 PRECEDING), 5) AS rolling, round(sum(v) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 5) AS cumulative FROM {DV}"),
    "pa22_granularity": (lambda s, d: pa.granularity(E(s, d), "ts"), "SELECT (max(ts)::DATE - min(ts)::DATE)::INT AS days, 'day' AS unit FROM events"),
    "pa23_change_anomalies": (lambda s, d: rounded(pa.change_anomalies(daily(s, d), "day", "v"), 5), f"SELECT day, round(v, 5) AS v, round(c, 5) AS change, round(u, 5) AS usual FROM (SELECT *, avg(abs(c)) OVER () AS u FROM (SELECT *, v - lag(v) OVER (ORDER BY day) AS c FROM {DV})) WHERE abs(c) > 2 * u"),
    "pa24_structural_break": (lambda s, d: rounded(pa.structural_break(daily(s, d), "day", "v"), 4), f"SELECT half, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS variance, round(regr_slope(v, x), 4) AS slope FROM (SELECT v, ntile(2) OVER (ORDER BY day)::INT AS half, row_number() OVER (ORDER BY day)::DOUBLE AS x FROM {DV}) GROUP BY 1"),
    "pa25_divergence": (lambda s, d: rounded(pa.divergence(E(s, d), "event_type", "ts", "value")), "WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT event_type, regr_slope(v, (day - DATE '1970-01-01')::DOUBLE) AS sl FROM d GROUP BY 1) SELECT event_type, round(sl, 6) AS slope, sign(sl) <> sign(sum(sign(sl)) OVER ()) AS against FROM s"),
    "pa26_contributions": (lambda s, d: rounded(pa.contributions(two_years(s, d), ["o_orderstatus", "o_orderpriority"], "o_totalprice", year_is(2000)), 2), f"WITH {SHARES} SELECT dim, value, round(now, 2) AS now, round(before, 2) AS before, round(excess, 2) AS excess, round(share, 2) AS share FROM sh"),
    "pa26_explained": (lambda s, d: rounded(pa.explained(pa.contributions(two_years(s, d), ["o_orderstatus", "o_orderpriority"], "o_totalprice", year_is(2000))), 5), f"WITH {SHARES}, k AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY share DESC, value) AS k FROM sh) SELECT dim, max(CASE WHEN k = 1 THEN value END) AS top_value, round(max(CASE WHEN k = 1 THEN share END), 5) AS top1, round(sum(share), 5) AS top2, CASE WHEN max(CASE WHEN k = 1 THEN share END) > 0.5 THEN 'HIGH' WHEN sum(share) > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS power FROM k WHERE k <= 2 GROUP BY 1"),
    "pa26_root_cause_path": (lambda s, d: pa.root_cause(two_years(s, d), ["o_orderstatus", "o_orderpriority"], "o_totalprice", year_is(2000)), None),
    "pa27_anomaly_period": (
        lambda s, d: rounded(pa.anomaly_period(E(s, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")), "day", "v", ["event_type"]), 4),
        """WITH d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS sd FROM d GROUP BY 1 HAVING stddev_samp(v) > 0),
        z AS (SELECT event_type, day, v, m, direction, CASE direction WHEN 'above' THEN (v - m) / sd ELSE (m - v) / sd END - 0.5::DOUBLE AS score FROM d JOIN b USING (event_type), (SELECT unnest(['above', 'below']) AS direction)),
        s AS (SELECT *, sum(score) OVER w AS s, sum(v) OVER w AS sv, row_number() OVER w AS n FROM z WINDOW w AS (PARTITION BY event_type, direction ORDER BY day ROWS UNBOUNDED PRECEDING)),
        r AS (SELECT j.event_type, j.direction, i.day AS first_day, j.day AS last_day, j.n - i.n + 1 AS n_days, round(j.s - round(i.s - i.score, 6), 6) AS score, j.sv - i.sv + i.v AS actual, j.m * (j.n - i.n + 1) AS expected
            FROM s i JOIN s j ON i.event_type = j.event_type AND i.direction = j.direction AND i.day <= j.day),
        k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, last_day, direction, first_day) AS k FROM r WHERE score > 0)
        SELECT event_type, direction, first_day, last_day, n_days, round(score, 4) AS score, round(actual, 4) AS actual, round(expected, 4) AS expected, round(actual - expected, 4) AS excess, round(100 * (actual - expected) / abs(expected), 4) AS excess_pct FROM k WHERE k = 1""",
    ),
    "pa27_excess": (lambda s, d: rounded(pa.excess(daily(s, d), "day", "v", "2024-01-20"), 5), f"WITH b AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM {DV} WHERE day < DATE '2024-01-20') SELECT day, round(v, 5) AS v, round(m, 5) AS expected, round(v - m, 5) AS excess, round((v - m) / sd, 5) AS z FROM {DV}, b WHERE day >= DATE '2024-01-20'"),
    "pa28_opportunity": (lambda s, d: rounded(pa.opportunity(O(s, d), F.col("o_orderstatus") == "O", "o_totalprice", 0.1), 2), "SELECT n, round(u, 2) AS unit, f AS factor, round(n * 0.1::DOUBLE * u * f, 2) AS size FROM (SELECT count(*) FILTER (o_orderstatus = 'O') AS n, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS u FROM orders), (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5]::DOUBLE[]) AS f)"),
    "pa29_mix_rate": (lambda s, d: rounded(pa.mix_rate(two_years(s, d), "o_orderpriority", F.col("o_orderstatus") == "F", year_is(2000)), 8), "WITH g AS (SELECT o_orderpriority, count(*) FILTER (year(o_orderdate) = 1999) AS n0, count(*) FILTER (year(o_orderdate) = 2000) AS n1, count(*) FILTER (o_orderstatus = 'F' AND year(o_orderdate) = 1999) AS h0, count(*) FILTER (o_orderstatus = 'F' AND year(o_orderdate) = 2000) AS h1 FROM orders GROUP BY 1), s AS (SELECT *, n0 / sum(n0) OVER () AS s0, n1 / sum(n1) OVER () AS s1, coalesce(h0 / nullif(n0, 0), 0) AS r0, coalesce(h1 / nullif(n1, 0), 0) AS r1 FROM g) SELECT o_orderpriority, round(s0 * (r1 - r0), 8) AS rate_effect, round((s1 - s0) * r0, 8) AS mix_effect, round((s1 - s0) * (r1 - r0), 8) AS interaction FROM s"),
    "pa30_nps": (lambda s, d: rounded(pa.nps(table(s, d, "part"), "p_brand", F.col("p_size") % 11)), "SELECT p_brand, count(*) AS n, round(100.0 * (count(*) FILTER (p_size % 11 >= 9) - count(*) FILTER (p_size % 11 <= 6)) / count(p_size), 6) AS nps FROM part GROUP BY 1"),
    "pa31_new_returning": (lambda s, d: pa.new_returning(O(s, d), "o_custkey", "o_orderdate"), "WITH e AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS month FROM orders), f AS (SELECT month, min(month) OVER (PARTITION BY u) AS fi FROM e) SELECT month, count(*) FILTER (month = fi) AS n_new, count(*) FILTER (month > fi) AS n_returning FROM f GROUP BY 1"),
}
