"""Suites of checks and comparisons of segments on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import segments as sg
from brindle.operators import suites as su
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def short(rows):
    return rows.select("check", "ok", "status", "n", "n_bad")


def structural(s, d):
    o = table(s, d, "orders")
    config = {
        "schema": T.StructType().add("o_orderkey", "long").add("o_totalprice", "string").add("o_note", "string"),
        "primary_key": ["o_custkey", "o_orderdate"],
        "required": ["o_custkey", "o_totalprice"],
        "dates": {"day": "o_orderdate", "start": "1995-02-01", "end": "2000-01-01", "max_gap": 1},
        "parent": {"df": table(s, d, "customer").where("c_custkey % 7 > 0"), "child_key": "o_custkey", "key": "c_custkey"},
        "domains": {"status": ~F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 100000},
        "rows": (1, 10),
    }
    return short(su.structural(o, config))


def shares(s, d):
    """Sums of a day and flag, with a share of the flag's gross that is 2 percent too high for one flag."""
    li = table(s, d, "lineitem").withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "day": F.col("l_shipdate").cast("date")})
    daily = li.groupBy("l_returnflag", "day").agg(F.sum("net").alias("net"), F.sum("l_extendedprice").alias("gross"))
    high = F.when(F.col("l_returnflag") == "R", 1.02).otherwise(1.0)
    return daily.withColumn("pct", 100.0 * high * F.col("gross") / F.sum("gross").over(Window.partitionBy("l_returnflag")))


def logical(s, d):
    config = {
        "metric": "net",
        "tolerance": 0.05,
        "percentages": {"pct": "pct", "group": "l_returnflag"},
        "monotonic": {"order": "day", "value": "net"},
        "trend": {"day": "day", "metric": "net", "window": 7, "max_z": 3.0},
        "continuity": {"day": "day", "metric": "net", "jump": 0.5},
        "ratio": {"num": "net", "den": "gross", "low": 0.93, "high": 1.0},
        "future": {"day": "day", "as_of": "1998-01-01"},
        "balance": "l_returnflag",
    }
    return short(su.logical(shares(s, d), config, summary=table(s, d, "lineitem").select(F.col("l_extendedprice").alias("net"))))


def business(s, d):
    o = table(s, d, "orders")
    rules = {
        "ranges": {"o_totalprice": (0.0, 100000.0)},
        "no_negative": ["o_totalprice"],
        "identities": {"late": F.year("o_orderdate") > 1998},
        "metrics": {"aov": F.avg("o_totalprice"), "orders": F.count("*"), "revenue": F.sum("o_totalprice")},
        "relationships": [*su.DEFAULT_RELATIONSHIPS, {"left": "aov", "right": "revenue / (orders + 1)", "tolerance": 1e-9}],
        "segments": {"o_orderstatus": ["F", "O", "P", "X"]},
        "cardinality": {"o_orderpriority": (1, 4)},
        "temporal": {"day": "o_orderdate", "metric": "o_totalprice", "limit": 100.0},
    }
    return short(su.business(o, rules))


def verdicts(s, d):
    """Default rules on a table whose columns bear the known names, beside columns that only hold parts of them."""
    e = table(s, d, "lineitem").select(
        F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") - 20000).alias("revenue"), (F.col("l_discount") * 12).alias("bounce_rate"), F.col("l_returnflag").alias("device"),
        (-F.col("l_tax")).alias("account_balance"), (F.col("l_tax") - 1).alias("discount"), (F.col("l_linenumber") - 9).alias("n_orders_total"),
    )
    frames = {"structural": su.structural(table(s, d, "orders")), "business": su.business(e), "nothing": su.business(table(s, d, "nation"))}
    rows = [su.verdict(f).select(F.lit(k).alias("suite"), "*") for k, f in frames.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


ORDERS = "(SELECT o_orderpriority AS seg, o_totalprice AS x FROM orders)"
STATUS = "CASE WHEN rate > 0.05 THEN 'BLOCKER' WHEN rate > 0 THEN 'WARNING' ELSE 'PASS' END"
OK = "SELECT name AS \"check\", status IN ('PASS', 'WARNING', 'WARN') AS ok, status, n::BIGINT AS n, n_bad::BIGINT AS n_bad FROM ("

QUERIES = {
    "val7_structural_runner": (
        structural,
        f"""WITH k AS (SELECT count(*) AS c, o_custkey IS NULL OR o_orderdate IS NULL AS z FROM orders GROUP BY o_custkey, o_orderdate),
        dy AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)),
        dr AS (SELECT count(*) AS n, count(*) FILTER (day < DATE '1995-02-01' OR day > DATE '2000-01-01') AS outside, count(*) FILTER (gap > 1) AS gaps FROM dy),
        r AS (SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL AND o_custkey IS NOT NULL) AS n_bad, n_bad / n AS rate FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 > 0) ON o_custkey = c_custkey),
        v AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS a, count(*) FILTER (o_totalprice > 100000) AS b, greatest(a, b) / n AS rate FROM orders),
        m AS (SELECT count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS a, count(*) FILTER (o_totalprice IS NULL) AS b, greatest(a, b) / n AS rate FROM orders)
        {OK} SELECT 'schema' AS name, 'BLOCKER' AS status, 3 AS n, 2 AS n_bad
        UNION ALL SELECT 'primary_key', CASE WHEN bool_or(c > 1 OR z) THEN 'BLOCKER' ELSE 'PASS' END, sum(c), coalesce(sum(c) FILTER (z), 0) + coalesce(sum(c) FILTER (c > 1), 0) FROM k
        UNION ALL SELECT 'completeness', CASE WHEN rate > 0.5 THEN 'BLOCKER' WHEN rate > 0.2 THEN 'SEVERE' WHEN rate >= 0.05 THEN 'WARNING' ELSE 'PASS' END, n, a + b FROM m
        UNION ALL SELECT 'date_range', CASE WHEN outside > 0 THEN 'FAIL' WHEN gaps > 0 THEN 'WARNING' ELSE 'PASS' END, n, outside + gaps FROM dr
        UNION ALL SELECT 'referential_integrity', {STATUS}, n, n_bad FROM r UNION ALL SELECT 'value_domain', {STATUS}, n, a + b FROM v
        UNION ALL SELECT 'row_count', CASE WHEN count(*) NOT BETWEEN 1 AND 10 THEN 'BLOCKER' ELSE 'PASS' END, count(*), (count(*) NOT BETWEEN 1 AND 10)::INT FROM orders)""",
    ),
    "val17_logical_runner": (
        logical,
        f"""WITH g AS (SELECT l_returnflag AS f, l_shipdate::DATE AS day, sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1, 2),
        p AS (SELECT f, abs(sum(pct) - 100) AS off FROM (SELECT f, 100.0 * CASE WHEN f = 'R' THEN 1.02 ELSE 1.0 END * gross / sum(gross) OVER (PARTITION BY f) AS pct FROM g) GROUP BY 1),
        b AS (SELECT f, count(*) AS n FROM g GROUP BY 1),
        t AS (SELECT (SELECT sum(net) FROM g) AS a, (SELECT sum(l_extendedprice) FROM lineitem) AS b, (SELECT count(*) FROM g) AS n),
        st AS (SELECT net < lag(net) OVER (ORDER BY day, net) AS down FROM g),
        dy AS (SELECT day, sum(net) AS v FROM g GROUP BY 1),
        w AS (SELECT v, lag(v) OVER (ORDER BY day) AS prev, avg(v) OVER s AS m, stddev_samp(v) OVER s AS sd, count(*) OVER s AS k FROM dy WINDOW s AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
        x AS (SELECT count(*) AS n, count(*) FILTER (k = 7 AND sd > 0 AND abs(v - m) > 3 * sd) AS far, count(*) FILTER (abs(v - prev) > 0.5::DOUBLE * abs(prev)) AS jumps FROM w)
        {OK} SELECT 'aggregation_consistency' AS name, CASE WHEN abs(b - a) > 0.05::DOUBLE * abs(b) THEN 'BLOCKER' ELSE 'PASS' END AS status, n, (abs(b - a) > 0.05::DOUBLE * abs(b))::INT AS n_bad FROM t
        UNION ALL SELECT 'percentages_sum', CASE WHEN max(off) <= 0.5 THEN 'PASS' WHEN max(off) <= 1 THEN 'WARN' ELSE 'FAIL' END, count(*), count(*) FILTER (off > 0.5) FROM p
        UNION ALL SELECT 'monotonic', CASE WHEN bool_or(down) THEN 'FAIL' ELSE 'PASS' END, count(down), count(*) FILTER (down) FROM st
        UNION ALL SELECT 'trend_consistency', CASE WHEN far > 0 THEN 'WARNING' ELSE 'PASS' END, n, far FROM x
        UNION ALL SELECT 'trend_continuity', CASE WHEN jumps = 0 THEN 'PASS' WHEN jumps <= 2 THEN 'WARNING' ELSE 'BLOCKER' END, n, jumps FROM x
        UNION ALL SELECT 'ratio_bounds', CASE WHEN count(*) FILTER (net / gross NOT BETWEEN 0.93 AND 1.0) > 0 THEN 'BLOCKER' ELSE 'PASS' END, count(*), count(*) FILTER (net / gross NOT BETWEEN 0.93 AND 1.0) FROM g
        UNION ALL SELECT 'no_future_dates', CASE WHEN max(day) > DATE '1998-01-01' THEN 'BLOCKER' ELSE 'PASS' END, count(day), count(*) FILTER (day > DATE '1998-01-01') FROM g
        UNION ALL SELECT 'group_balance', CASE WHEN min(n) < 10 OR max(n) > 100 * min(n) THEN 'WARNING' ELSE 'PASS' END, count(*), count(*) FILTER (n < 10) FROM b)""",
    ),
    "val24_business_runner": (
        business,
        f"""WITH r AS (SELECT 'range_o_totalprice' AS name, count(*) FILTER (o_totalprice NOT BETWEEN 0 AND 100000) AS n_bad, count(*) AS n FROM orders
        UNION ALL SELECT 'negative_o_totalprice', count(*) FILTER (o_totalprice < 0), count(*) FROM orders
        UNION ALL SELECT 'late', count(*) FILTER (year(o_orderdate) > 1998), count(*) FROM orders),
        q AS (SELECT *, n_bad / n AS rate FROM r),
        dy AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT v, lag(v) OVER (ORDER BY day) AS p FROM dy),
        h AS (SELECT count(*) AS n, count(*) FILTER (CASE WHEN p = 0 THEN v <> 0 ELSE abs(v - p) > abs(p) END) AS n_bad FROM c)
        {OK} SELECT name, {STATUS} AS status, n, n_bad FROM q
        UNION ALL SELECT 'relationship_1', 'PASS', 1, 0 UNION ALL SELECT 'relationship_2', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, 1, 1 FROM orders
        UNION ALL SELECT 'segments_o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O', 'P', 'X')) < 4 THEN 'FAIL' WHEN count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P', 'X')) > 0 THEN 'WARN' ELSE 'PASS' END,
            count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) FILTER (o_orderstatus NOT IN ('F', 'O', 'P', 'X')) + 4 - count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O', 'P', 'X')) FROM orders
        UNION ALL SELECT 'cardinality_o_orderpriority', CASE WHEN count(DISTINCT o_orderpriority) BETWEEN 1 AND 4 THEN 'PASS' ELSE 'WARNING' END, count(DISTINCT o_orderpriority), (count(DISTINCT o_orderpriority) NOT BETWEEN 1 AND 4)::INT FROM orders
        UNION ALL SELECT 'period_change', CASE WHEN n_bad > 0 THEN 'FAIL' ELSE 'PASS' END, n, n_bad FROM h)""",
    ),
    "val24_default_rules": (
        verdicts,
        """WITH c AS (SELECT 'structural' AS suite, (SELECT count(*) FROM orders) >= 1 AS ok
        UNION ALL SELECT 'structural', (SELECT greatest(count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_orderstatus IS NULL), count(*) FILTER (o_totalprice IS NULL),
            count(*) FILTER (o_orderdate IS NULL), count(*) FILTER (o_orderpriority IS NULL)) / count(*) FROM orders) <= 0.2
        UNION ALL SELECT 'business', (SELECT count(*) FILTER (l_quantity < 0) / count(*) FROM lineitem) <= 0.05
        UNION ALL SELECT 'business', (SELECT count(*) FILTER (l_extendedprice < 20000) / count(*) FROM lineitem) <= 0.05
        UNION ALL SELECT 'business', (SELECT count(*) FILTER (l_discount * 12 NOT BETWEEN 0 AND 1) / count(*) FROM lineitem) <= 0.05
        UNION ALL SELECT 'business', (SELECT count(DISTINCT l_returnflag) BETWEEN 2 AND 10 FROM lineitem) OR true)
        SELECT suite, count(*) AS checks_run, count(*) FILTER (ok) AS checks_passed, count(*) FILTER (NOT ok) AS checks_failed, bool_and(ok) AS overall_ok FROM c GROUP BY suite
        UNION ALL SELECT 'nothing', 0, 0, 0, true""",
    ),
    "pa5_segment_summary": (
        lambda s, d: rounded(sg.segment_summary(table(s, d, "orders"), "o_orderpriority", "o_totalprice"), 4),
        f"""SELECT seg AS segment, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(stddev_samp(x), 4) AS sd,
        count(*) < 30 OR count(*) / 6.0 * (pow(avg(pow(x - m, 3)) / pow(any_value(p), 3), 2) + pow(avg(pow(x - m, 4)) / pow(any_value(p), 4) - 3, 2) / 4) > -2 * ln(0.05) AS ranks_needed
        FROM (SELECT *, avg(x) OVER (PARTITION BY seg) AS m, stddev_pop(x) OVER (PARTITION BY seg) AS p FROM {ORDERS}) GROUP BY seg""",
    ),
    "pa5_segment_rank_tests": (
        lambda s, d: rounded(sg.compare_segments(table(s, d, "orders"), "o_orderpriority", "o_totalprice", test="mann-whitney", tails=False).drop("df"), 4),
        f"""WITH o AS (SELECT a.seg AS a, b.seg AS b FROM (SELECT DISTINCT seg FROM {ORDERS}) a JOIN (SELECT DISTINCT seg FROM {ORDERS}) b ON a.seg < b.seg),
        r AS (SELECT a, b, x, seg = a AS isa, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rk, count(*) OVER (PARTITION BY a, b, x) AS ties FROM o JOIN {ORDERS} ON seg IN (a, b)),
        g AS (SELECT a, b, count(*) FILTER (isa) AS na, count(*) FILTER (NOT isa) AS nb, sum(rk) FILTER (isa) AS rs, sum(ties::DOUBLE * ties - 1) AS tie, avg(x) FILTER (isa) AS ma, avg(x) FILTER (NOT isa) AS mb,
            var_samp(x) FILTER (isa) AS va, var_samp(x) FILTER (NOT isa) AS vb FROM r GROUP BY 1, 2),
        u AS (SELECT *, rs - na * (na + 1) / 2 AS u, na + nb AS n FROM g)
        SELECT a, b, 'mann-whitney' AS test_used, round(u, 4) AS stat, round(sign(u - na * nb / 2) * greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12.0 * (n + 1 - tie / (n * (n - 1.0)))), 4) AS z,
        round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (n - 2)), 4) AS effect_size FROM u""",
    ),
    "exp17_segment_tests": (
        lambda s, d: rounded(sg.segment_effects(table(s, d, "orders").withColumn("arm", F.col("o_custkey") % 2), "arm", ["o_orderpriority", "o_orderstatus"], "o_totalprice", 0, 1, tails=False), 4),
        """WITH r AS (SELECT o_custkey % 2 AS t, o_totalprice AS y, unnest(['o_orderpriority', 'o_orderstatus']) AS dim, unnest([o_orderpriority, o_orderstatus]) AS value FROM orders),
        g AS (SELECT dim, value, count(*) FILTER (t = 0) AS n0, count(*) FILTER (t = 1) AS n1, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS e, var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0) AS s0,
            var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) AS s1 FROM r GROUP BY 1, 2),
        o AS (SELECT avg(o_totalprice) FILTER (o_custkey % 2 = 1) - avg(o_totalprice) FILTER (o_custkey % 2 = 0) AS overall FROM orders),
        p AS (SELECT *, sum(e / (s0 + s1)) OVER (PARTITION BY dim) / sum(1 / (s0 + s1)) OVER (PARTITION BY dim) AS pooled FROM g)
        SELECT dim, value, n0, n1, round(e, 4) AS effect, round(sqrt(s0 + s1), 4) AS se, round((s0 + s1) * (s0 + s1) / (s0 * s0 / (n0 - 1) + s1 * s1 / (n1 - 1)), 4) AS df, round(e / sqrt(s0 + s1), 4) AS t,
        round(overall, 4) AS overall, sign(e) * sign(overall) < 0 AS reversal, round(sum(pow(e - pooled, 2) / (s0 + s1)) OVER (PARTITION BY dim), 4) AS q, count(*) OVER (PARTITION BY dim) - 1 AS q_df FROM p, o""",
    ),
}
