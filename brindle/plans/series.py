"""Forecast queries: daily mean value of every event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import series as se
from brindle.plans.profiling import rounded
from brindle.sources.tables import table


def daily(s, d):
    e = table(s, d, "events").where("dayofmonth(ts) NOT IN (5, 6)")
    return se.filled(e, "event_type", "ts", "value").withColumn("value", F.round("value", 6))


RAW = "(SELECT event_type AS series, ts::DATE AS day, avg(value) AS v FROM events WHERE dayofmonth(ts) NOT IN (5, 6) GROUP BY 1, 2)"
FILL = f"g AS (SELECT series, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {RAW} GROUP BY 1), f AS (SELECT series, day, round(last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS value FROM g LEFT JOIN {RAW} USING (series, day)), i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM f)"
ACF = "c AS (SELECT series, i, n, value - avg(value) OVER (PARTITION BY series) AS d, var_pop(value) OVER (PARTITION BY series) AS var FROM i), a AS (SELECT x.series, (y.i - x.i)::INT AS lag, sum(x.d * y.d) / (max(x.n) - max(y.i - x.i)) / max(x.var) AS acf, max(x.n) AS n FROM c x JOIN c y ON x.series = y.series AND y.i > x.i AND y.i - x.i <= least(365, x.n // 2) GROUP BY 1, 2)"

QUERIES = {
    "fc1_gap_fill": (daily, f"WITH {FILL} SELECT series, day, value FROM f"),
    "fc2_naive_last": (lambda s, d: se.naive(daily(s, d), 3), f"WITH {FILL} SELECT series, h, arg_max(value, i) AS forecast FROM i, (SELECT unnest([1, 2, 3])::INT AS h) GROUP BY 1, 2"),
    "fc2_naive_mean": (lambda s, d: rounded(se.naive(daily(s, d), 3, "mean")), f"WITH {FILL} SELECT series, h, round(avg(value), 6) AS forecast FROM i, (SELECT unnest([1, 2, 3])::INT AS h) WHERE i >= n - 7 GROUP BY 1, 2"),
    "fc2_naive_drift": (lambda s, d: rounded(se.naive(daily(s, d), 3, "drift")), f"WITH {FILL} SELECT series, h, round(arg_max(value, i) + h * (arg_max(value, i) - arg_min(value, i)) / (max(n) - 1), 6) AS forecast FROM i, (SELECT unnest([1, 2, 3])::INT AS h) GROUP BY 1, 2"),
    "fc2_naive_seasonal": (lambda s, d: se.naive(daily(s, d), 10, "seasonal"), f"WITH {FILL} SELECT series, h, value AS forecast FROM i JOIN (SELECT unnest(range(1, 11))::INT AS h) ON i = n - 7 + (h - 1) % 7"),
    "fc3_autocorrelation": (lambda s, d: rounded(se.autocorrelation(daily(s, d)).drop("n")), f"WITH {FILL}, {ACF} SELECT series, lag, round(acf, 6) AS acf FROM a"),
    "fc3_peaks": (lambda s, d: rounded(se.acf_peaks(se.autocorrelation(daily(s, d)))), f"WITH {FILL}, {ACF}, p AS (SELECT *, lag(acf) OVER w AS l, lead(acf) OVER w AS r FROM a WINDOW w AS (PARTITION BY series ORDER BY lag)) SELECT series, lag, round(acf, 6) AS acf FROM p WHERE acf > coalesce(l, 1) AND acf > coalesce(r, -2) AND acf > 2 / sqrt(n)"),
    "fc5_simple_smoothing": (lambda s, d: rounded(se.simple(daily(s, d), 0.3)), f"WITH {FILL} SELECT series, round(sum(value * CASE WHEN i = 0 THEN power(0.7, n - 1) ELSE 0.3::DOUBLE * power(0.7, n - 1 - i) END), 6) AS level FROM i GROUP BY 1"),
    "fc9_simple_fitted": (
        lambda s, d: rounded(se.simple_fitted(daily(s, d), 0.3)),
        f"""WITH {FILL}, l AS (SELECT a.series, a.day, a.value, CASE WHEN a.i = 0 THEN a.value ELSE (SELECT sum(b.value * CASE WHEN b.i = 0 THEN power(0.7::DOUBLE, a.i - 1) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, a.i - 1 - b.i) END) FROM i b WHERE b.series = a.series AND b.i < a.i) END AS fitted FROM i a)
        SELECT series, day, round(value, 6) AS value, round(fitted, 6) AS fitted, round(value - fitted, 6) AS residual FROM l""",
    ),
    "fc9_holt_winters_fitted": (lambda s, d: rounded(se.holt_winters_fitted(daily(s, d), 7, 0.3)), None),
    "fc6_holt": (
        lambda s, d: rounded(se.holt(daily(s, d), 0.3, 0.1)),
        f"""WITH RECURSIVE {FILL}, h AS (SELECT a.series, 0::BIGINT AS i, a.value AS l, coalesce(b.value - a.value, 0) AS b FROM i a LEFT JOIN i b ON b.series = a.series AND b.i = 1 WHERE a.i = 0
            UNION ALL SELECT h.series, h.i + 1, 0.3::DOUBLE * x.value + 0.7::DOUBLE * (h.l + h.b), 0.1::DOUBLE * (0.3::DOUBLE * x.value + 0.7::DOUBLE * (h.l + h.b) - h.l) + 0.9::DOUBLE * h.b FROM h JOIN i x ON x.series = h.series AND x.i = h.i + 1)
        SELECT series, round(arg_max(l, i), 6) AS level, round(arg_max(b, i), 6) AS trend FROM h GROUP BY 1""",
    ),
    "fc7_fc8_fc9_holt_winters": (lambda s, d: rounded(se.holt_winters(daily(s, d), 7, 7)), None),
}
