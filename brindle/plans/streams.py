"""Streaming queries: events are replayed as a stream into tables, oracles are the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.profiling import rounded
from brindle.sources.tables import table
from brindle.streaming import monitors as mo
from brindle.streaming import sinks, stateful


def drained(build, mode):
    def run(s, d):
        return rounded(mo.run_once(build(mo.read_events(s, d)), f"st_{uuid.uuid4().hex}", mode))

    return run


def banded(s, d):
    bands = mo.run_once(mo.band_moments(mo.read_events(s, d)), f"st_{uuid.uuid4().hex}", "complete")
    points = table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("v"))
    return rounded(mo.outside_band(points, bands).select("day", "event_type", "v", "mean", "sd"), 5)


def srm(s, d):
    counts = mo.run_once(mo.assignment_counts(mo.read_events(s, d), (F.col("user_id") % 2).cast("int"), "60 days"), f"st_{uuid.uuid4().hex}", "complete")
    return rounded(mo.srm_verdict(counts, {0: 1, 1: 1}))


def watched(s, d):
    latest = mo.run_once(mo.freshness(mo.read_events(s, d)), f"st_{uuid.uuid4().hex}", "complete")
    clock = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return rounded(mo.freshness_status(latest, clock).select("event_type", "age_hours", "status"), 4)


def validated(s, d):
    stream = mo.validated(mo.read_events(s, d), {"high": F.col("value") > 100, "no_user": F.col("user_id").isNull()})
    rows = mo.run_once(stream, f"st_{uuid.uuid4().hex}", "append")
    return rows.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


def third(at):
    """Which third of the events a row arrives with: in order of their ids, but every tenth row comes one third late."""
    return F.least(F.lit(2), at + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))


def thirds(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.agg(F.max("event_id").alias("top"))
    return e.crossJoin(F.broadcast(n)).withColumn("part", third(F.least(F.lit(2), F.floor(3 * F.col("event_id") / (F.col("top") + 1))).cast("int"))).drop("top")  # one row


def ordered(s, d):
    """Rows arrive up to twenty days out of order, in three runs of the stream."""
    root = sinks.stream_root(s, f"st6_{uuid.uuid4().hex}")
    build = lambda e: stateful.ordered_test(e, "event_type", "ts", "event_id", "value", 48.0, "22 days")
    sinks.replay(thirds(s, d), F.col("part"), 3, root, build, sinks.epochs_into(f"{root}/out"), "update")
    schema = T.StructType().add("event_type", "string").add("n", "long").add("log_e", "double").add("n_seen", "long").add("log_e_seen", "double")
    rows = sinks.latest(s, f"{root}/out", schema, ["event_type"])
    return rounded(rows.select("event_type", F.col("n_seen").alias("n"), F.col("log_e_seen").alias("log_e")), 3)


def watch(s, d):
    root = sinks.stream_root(s, f"st5_{uuid.uuid4().hex}")
    clock = 1_706_745_600_000  # 2024-02-01
    build = lambda e: stateful.freshness_watch(e, "event_type", "ts", clock_ms=clock)
    sparse = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type <> 'signup' OR dayofmonth(ts) % 7 = 3")
    sinks.replay(sparse, F.floor(F.dayofmonth("ts") / 16), 2, root, build, sinks.epochs_into(f"{root}/out"), timers=True)
    schema = T.StructType().add("event_type", "string").add("last", "long").add("middle_gap", "long").add("age", "long").add("cadence", "string").add("status", "string").add("asked_ms", "long")
    rows = sinks.latest(s, f"{root}/out", schema, ["event_type"])
    return rows.select("event_type", F.date_from_unix_date(F.col("last").cast("int")).alias("last"), "middle_gap", "age", "cadence", "status")


def split(s, d):
    root = sinks.stream_root(s, f"st7_{uuid.uuid4().hex}")
    e = thirds(s, d)
    rules = {"high": F.col("value") > 100, "odd": F.col("user_id") % 50 == 7, "no_user": F.col("user_id").isNull()}
    sinks.replay(e, F.col("part"), 3, root, lambda x: x, sinks.split_sinks(root, rules, "ts", "2 days"))
    return sinks.split_rows(s, root, e.schema).groupBy("kind", F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


def as_text(df, *cols):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) if c in cols else F.col(c) for c in df.columns])


HOURS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"
SLIDE = "(SELECT e.*, date_trunc('day', ts) + to_days(k::INT) AS until FROM events e, (SELECT unnest(range(1, {0} + 1)) AS k))"

QUERIES = {
    "st1_srm_counts": (drained(lambda e: mo.assignment_counts(e, (F.col("user_id") % 2).cast("int"), "60 days"), "complete"), "SELECT (user_id % 2)::INT AS variant, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "st1_srm_verdict": (
        srm,
        """WITH c AS (SELECT user_id % 2 AS v, count(DISTINCT user_id) AS n FROM events GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n FROM c),
        x AS (SELECT max(t.n) AS n, sum(pow(c.n - t.n / 2, 2) / (t.n / 2)) AS chi2 FROM c, t)
        SELECT n, round(chi2, 6) AS chi2, CASE WHEN chi2 <= 3.841459 THEN 'PASS' WHEN chi2 <= 6.634897 THEN 'WARNING' ELSE 'BLOCK' END AS status FROM x""",
    ),
    "st5_freshness_status": (
        watched,
        """WITH a AS (SELECT event_type, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 3600.0 AS h FROM events GROUP BY 1)
        SELECT event_type, round(h, 4) AS age_hours, CASE WHEN h <= 2 THEN 'fresh' WHEN h <= 26 THEN 'late' ELSE 'stale' END AS status FROM a""",
    ),
    "st2_metric_windows": (lambda s, d: as_text(drained(mo.metric_windows, "complete")(s, d), "start"), HOURS),
    "st3_anomaly_bands": (banded, f"WITH b AS (SELECT until, event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM {SLIDE.format(14)} GROUP BY 1, 2), p AS (SELECT ts::DATE AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2) SELECT day, event_type, round(v, 5) AS v, round(mean, 5) AS mean, round(sd, 5) AS sd FROM p JOIN b USING (event_type) WHERE until = day AND abs(v - mean) > 3 * sd"),
    "st4_miss_rate": (lambda s, d: as_text(drained(mo.miss_rate, "complete")(s, d), "until"), f"SELECT strftime(until, '%Y-%m-%d %H:%M') AS until, event_type, round(count(*) / 7, 6) AS per_day FROM {SLIDE.format(7)} GROUP BY 1, 2"),
    "st5_freshness": (lambda s, d: as_text(drained(mo.freshness, "complete")(s, d), "last"), "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY 1"),
    "st6_sequential": (lambda s, d: rounded(mo.run_once(mo.sequential(mo.read_events(s, d), 10.0), f"st_{uuid.uuid4().hex}", "update"), 3).drop("s1", "s2"), "WITH s AS (SELECT event_type, ts, event_id, value - 10 AS d, coalesce(sum(value - 10) OVER w, 0) AS s1, coalesce(sum((value - 10) * (value - 10)) OVER w, 0) AS s2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_type, count(*) AS n, round(least(500.0, sum(ln(greatest(1e-10, 1 + CASE WHEN s2 > 0 THEN greatest(-0.5, least(0.5, s1 / s2)) ELSE 0 END * d)))), 3) AS log_e FROM s GROUP BY 1"),
    "st6_ordered_test": (
        ordered,
        """WITH s AS (SELECT event_type, event_id, ts, value - 48 AS d, coalesce(sum(value - 48) OVER w, 0) AS s1, coalesce(sum((value - 48) * (value - 48)) OVER w, 0) AS s2 FROM events
            WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_type, count(*) AS n, round(least(500.0, sum(ln(greatest(1e-10, 1 + CASE WHEN s2 > 0 THEN greatest(-0.5, least(0.5, s1 / s2)) ELSE 0 END * d)))), 3) AS log_e FROM s GROUP BY 1""",
    ),
    "st5_freshness_watch": (
        watch,
        """WITH d AS (SELECT DISTINCT event_type, ts::DATE AS day FROM events WHERE event_type <> 'signup' OR dayofmonth(ts) % 7 = 3), g AS (SELECT event_type, day, day - lag(day) OVER (PARTITION BY event_type ORDER BY day) AS gap FROM d),
        a AS (SELECT event_type, max(day) AS last, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS gaps FROM g GROUP BY 1),
        m AS (SELECT event_type, last, gaps[len(gaps) // 2 + 1] AS middle_gap, DATE '2024-02-01' - last AS age FROM a),
        c AS (SELECT *, CASE WHEN middle_gap IS NULL THEN 'unknown' WHEN middle_gap <= 1.5 THEN 'daily' WHEN middle_gap <= 8 THEN 'weekly' ELSE 'other' END AS cadence FROM m)
        SELECT event_type, last, middle_gap, age, cadence, CASE WHEN age > 90 THEN 'historical' WHEN cadence = 'daily' AND age > 2 OR cadence = 'weekly' AND age > 10 THEN 'stale' ELSE 'fresh' END AS status FROM c""",
    ),
    "st7_split_sinks": (
        split,
        """WITH e AS (SELECT *, least(2, least(2, floor(3 * event_id / ((SELECT max(event_id) FROM events) + 1))) + (event_id % 10 = 0)::INT) AS part FROM events),
        w AS (SELECT a.part, max(b.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT part FROM e) a JOIN e b ON b.part < a.part GROUP BY 1)
        SELECT CASE WHEN ts < mark THEN 'late' WHEN value > 100 OR user_id % 50 = 7 THEN 'diverted' ELSE 'passed' END AS kind, concat_ws(',', CASE WHEN value > 100 THEN 'high' END, CASE WHEN user_id % 50 = 7 THEN 'odd' END) AS broken, count(*) AS n
        FROM e LEFT JOIN w USING (part) GROUP BY 1, 2""",
    ),
    "st7_validation": (validated, "SELECT CASE WHEN value > 100 THEN 'high' ELSE '' END AS broken, count(*) AS n FROM events GROUP BY 1"),
}
