"""Structured Streaming forms of the checks; each has a batch form that it must agree with.

Functions take and return DataFrames that work on streams and tables alike,
except where a sink is needed (``run_once``: available-now, for replays).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "1 day"


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table's files as a stream; a micro-batch has a hundred files at most, which bounds what keyed state gathers."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{folder}/{name}.parq*t")  # a pattern, as one file is no folder
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def metric_windows(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Count and sum by tumbling window and event type; final once the watermark passes."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def assignment_counts(events: DataFrame, variant: Column, delay: str = DELAY) -> DataFrame:
    """Running counts of distinct units per variant, for the sample-ratio verdict."""
    units = events.withColumn("variant", variant).withWatermark("ts", delay)
    units = units.dropDuplicatesWithinWatermark(["user_id"]) if events.isStreaming else units.dropDuplicates(["user_id"])
    return units.groupBy("variant").agg(F.count("*").alias("n"))


def band_moments(events: DataFrame, width: str = "14 days", slide: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Moments of a metric in sliding windows; the band is joined from them in batch."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return g.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).select(F.col("w.end").alias("until"), "event_type", "n", "mean", "sd")


def outside_band(points: DataFrame, bands: DataFrame, width: float = 3.0) -> DataFrame:
    """Points (day, event_type, v) against the band of the window that ended at their day."""
    j = points.join(bands.withColumn("day", F.to_date("until")), ["day", "event_type"])
    return j.where(F.abs(F.col("v") - F.col("mean")) > width * F.col("sd"))


def miss_rate(events: DataFrame, days: int = 7, delay: str = DELAY) -> DataFrame:
    """Misses per day and type over sliding windows."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "event_type")
    return g.agg((F.count("*") / F.lit(days)).alias("per_day")).select(F.col("w.end").alias("until"), "event_type", "per_day")


def freshness(events: DataFrame) -> DataFrame:
    """Latest event time by type."""
    return events.groupBy("event_type").agg(F.max("ts").alias("last"))


def validated(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break; a sink splits on whether there are any."""
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())
    return events.withColumn("broken", broken)


def split_sink(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good(batch.where(F.size("broken") == 0).drop("broken"), epoch)
        bad(batch.where(F.size("broken") > 0), epoch)
        batch.unpersist()

    return each


STATE = "n long, s1 double, s2 double, log_e double"
RESULT = "event_type string, n long, s1 double, s2 double, log_e double"


def sequential(events: DataFrame, null_mean: float) -> DataFrame:
    """Sequential-test state per event type: count, sums and log e-value, with the arithmetic of the batch operator.

    Within a micro-batch rows are taken in event time; the state is four numbers a key.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s1, s2, log_e = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        parts = [f[["ts", "event_id", "value"]] for f in frames]  # three columns of a key's rows in one micro-batch
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        for v in rows["value"].to_numpy(float):
            d = v - null_mean
            stake = max(-0.5, min(0.5, s1 / s2)) if s2 > 0 else 0.0
            log_e += math.log(max(1e-10, 1 + stake * d))
            n, s1, s2 = n + 1, s1 + d, s2 + d * d
        state.update((n, s1, s2, min(500.0, log_e)))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "s1": [s1], "s2": [s2], "log_e": [min(500.0, log_e)]})

    return events.groupBy("event_type").applyInPandasWithState(step, RESULT, STATE, "update", "NoTimeout")


def srm_verdict(counts: DataFrame, shares: dict) -> DataFrame:
    """One row for running counts (variant, n): chi-square against expected shares; beyond the 5 and 1 percent points of
    one degree of freedom WARNING and BLOCK (Wilson-Hilferty points for more variants)."""
    want = F.coalesce(*[F.when(F.col("variant") == F.lit(k), F.lit(v / sum(shares.values()))) for k, v in shares.items()])
    total = counts.agg(F.sum("n").alias("total"))
    cells = counts.crossJoin(F.broadcast(total)).withColumn("e", want * F.col("total"))  # one row
    d = len(shares) - 1
    point = lambda z: {1: z * z}.get(d, d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3)
    low, high = (point(1.959964), point(2.575829)) if d == 1 else (point(1.644854), point(2.326348))
    out = cells.agg(F.max("total").alias("n"), F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"))
    return out.withColumn("status", F.when(F.col("chi2") <= low, "PASS").when(F.col("chi2") <= high, "WARNING").otherwise("BLOCK"))


def freshness_status(latest: DataFrame, clock: Column, cadence_hours: float = 1.0, grace: float = 2.0) -> DataFrame:
    """Hours since the last event of each type against its cadence: late after grace cadences, stale after a day more."""
    age = (F.unix_timestamp(clock) - F.unix_timestamp("last")) / 3600.0
    status = F.when(F.col("age_hours") <= grace * cadence_hours, "fresh").when(F.col("age_hours") <= grace * cadence_hours + 24, "late").otherwise("stale")
    return latest.withColumn("age_hours", age).withColumn("status", status)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drain a stream into Parquet in the shared folder and read it back (tests and replays).

    State and offsets lie beside the output. complete gives the last result, update all results in turn, append all rows.
    """
    spark = stream.sparkSession
    conf = spark.conf
    root = conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_shared"
    root = f"{root.rstrip('/')}/brindle-stream-{name}"
    epochs: list[str] = []

    def put(batch: DataFrame, epoch: int) -> None:
        path = f"{root}/out/{epoch}"
        batch.write.mode("overwrite").parquet(path)  # the same epoch may come again after a failure
        epochs[:] = [path] if mode == "complete" else [p for p in epochs if p != path] + [path]

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*epochs) if epochs else spark.createDataFrame([], stream.schema)
