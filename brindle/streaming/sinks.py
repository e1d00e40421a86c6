"""Sinks of streams in the shared folder: replays, the last row of each key, and rows split by what they break.

Every batch writes into folders of its own number and overwrites them when it comes again after a failure, so each row stands
once whatever happens.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .monitors import validated
from .stateful import rocksdb


def stream_root(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/brindle-stream-{name}"


def drain(stream: DataFrame, root: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take all that there is into a sink; state and offsets stay below root, so the next call goes on where this one ended."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def epochs_into(path: str) -> Callable[[DataFrame, int], None]:
    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return put


def latest(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """Of the rows that an update stream has written, the last of each key (of one batch, the greatest)."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "epoch")]), F.struct("epoch", *[c for c in rows.columns if c not in (*keys, "epoch")])).alias("x")).select(*keys, "x.*")


def watched(stream: DataFrame, root: str, put: Callable[[DataFrame, int], None], rows: int, every: str = "1 second", most_s: float = 600.0) -> None:
    """Run an update stream with processing-time timers until it has taken in so many rows; its timers would never let it end."""
    with rocksdb(stream.sparkSession):
        q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(processingTime=every).start()
    taken, end = {}, time.monotonic() + most_s
    while q.isActive and sum(taken.values()) < rows and time.monotonic() < end:
        q.awaitTermination(0.2)
        taken |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
    if error := q.exception():
        raise error
    q.stop()


def replay(df: DataFrame, part: Column, parts: int, root: str, build: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame, int], None], mode: str = "append", timers: bool = False) -> None:
    """Feed a table to a stream part by part: each part is written, taken in by a run of the stream, and the next run goes on."""
    spark = df.sparkSession
    for k in range(parts):
        own = df.where(part == k)
        own.write.mode("append").parquet(f"{root}/in")
        stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in"))
        if timers:
            watched(stream, root, put, own.count())
        else:
            drain(stream, root, put, mode)


def split_sinks(root: str, rules: dict[str, Column], at: str, delay: str) -> Callable[[DataFrame, int], None]:
    """A batch's rows go, in one write, to the tables passed, diverted (with the names of the rules they break) and late.

    Late is a row whose time lies more than the delay behind the latest of the batches before, whatever it breaks; a row
    without a time is never late. Each batch also notes its latest time and counts, from which later batches take their
    watermark, so a batch that comes again sees the same one.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mark = F.lit(None).cast("timestamp")
        if epoch > 0:
            noted = spark.read.schema("epoch long, kind string, n long, latest timestamp").parquet(f"{root}/noted").where(F.col("epoch") < epoch)
            mark = F.lit(noted.agg(F.max("latest").alias("t")).select(F.col("t") - F.expr(f"interval {delay}")).first()[0]).cast("timestamp")
        late = F.coalesce(F.col(at) < mark, F.lit(False))
        rows = validated(batch, rules).withColumn("kind", F.when(late, "late").when(F.size("broken") > 0, "diverted").otherwise("passed"))
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/rows/epoch={epoch}")
        written = spark.read.schema(rows.schema).parquet(f"{root}/rows/epoch={epoch}")
        notes = written.groupBy("kind").agg(F.count("*").alias("n"), F.max(at).alias("latest"))
        notes.coalesce(1).write.mode("overwrite").parquet(f"{root}/noted/epoch={epoch}")

    return put


def split_rows(spark: SparkSession, root: str, schema, kind: str | None = None) -> DataFrame:
    """What split_sinks has written, with broken, kind and epoch; one kind is one folder of each batch."""
    more = [T.StructField("broken", T.ArrayType(T.StringType())), T.StructField("epoch", T.LongType()), T.StructField("kind", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *more])).parquet(f"{root}/rows")
    return rows if kind is None else rows.where(F.col("kind") == kind)
