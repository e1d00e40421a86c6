"""Exact order statistics without one task per column: values are counted, dealt by range, and summed with offsets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_written: list[str] = []  # what this process has written for intermediate steps


def stored(df: DataFrame, purpose: str = "stored") -> DataFrame:
    """Write to the folder of spark.checkpoint.dir (or the warehouse, where it is unset) and read back; release() deletes it."""
    conf = df.sparkSession.conf
    root = conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{root.rstrip('/')}/brindle-{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table of this process, and say how many; call it when no result is still to be read."""
    gone = 0
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def value_counts(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, v, n): how often each value of each column stands, nulls left out; one pass, summed map-side."""
    cells = F.array(*[F.struct(F.lit(name).alias("column"), c.cast("double").alias("v")) for name, c in columns.items()])
    rows = df.select(*by, F.explode(cells).alias("x")).select(*by, "x.column", "x.v").where("v IS NOT NULL")
    return rows.groupBy(*by, "column", "v").agg(F.count("*").alias("n"))


def cumulated(counts: DataFrame, keys: Sequence[str], value: str = "v", weight: str = "n") -> DataFrame:
    """counts with upto and total: the weight of its key up to this value, and of the whole key.

    Range partitions and windows inside them, then the sums of the partitions before (one row for a key and partition),
    so a key with most of the rows is spread. The dealt rows are written, as both steps must see the same partitions.
    """
    parts = stored(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()), "ordered")
    local = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(*keys, "_p").agg(F.sum(weight).alias("_s"))
    line = Window.partitionBy(*keys)
    before = line.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(before), F.lit(0)), "total": F.sum("_s").over(line)}).drop("_s")
    rows = parts.withColumn("upto", F.sum(weight).over(local)).alias("r")
    joined = rows.join(sums.alias("s"), (F.col("r._p") == F.col("s._p")) & reduce(lambda p, k: p & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")), keys, F.lit(True)))
    return joined.select(*[F.col(f"r.{c}") for c in counts.columns], (F.col("r.upto") + F.col("s._before")).alias("upto"), "s.total")


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df written in range partitions by (by, order), with their number _p: what scanned() runs over, as often as wanted."""
    return stored(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ordered")


#: how a running value goes on over rows, and how the values of partitions before are put together
STEPS = {"sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min)}


def scanned(parts: DataFrame, by: Sequence[str], order: Sequence[str], steps: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """Dealt rows with running columns within by along order (a total one), the row itself included: name -> (kind, column).

    Kinds are sum, max, min, last (the last value that is not null), lag (the value of the row before, also a null) and
    moments (a struct of n, mean and m2, the sum of squared deviations, merged as centred moments, so large means lose
    nothing). A partition scans its own rows, and one
    row for a key and partition carries the state of the partitions before; so a key with most of the rows is spread.
    Backwards, the scan goes from the greatest to the least.
    """
    turn = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    local = Window.partitionBy("_p", *by).orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(turn("_p")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    rows, own, past, done = {}, [], [], []
    for name, (kind, c) in steps.items():
        mine, theirs = F.col(f"r.{name}"), F.col(f"s._past_{name}")
        if kind in STEPS:
            along, across = STEPS[kind]
            rows[name] = along(c).over(local)
            own.append(along(c).alias(name))
            past.append(across(name).over(before).alias(f"_past_{name}"))
            both = {"sum": F.when(mine.isNotNull() | theirs.isNotNull(), F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))), "max": F.greatest(mine, theirs), "min": F.least(mine, theirs)}[kind]
        elif kind == "last":
            rows[name] = F.last(c, ignorenulls=True).over(local)
            own.append((F.min_by if backwards else F.max_by)(F.when(c.isNotNull(), F.struct(c.alias("x"))), F.when(c.isNotNull(), place)).alias(name))
            past.append(F.last(F.col(name)["x"], ignorenulls=True).over(before).alias(f"_past_{name}"))
            both = F.coalesce(mine, theirs)
        elif kind == "lag":
            line = Window.partitionBy("_p", *by).orderBy(*map(turn, order))
            rows[name] = F.struct(F.lag(c).over(line).alias("x"), F.lag(F.lit(True)).over(line).alias("inside"))
            own.append((F.min_by if backwards else F.max_by)(F.struct(c.alias("x")), place).alias(name))
            past.append(F.last(F.col(name)["x"]).over(before).alias(f"_past_{name}"))
            both = F.when(mine["inside"], mine["x"]).otherwise(theirs)
        else:  # moments
            state = lambda f: F.struct(f(F.count(c)).alias("n"), f(F.avg(c)).alias("mean"), (f(F.var_pop(c)) * f(F.count(c))).alias("m2"))
            rows[name] = state(lambda f: f.over(local))
            own.append(state(lambda f: f).alias(name))
            none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
            past.append(F.aggregate(F.collect_list(name).over(before), none, merged).alias(f"_past_{name}"))  # at most a row a partition
            both = merged(F.coalesce(theirs, none), mine)
        done.append(both.alias(name))
    states = parts.groupBy(*by, "_p").agg(*own).select(*by, "_p", *past)
    joined = parts.withColumns(rows).alias("r").join(states.alias("s"), reduce(lambda p, k: p & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")), by, F.col("r._p") == F.col("s._p")))
    return joined.select(*[F.col(f"r.{c}") for c in parts.columns if c not in steps], *done)


def merged(a: Column, b: Column) -> Column:
    """Two moments as one."""
    n = a["n"] + b["n"]
    gap = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + gap * b["n"] / n)
    m2 = F.when(n > 0, F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + gap * gap * F.try_divide(a["n"] * b["n"], n))
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], steps: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with the running columns of scanned()."""
    return scanned(dealt(df, by, order), by, order, steps).drop("_p")


def quantile_columns(at: dict[str, float], value: str = "v") -> list[Column]:
    """Aggregates over cumulated rows: exact percentiles, interpolated between neighbouring ranks."""
    out = []
    for name, p in at.items():
        spot = F.lit(p) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") > f(spot), F.col(value))) for f in (F.floor, F.ceil))
        place = F.lit(p) * (F.max("total") - 1)
        out.append(F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return out


def quantiles(df: DataFrame, columns: dict[str, Column], at: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row for each key and column that has values: the percentiles named in at."""
    keys = [*by, "column"]
    return cumulated(value_counts(df, columns, by), keys).groupBy(*keys).agg(*quantile_columns(at))


def one_row(df: DataFrame, columns: dict[str, Column], at: dict[str, float]) -> DataFrame:
    """A single row with <column>_<name> for every column and percentile; null where a column has no values."""
    q = quantiles(df, columns, at)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col(name))).alias(f"{c}_{name}") for c in columns for name in at])
