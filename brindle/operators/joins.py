"""Joins by order instead of equality, as scans over one sorted range partitioning: no pair of rows is ever built.

Both sides are dealt together by range of the equality keys and the order, so a key that holds most of the rows is spread
over as many tasks as its rows need; between ranges one row a key and range is carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dealt, scanned


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, take: str) -> DataFrame:
    """left with ``take`` of the latest right row of the same keys at or before its ``at``; null if there is none.

    Of right rows at the same time the greatest ``take`` counts. Null keys equal each other; left rows without a time and
    right rows without a time or ``take`` meet nothing.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]  # no clash with columns of the caller
    own = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), *keys, F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[take].dataType).alias("hit"), F.monotonically_increasing_id().alias("tie"))
    seen = right.where(F.col(at).isNotNull() & F.col(take).isNotNull()).select(F.lit(None).cast(own.schema["row"].dataType).alias("row"), *keys, F.col(at).alias("at"), F.lit(0).alias("side"), F.col(take).alias("hit"), F.lit(0).cast("long").alias("tie"))
    by, order = [f"_k{i}" for i in range(len(by))], ["at", "side", "hit", "tie"]
    rows = scanned(dealt(own.unionByName(seen), by, order), by, order, {"found": ("last", F.col("hit"))})
    rows = rows.where("side = 1").select("row", F.when(F.col("at").isNotNull(), F.col("found")).alias(take))
    return rows.select("row.*", take)


TINY = 1e-300  # a tolerance of such a value could round to nothing


def cells(x: Column, width: float) -> Column:
    """Number of the cell of a positive value; cells are so wide in logarithms, and greater values never have smaller ones."""
    return F.floor(F.log(x) / width)


def least_within(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], value: str, take: str, relative: float) -> DataFrame:
    """(key, take): the least ``take`` of right rows of the same ``by`` whose value lies within relative x |value| of the left's.

    Values fall into cells narrower than an interval, by sign and logarithm, so every interval is the end of one cell, a few
    whole cells and the beginning of another: a running minimum from either end of a cell and one minimum a cell answer it.
    Work is linear in both sides, even if all values are within the tolerance of each other. The ends follow the test
    |seen - value| <= relative x |value| to the last bit (a difference of doubles within a factor of two is exact). Null
    and not-a-number values and null keys of ``by`` meet nothing; zero meets zero, and so do values below 1e-300 in size;
    rows without a hit are left out.
    """
    if not 0 < relative < 0.5:
        raise ValueError("relative must lie between 0 and 0.5")
    width = math.log1p(relative)
    v = F.when(F.abs(F.col(value).cast("double")) < TINY, 0.0).otherwise(F.col(value).cast("double"))
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]  # no clash with columns of the caller
    known = lambda df: df.dropna(subset=list(by)).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    sign, size = F.signum(v).cast("int").alias("sign"), F.abs(v).alias("x")
    cell = F.when(F.col("sign") == 0, 0).otherwise(cells(F.col("x"), width)).cast("long")
    seen = known(right).where(F.col(take).isNotNull()).groupBy(*named, sign, size).agg(F.min(take).alias("hit")).withColumn("cell", cell)
    asked = known(left).select(F.col(key).alias("key"), *named, sign, size).withColumn("t", relative * F.col("x"))
    asked = asked.withColumns({"low": F.col("x") - F.col("t"), "high": F.col("x") + F.col("t")})
    asked = asked.withColumns({"from": F.when(F.col("sign") == 0, 0).otherwise(cells(F.col("low"), width)).cast("long"), "to": F.when(F.col("sign") == 0, 0).otherwise(cells(F.col("high"), width)).cast("long")})
    by = [f"_k{i}" for i in range(len(by))]
    group = [*by, "sign", "cell"]
    inner = F.when(F.col("sign") == 0, F.array(F.lit(0).cast("long"))).when(F.col("to") - F.col("from") > 1, F.sequence(F.col("from") + 1, F.col("to") - 1))
    whole = asked.select("key", *by, "sign", F.explode(inner).alias("cell")).join(seen.groupBy(*group).agg(F.min("hit").alias("hit")), group).select("key", "hit")

    def end(edge: str, at: str, inside: Column, backwards: bool) -> DataFrame:
        """Least hit between an edge and the far end of its cell; an edge outside the interval itself excludes its equals."""
        after, first = (0, 1) if backwards else (1, 0)  # an edge that is inside comes after its equals
        probes = asked.where("sign <> 0").select(*by, "sign", F.col(at).alias("cell"), F.col(edge).alias("x"), F.when(inside, after).otherwise(first).alias("side"), F.lit(None).cast(seen.schema["hit"].dataType).alias("hit"), "key")
        points = seen.where("sign <> 0").select(*by, "sign", "cell", "x", F.lit(0.5).alias("side"), "hit", F.lit(None).cast(asked.schema["key"].dataType).alias("key"))
        rows = probes.withColumn("side", F.col("side").cast("double")).unionByName(points.withColumn("side", F.col("side").cast("double")))
        order = ["x", "side", "key"]
        return scanned(dealt(rows, group, order), group, order, {"best": ("min", F.col("hit"))}, backwards).where("key IS NOT NULL").select("key", F.col("best").alias("hit"))

    low = end("low", "from", F.col("x") - F.col("low") <= F.col("t"), True)
    high = end("high", "to", F.col("high") - F.col("x") <= F.col("t"), False)
    return whole.unionAll(low).unionAll(high).where("hit IS NOT NULL").groupBy("key").agg(F.min("hit").alias(take)).withColumnRenamed("key", key)
