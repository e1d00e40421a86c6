"""Near-duplicate records on key columns by sorted neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running
from .profiling import spine


BLOCK = 10_000  # records of an order that a task compares at once


def record_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(text, n): the distinct records of the columns as one text (lower case, trimmed, nulls empty), and how often each stands."""
    text = F.array_join(F.array(*[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]), "|")
    return df.groupBy(text.alias("text")).agg(F.count("*").alias("n"))


def rotated(text: Column, k: int) -> Column:
    """The text with its first k fields moved to the end."""
    fields = F.split(text, r"\|")
    return F.array_join(F.concat(F.slice(fields, k + 1, 1_000_000), F.slice(fields, 1, k)), "|")


def near_records(df: DataFrame, columns: Sequence[str], least: float = 0.9, window: int = 5) -> DataFrame:
    """(a, b, n_a, n_b, similarity): records on the columns that are no copies but alike, each pair once, a before b.

    Records are sorted once for each order (each column first in turn, and the text from its end), and each is compared
    with the ``window - 1`` before it; similarity is one less the edit distance over the longer length. Copies are one
    record (``n`` counts them), so the most frequent ones fill no window, and an order is cut into blocks of ``BLOCK`` ranks,
    each with the last records of the block before: no block grows with the data. Two records that differ
    in one column stand near each other in the orders that begin with the others; alike records that are far apart in
    every order are not found, which a wider window mends.
    """
    found = None
    records = record_texts(df, columns)
    for k in range(len(columns) + 1):
        order = F.reverse("text") if k == len(columns) else rotated(F.col("text"), k)
        ranked = running(records.withColumn("o", order), [], ["o", "text"], {"r": ("sum", F.lit(1).cast("long"))}).select("text", "n", (F.col("r") - 1).alias("r"))
        own = F.floor(F.col("r") / BLOCK)
        next_too = F.when(F.pmod("r", F.lit(BLOCK)) >= BLOCK - window + 1, F.array(own, own + 1)).otherwise(F.array(own))  # the halo of the next block
        line = Window.partitionBy("block").orderBy("r")
        before = F.array(*[F.lag(F.struct("text", "n"), step).over(line) for step in range(1, window)])
        rows = ranked.withColumn("block", F.explode(next_too)).withColumn("before", before).where(F.col("block") == own)
        pairs = rows.select("text", "n", F.explode("before").alias("p")).where("p IS NOT NULL")
        size = F.greatest(F.length("text"), F.length("p.text"))
        distance = F.levenshtein(F.col("text"), F.col("p.text"))
        pairs = pairs.where(F.abs(F.length("text") - F.length("p.text")) <= (1 - least) * size).select("text", "n", "p", (1 - distance / size).alias("similarity")).where(F.col("similarity") >= least)
        one, other = F.struct("text", "n"), F.struct(F.col("p.text").alias("text"), F.col("p.n").alias("n"))
        pairs = pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), "similarity")
        found = pairs if found is None else found.unionAll(pairs)
    out = found.groupBy(F.col("a.text").alias("a"), F.col("b.text").alias("b")).agg(F.max("a.n").alias("n_a"), F.max("b.n").alias("n_b"), F.max("similarity").alias("similarity"))
    return out.select("a", "b", "n_a", "n_b", "similarity")


def volume_anomalies(df: DataFrame, day: str, window: int = 14, width: float = 3.0) -> DataFrame:
    """(day, n, mean, sd, z) of days whose number of rows lies more than width sample deviations off the days before.

    Days without rows between the first and the last count as zero; the window before must be full and vary.
    """
    days = df.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"))
    full = spine(days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))).join(days, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("day").rowsBetween(-window, -1)  # a row a day
    rows = full.select("day", "n", F.avg("n").over(w).alias("mean"), F.stddev_samp("n").over(w).alias("sd"), F.count("n").over(w).alias("k"))
    rows = rows.where((F.col("k") == window) & (F.col("sd") > 0)).withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd"))
    return rows.where(F.abs("z") > width).drop("k")
