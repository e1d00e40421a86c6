"""Profiles of sets, segments and joins."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_summary(df: DataFrame, number: str, day: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(number).isNull()).alias("n_null"), F.round(F.sum(number), 2).alias("total"), F.min(day).cast("date").alias("first_day"), F.max(day).cast("date").alias("last_day"))


def segment_profile(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Count, share, mean and index against the overall mean; flags of gaps over a fifth and of fewer than 100 rows."""
    g = df.groupBy(segment).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.sum(metric).alias("_s"), F.count(metric).alias("_c"))
    all_ = Window.partitionBy()
    g = g.withColumns({"share": F.col("n") / F.sum("n").over(all_), "index": F.col("mean") / (F.sum("_s").over(all_) / F.sum("_c").over(all_))})
    return g.select(segment, "n", "share", "mean", "index", (F.abs(F.col("index") - 1) > 0.2).alias("gap"), (F.col("n") < 100).alias("small"))


def weighted_mean_gap(df: DataFrame, metric: str, weight: str, segment: str) -> DataFrame:
    """Weighted mean and mean of segment means, flagged when they differ by over 1 percent of the larger."""
    ok = df.where((F.col(weight) > 0) & F.col(metric).isNotNull())
    w = ok.agg((F.sum(F.col(metric) * F.col(weight)) / F.sum(weight)).alias("weighted"))
    u = ok.groupBy(segment).agg(F.avg(metric).alias("m")).agg(F.avg("m").alias("unweighted"))
    both = w.join(u)  # one row each
    return both.withColumn("differs", F.abs(F.col("weighted") - F.col("unweighted")) > 0.01 * F.greatest(F.abs("weighted"), F.abs("unweighted")))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with counts."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = rows.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def grouping_sets(df: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """The metric by every single dimension in one pass: (dimension, value, n, total)."""
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.explode(cells).alias("x"), metric).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.sum(metric).alias("total"))


def cardinality(before: DataFrame, after: DataFrame, cross: bool = False, expected: str | None = None) -> DataFrame:
    """Rows before and after a join; a ratio above 2 fails unless the join is a cross join."""
    a = before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))  # one row each
    ratio = F.try_divide("n_after", "n_before")
    as_expected = {None: F.lit(True), "same": F.col("n_after") == F.col("n_before"), "more": F.col("n_after") > F.col("n_before"), "fewer": F.col("n_after") < F.col("n_before")}[expected]
    return a.withColumn("ratio", ratio).withColumn("status", F.when((F.col("ratio") > 2.0) & F.lit(not cross) | ~as_expected, "FAIL").otherwise("PASS"))


def detail_against_summary(detail: DataFrame, summary: DataFrame, group: str, metric: str, tolerance: float = 0.01) -> DataFrame:
    """Full outer comparison of re-aggregated detail with a summary of the same groups."""
    d = detail.groupBy(F.col(group).alias("g")).agg(F.sum(metric).alias("detail"))
    s = summary.select(F.col(group).alias("h"), F.col(metric).alias("summary"))
    both = d.join(s, d["g"].eqNullSafe(s["h"]), "full_outer")
    gap = F.try_divide(F.abs(F.col("detail") - F.col("summary")), F.abs("summary"))
    return both.select(F.coalesce("g", "h").alias(group), "detail", "summary", F.when(F.col("detail").isNull() | F.col("summary").isNull(), "missing").when(gap > tolerance, "differs").otherwise("equal").alias("status"))


def value_sets(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Values that are unexpected or missing."""
    have = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    want = df.sparkSession.createDataFrame([(x,) for x in expected], f"w {df.schema[column].dataType.simpleString()}")
    both = have.join(want, have["v"] == want["w"], "full_outer").where("v IS NULL OR w IS NULL")
    return both.select(F.coalesce("v", "w").alias("value"), F.when(F.col("w").isNull(), "unexpected").otherwise("missing").alias("status"))


def foreign_keys(tables: dict[str, DataFrame], least: float = 0.3) -> DataFrame:
    """Candidate keys of a whole source by name rules, weighed with the exact overlap of their distinct values.

    One inverted index serves all pairs: each value of each column that some rule names goes, with the columns that hold it,
    into one group; equal sets of columns are counted, and overlaps and distinct counts are sums over those few sets. So
    every named column is read once and shuffled once as distinct values, whatever the number of pairs. Columns of
    different type families never pair; of two directions of a pair the first stands. Without candidates: no rows.
    """
    kinds = {(t, f.name): "n" if isinstance(f.dataType, T.IntegralType) else f.dataType.simpleString() for t, df in tables.items() for f in df.schema}
    pairs: dict[tuple, float] = {}
    for one, other in itertools.permutations(tables, 2):
        for x, y in itertools.product(tables[one].columns, tables[other].columns):
            name = name_score(x, y, other) if kinds[one, x] == kinds[other, y] else 0.0
            if name and (other, y, one, x) not in pairs:
                pairs[one, x, other, y] = name
    spark = next(iter(tables.values())).sparkSession
    schema = "from_table string, from_column string, to_table string, to_column string, confidence double, method string, one_to_one boolean"
    if not pairs:
        return spark.createDataFrame([], schema)
    sides = sorted({p[:2] for p in pairs} | {p[2:] for p in pairs})
    number = {side: i for i, side in enumerate(sides)}
    cells = []
    for t, group in itertools.groupby(sides, lambda side: side[0]):
        columns = [F.struct(F.lit(kinds[t, c]).alias("kind"), F.col(f"`{c}`").cast("string").alias("v"), F.lit(number[t, c]).alias("c")) for _, c in group]
        cells.append(tables[t].select(F.explode(F.array(*columns)).alias("x")).select("x.*").where("v IS NOT NULL"))
    index = reduce(lambda a, b: a.unionAll(b), cells).groupBy("kind", "v").agg(F.sort_array(F.collect_set("c")).alias("held"))  # at most all columns
    sets = index.groupBy("held").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(*p, number[p[:2]], number[p[2:]], name) for p, name in pairs.items()], "from_table string, from_column string, to_table string, to_column string, a int, b int, name double")
    held = lambda c: F.coalesce(F.array_contains("held", F.col(c)), F.lit(False))
    both = F.broadcast(rules).join(sets, held("a") | held("b"), "left")  # a row a rule, against the few sets
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = both.groupBy(*rules.columns).agg(count(held("a")).alias("n_from"), count(held("b")).alias("n_to"), count(held("a") & held("b")).alias("n_shared"))
    overlap = F.coalesce(F.try_divide("n_shared", "n_from"), F.lit(0.0))
    out = sums.withColumns({"confidence": F.when(overlap > 0, F.least(F.lit(1.0), (F.col("name") + overlap) / 2 + 0.1)).otherwise(F.col("name")), "method": F.when(overlap > 0, "both").otherwise("name_match")})
    one_to_one = (F.col("n_from") > 0) & (F.col("n_to") > 0) & (F.col("n_from") > 0.9 * F.col("n_to"))
    return out.select("from_table", "from_column", "to_table", "to_column", "confidence", "method", one_to_one.alias("one_to_one")).where(F.col("confidence") >= least)


def name_score(column: str, key: str, table: str) -> float:
    """How well a column's name points at a table's key.

    ``x_id`` points at the key (``id``, or a column of that very name) of the table x or xs (0.8) or of one whose name
    holds x (0.5), and a column with the name of a table at its id (0.4). Columns with a letter before an underscore and
    the same rest (``o_custkey``, ``c_custkey``) are compared by that rest, whose stem must begin the table's name (0.8).
    """
    column, key, table = column.lower(), key.lower(), table.lower()
    if column.endswith("_id") and key in ("id", column):
        prefix = column.removesuffix("_id")
        if table in (prefix, f"{prefix}s"):
            return 0.8
        if prefix in table:
            return 0.5
    x, y = (n.split("_", 1) for n in (column, key))
    if len(x) == len(y) == 2 and len(x[0]) <= 2 and x[1] == y[1] and x[1].endswith(("id", "key")):
        stem = x[1].removesuffix("key").removesuffix("id").removesuffix("_")
        if len(stem) >= 3 and table.startswith(stem[:4]) and table.startswith(y[0]):
            return 0.8
    if column in (table, table.rstrip("s")) or f"{column}s" == table:
        return 0.4 if key in ("id", f"{column}_id", f"{table}_id") else 0.0
    return 0.0


def count_distinct(df: DataFrame, column: str, rsd: float = 0.02) -> DataFrame:
    """One row (exact, approximate): distinct values, nulls left out.

    Values are grouped first and both counts come from the groups: a sketch of distinct values is that of all rows, and side
    by side with a distinct aggregate it would travel with every value.
    """
    values = df.groupBy(column).agg(F.lit(1).alias("_one"))
    return values.agg(F.count(column).alias("exact"), F.approx_count_distinct(column, rsd).alias("approximate"))


def plain_words(text: str) -> Column:
    """Lower-case letters and digits, everything between them one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


SMALL_LIST = 4_000_000  # letters of an alias list that is broadcast


def alias_tags(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, entity, alias, at): word-bounded, case-insensitive, longest alias first, no overlaps.

    Texts and aliases are reduced to words alike, so punctuation does not matter. Runs of as many words as some alias has
    are joined with the aliases by equality; the lengths come from the aliases, however long. A word takes along the words
    that follow it up to the longest alias, never its text, so what is shuffled is linear in the text; a list of aliases of
    at most ``SMALL_LIST`` letters is broadcast, and then only hits are shuffled.
    """
    known = aliases.select(plain_words("alias").alias("gram"), "entity").where("gram <> ''").distinct()
    about = known.agg(F.sort_array(F.collect_set(F.size(F.split("gram", " ")))).alias("lengths"), F.sum(F.length("gram") + F.length("entity")).alias("letters")).first()  # one entry a length
    lengths = about["lengths"] or [1]
    most = lengths[-1]
    listed = F.broadcast if (about["letters"] or 0) <= SMALL_LIST else lambda df: df
    runs = F.arrays_zip(*[F.slice("ws", k + 1, F.size("ws")).alias(f"w{k}") for k in range(most)])  # a slice inside a lambda would copy the text for each word
    rows = texts.select("doc_id", F.split(plain_words("text"), " ").alias("ws")).select("doc_id", F.posexplode(runs).alias("at", "x"))
    rows = rows.select("doc_id", "at", *[F.col("x")[f"w{k}"].alias(f"w{k}") for k in range(most)])
    first = known.select(F.split("gram", " ")[0].alias("w0")).distinct()
    rows = rows.join(listed(first), "w0", "left_semi")  # only words that begin an alias go on
    grams = [F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("gram"))) for n in lengths]
    grams = F.filter(F.array(*grams), lambda g: g.isNotNull())
    grams = rows.select("doc_id", "at", F.explode(grams).alias("g")).select("doc_id", "at", "g.n", "g.gram")
    hits = grams.join(listed(known), "gram")
    span = Window.partitionBy("doc_id").orderBy("at").rangeBetween(-(most - 1), most - 1)
    near = F.collect_list(F.struct("at", "n")).over(span)
    beaten = F.exists(near, lambda o: (o["n"] > F.col("n")) & (o["at"] < F.col("at") + F.col("n")) & (o["at"] + o["n"] > F.col("at")) | (o["n"] == F.col("n")) & (o["at"] < F.col("at")) & (o["at"] + o["n"] > F.col("at")))
    return hits.withColumn("beaten", beaten).where("NOT beaten").select("doc_id", "entity", F.col("gram").alias("alias"), "at")
