"""Mixing sources to target weights (operator 10).

Targets are water-filled: every source gets its weight's share of all words,
but at most three times its own size, and what it cannot take is shared again
by weight. The mix is cut into blocks of equally many words and the blocks are
awarded to sources by Sainte-Lague (highest quotients target / (2k - 1)). The
method is house-monotone, so the awards of the first g/G of all blocks, minus
those of the first (g-1)/G, are the integer quotas of shard g.

Within a source, documents stand in the order of a seeded md5 of their id. That
line is cut into blocks and the blocks into shards of equally many. In its shard
a source takes every block as often as the quota covers all of them, and of the
rest of the quota a run of blocks that starts at a seeded block and goes round.
No block is taken more than three times; what a shard cannot take goes to the
next. Offsets on the line come from two prefix sums (over 4,096 hash ranges and
inside one range), so that a source with a third of all rows is spread over
thousands of window partitions.

Defined cases: a null text has size 0; a null source is the last source; rows
with equal ids are ordered by size; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import table, through_table, words_of

SEED = "mix-1"
BLOCK_WORDS = 50
SHARDS = 16
CYCLE = 3
MAX_REPEATS = 3


def sizes(docs: DataFrame, seed: str = SEED, carry: bool = False) -> DataFrame:
    """Size, seeded key and hash range of every document, and the whole row as a struct if asked for."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), key.alias("k"), *row)
    return rows.withColumns({"skey": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "range": F.substring("k", 1, 3)})


def ranges(sized: DataFrame) -> DataFrame:
    """Words of each (source, hash range) and of the ranges before it."""
    sums = sized.groupBy("skey", "range").agg(F.sum("size").alias("words"), F.max("source").alias("source"))
    before = F.sum("words").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("base", before - F.col("words"))


def targets(summed: DataFrame) -> DataFrame:
    """One row per source: source_size, weight, target. The table has as many rows as there are sources."""
    src = summed.groupBy("skey").agg(F.sum("words").alias("source_size"), F.max("source").alias("source"))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("rank", F.row_number().over(order)).withColumns({"weight": (F.col("rank") - 1) % CYCLE + 1, "cap": MAX_REPEATS * F.col("source_size"), "total": F.sum("source_size").over(all_)})
    line = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumns({"left": F.col("total") - F.sum("cap").over(line) + F.col("cap"), "w": F.sum("weight").over(all_) - F.sum("weight").over(line) + F.col("weight")})
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("w")
    src = src.withColumn("level", F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("rank").alias("r"), F.col("left").alias("left"), F.col("w").alias("w")))).over(all_))
    capped = F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("rank").alias("r")) < F.struct(F.col("level.o").alias("o"), F.col("level.r").alias("r"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.w"))
    return src.select("skey", "source", "rank", "weight", "source_size", "total", target.alias("target"))


def quotas(target: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(skey, shard, quota, upto, block): blocks of each source in each shard, by highest quotients."""
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr("total div 65536"))).cast("long")
    rows = target.withColumn("block", block).withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    rows = rows.withColumn("house", F.expr(f"((total div block) * g) div {shards}"))
    rows = rows.withColumn("first", F.coalesce(F.floor(F.try_divide(F.col("target") * F.col("house"), F.col("total")) + 0.5), F.lit(0)).cast("long"))
    rows = rows.withColumn("miss", F.col("house") - F.sum("first").over(Window.partitionBy("g")))
    step = F.when(F.col("miss") > 0, F.sequence(F.lit(1).cast("long"), F.col("miss"))).when(
        F.col("miss") < 0, F.filter(F.sequence(F.lit(1).cast("long"), -F.col("miss")), lambda k: k <= F.col("first"))
    )
    seats = rows.where("miss <> 0").select("skey", "rank", "g", "miss", "first", "target", F.explode(step).alias("k"))
    more = F.col("miss") > 0
    nth = F.when(more, F.col("first") + F.col("k")).otherwise(F.col("first") - F.col("k") + 1)
    seats = seats.withColumn("quotient", F.col("target") / (2 * nth - 1))
    by = Window.partitionBy("g").orderBy(F.when(more, -F.col("quotient")).otherwise(F.col("quotient")), F.when(more, F.col("rank")).otherwise(-F.col("rank")))
    seats = seats.withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.abs("miss"))
    change = seats.groupBy("skey", "g").agg(F.sum(F.signum("miss")).cast("long").alias("change"))
    full = rows.join(change, ["skey", "g"], "left").withColumn("upto", F.col("first") + F.coalesce("change", F.lit(0)))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("skey").orderBy("g")), F.lit(0))
    return full.select("skey", F.col("g").alias("shard"), (F.col("upto") - before).alias("quota"), "upto", "block")


def selections(award: DataFrame, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """One row per source with the array of its shards: (lo, hi, whole, run_lo, run_hi, wrap_hi) in words of the line.

    award has skey, source_size, shard, upto and block. Every block from lo to hi is taken ``whole`` times, those of
    [run_lo, run_hi) and [lo, wrap_hi) once more.
    """
    blocks = "((source_size + block - 1) div block)"
    rows = award.withColumns({"b0": F.expr(f"({blocks} * (shard - 1)) div {shards}"), "b1": F.expr(f"({blocks} * shard) div {shards}")})
    line = Window.partitionBy("skey").orderBy("shard")
    room = F.least(F.lit(0), F.min(F.col("upto") - MAX_REPEATS * F.col("b1")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("done", MAX_REPEATS * F.col("b1") + room)
    rows = rows.withColumns({"take": F.col("done") - F.coalesce(F.lag("done").over(line), F.lit(0)), "n": F.col("b1") - F.col("b0")})
    rows = rows.withColumns({"whole": F.expr("coalesce(try_divide(take, n), 0)").cast("long"), "rest": F.coalesce(F.try_mod("take", "n"), F.lit(0))})
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "skey", F.col("shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("first", F.col("b0") + F.coalesce(F.try_mod(start, F.col("n")), F.lit(0)))
    words = lambda c: c * F.col("block")  # noqa: E731
    last = F.col("first") + F.col("rest")
    part = F.struct(
        F.col("shard"), words(F.col("b0")).alias("lo"), words(F.col("b1")).alias("hi"), "whole",
        words(F.col("first")).alias("run_lo"), words(F.least(last, F.col("b1"))).alias("run_hi"),
        words(F.col("b0") + F.greatest(last - F.col("b1"), F.lit(0))).alias("wrap_hi"),
    )  # fmt: skip
    return rows.groupBy("skey").agg(F.sort_array(F.collect_list(part)).alias("shards"))  # as many as there are shards


def spans(start: Column, end: Column) -> Column:
    """For each repeat, the runs (lo, hi) of the document's own words that are taken; documents lie at [start, end) of the line."""

    def level(c: Column) -> Column:
        parts = F.transform("shards", lambda s: F.array(
            F.struct((F.greatest(s["lo"], start) - start).alias("lo"), (F.least(F.when(s["whole"] >= c, s["hi"]).when(s["whole"] == c - 1, s["wrap_hi"]).otherwise(s["lo"]), end) - start).alias("hi")),
            F.struct((F.greatest(s["run_lo"], start) - start).alias("lo"), (F.least(F.when(s["whole"] == c - 1, s["run_hi"]).otherwise(s["run_lo"]), end) - start).alias("hi")),
        ))  # fmt: skip
        return F.filter(F.flatten(parts), lambda x: x["lo"] < x["hi"])

    return F.transform(F.sequence(F.lit(1), F.lit(MAX_REPEATS)), level)


def mix(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, and spans: for each repeat the runs of words taken. carry adds the whole row as a struct."""
    sized = through_table(sizes(docs, seed, carry), "sizes")
    summed = ranges(sized)
    goal = targets(summed)
    award = quotas(goal, block_words, shards).join(goal.select("skey", "source_size"), "skey")
    source = goal.select("skey", "source_size", "target").join(selections(award, seed, shards), "skey")
    base = summed.select("skey", "range", "base").join(source, "skey")
    here = Window.partitionBy("skey", "range").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("size").over(here)).drop("source").join(base, ["skey", "range"])
    placed = placed.withColumn("end", F.col("base") + F.col("end")).withColumn("spans", spans(F.col("end") - F.col("size"), F.col("end")))
    words = F.aggregate(F.flatten("spans"), F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return placed.select("doc_id", "size", "source_size", "target", words.alias("taken"), "spans", *(["row"] if carry else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    over = lambda lo, hi: f"greatest(least({hi}, ends) - greatest({lo}, ends - size), 0)"  # noqa: E731
    return rf"""
    WITH sz AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS size, md5('{SEED}:' || doc_id) AS k FROM documents),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sz GROUP BY source),
    s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, {MAX_REPEATS} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s0),
    s2 AS (SELECT *, (rank - 1) % {CYCLE} + 1 AS weight FROM s1),
    s3 AS (SELECT *, (total - sum(cap) OVER o + cap)::BIGINT AS lft, (sum(weight) OVER () - sum(weight) OVER o + weight)::BIGINT AS w, row_number() OVER o AS pos
           FROM s2 WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
    lv AS (SELECT arg_min(lft, pos) AS lft, arg_min(w, pos) AS w, min(pos) AS pos FROM s3 WHERE lft * weight <= cap * w),
    tg AS (SELECT source, source_size, rank, total, CASE WHEN s3.pos < lv.pos THEN cap::DOUBLE ELSE (lv.lft * weight) / lv.w END AS target FROM s3, lv),
    h AS (SELECT *, greatest(1, least({BLOCK_WORDS}, total // 65536)) AS block, unnest(range(1, {SHARDS} + 1)) AS g FROM tg),
    h1 AS (SELECT *, ((total // block) * g) // {SHARDS} AS house FROM h),
    h2 AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE floor(target * house / total + 0.5)::BIGINT END AS fst FROM h1),
    h3 AS (SELECT *, (house - sum(fst) OVER (PARTITION BY g))::BIGINT AS miss FROM h2),
    c AS (SELECT rank, g, miss, target, fst, unnest(range(1, abs(miss) + 1)) AS j FROM h3 WHERE miss <> 0),
    c1 AS (SELECT *, CASE WHEN miss > 0 THEN fst + j ELSE fst - j + 1 END AS nth FROM c WHERE miss > 0 OR j <= fst),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN miss > 0 THEN -(target / (2 * nth - 1)) ELSE target / (2 * nth - 1) END, CASE WHEN miss > 0 THEN rank ELSE -rank END) AS r FROM c1),
    c3 AS (SELECT rank, g, sum(sign(miss))::BIGINT AS chg FROM c2 WHERE r <= abs(miss) GROUP BY rank, g),
    q AS (SELECT h3.*, fst + coalesce(chg, 0) AS upto, (source_size + block - 1) // block AS blocks FROM h3 LEFT JOIN c3 USING (rank, g)),
    b AS (SELECT *, (blocks * (g - 1)) // {SHARDS} AS b0, (blocks * g) // {SHARDS} AS b1 FROM q),
    b2 AS (SELECT *, {MAX_REPEATS} * b1 + least(0, min(upto - {MAX_REPEATS} * b1) OVER (PARTITION BY rank ORDER BY g ROWS UNBOUNDED PRECEDING)) AS done FROM b),
    b3 AS (SELECT *, done - coalesce(lag(done) OVER (PARTITION BY rank ORDER BY g), 0) AS take, b1 - b0 AS n FROM b2),
    b4 AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE take // n END AS whole, CASE WHEN n = 0 THEN 0 ELSE take % n END AS rest,
            b0 + CASE WHEN n = 0 THEN 0 ELSE ('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '') || ':' || g), 1, 8))::BIGINT % n END AS f FROM b3),
    sh AS (SELECT source, source_size, target, whole, b0 * block AS lo, b1 * block AS hi, f * block AS run_lo, least(f + rest, b1) * block AS run_hi,
            (b0 + greatest(f + rest - b1, 0)) * block AS wrap_hi FROM b4),
    pl AS (SELECT row_number() OVER () AS rid, *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends FROM sz)
    SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target,
        sum(whole * {over("lo", "hi")} + {over("run_lo", "run_hi")} + {over("lo", "wrap_hi")})::BIGINT AS taken
    FROM pl JOIN sh ON pl.source IS NOT DISTINCT FROM sh.source GROUP BY rid, doc_id, size
    """
