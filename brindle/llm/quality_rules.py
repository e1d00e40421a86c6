"""Quality rules with adaptive thresholds (operator 9, native).

Per document a handful of integer metrics is computed with built-in functions,
once, and written as a narrow table. Each (lang, source) keeps a mergeable
quantile sketch per metric: counts of values rounded down to five significant
bits, so two sketches merge by adding counts, the relative error of a quantile is
at most 1/32 and the result does not depend on partitioning.

Every fence is a quantile of the group's own sketch, at rank ceil(p (n + 1)) so
that few documents do not pretend to know a tail, shrunk to the fence of its
language, and this to the fence of all documents, as if ``PRIOR`` documents more
had been seen. Word length has fences ``REACH`` times as far from the median as
its tenth and ninetieth percentile. The other metrics are fenced at the
``TAIL`` quantile of the documents inside the fences of word length, since junk
would otherwise set its own limits. There are no fixed cutoffs and no group size
at which the rule changes. Only documents that pass the base rule are sketched.

Defined cases: a null text has no words and fails the base rule; null lang or
source is a group of its own; repeated rows give repeated result rows; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import WS_CHARS, table, through_table, words_of

TAILS = ["symbols", "dup_lines", "repeats"]
REACH = 3
TAIL = 99  # percent
PRIOR = 200
SYMBOLS = "#*$%&|<>"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document; one output row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    step = docs.select("doc_id", "lang", "source", text.alias("_t"), words_of(F.col("text")).alias("_w"), lines.alias("_l"))
    step = step.select(
        "doc_id", "lang", "source", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.slice("_w", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
            lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
        ),
    )
    step = step.withColumn("_s", F.sort_array(windows)).drop("_w")
    again = F.transform(
        "_s",
        lambda x, i: F.when((F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]), x["i"]),
    )
    step = step.withColumn("_p", F.sort_array(F.filter(again, lambda x: x.isNotNull()))).drop("_s")
    reach = F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def metric_columns() -> dict[str, Column]:
    """Integer metrics: hundredths of a character, and parts of ten thousand."""
    return {
        "word_length": F.expr("(100 * word_chars) div greatest(n_words, 1)"),
        "symbols": F.expr("(10000 * n_symbols) div greatest(n_words, 1)"),
        "dup_lines": F.expr("(10000 * n_dup_lines) div greatest(n_lines, 1)"),
        "repeats": F.expr("(10000 * n_repeat_words) div greatest(n_words, 1)"),
    }


def rounded_down(v: str) -> Column:
    """A value with all but its five leading bits cleared: the key of its sketch bin."""
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 5, 0)), greatest(length(bin({v})) - 5, 0))")


def sketch(feats: DataFrame, metrics: list[str]) -> DataFrame:
    """(lang, source, metric, bin, n): counts per bin, summed map-side first."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    rows = feats.select("lang", "source", F.explode(cells).alias("c")).select("lang", "source", "c.metric", "c.v")
    return rows.groupBy("lang", "source", "metric", rounded_down("v").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(bins: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """Bins of the given percentiles (p10 and so on) of the sketches merged to the given keys, and their total."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    run = merged.select(
        *keys, "metric", "bin",
        F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by).alias("total"),
    )
    at = lambda p: F.coalesce(F.min(F.when(F.col("upto") * 100 >= (F.col("total") + 1) * p, F.col("bin"))), F.max("bin"))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[at(p).alias(f"p{p}") for p in percents])


def shrunk_quantiles(bins: DataFrame, percents: list[int], prior: int) -> DataFrame:
    """One row per (lang, source, metric): percentiles shrunk to those of the language and of all documents."""
    renamed = lambda df, x, keys: df.select(*[F.col(c).alias(f"{x}_{c}") for c in [*keys, "metric", "total", *[f"p{p}" for p in percents]]])
    own = quantiles(bins, ["lang", "source"], percents)
    lang = renamed(quantiles(bins, ["lang"], percents), "l", ["lang"])
    every = renamed(quantiles(bins, [], percents), "a", [])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("a_metric"))
    parent = lambda p: f"((l_total * l_p{p} + {prior} * a_p{p}) div (l_total + {prior}))"
    shrunk = [F.expr(f"(total * p{p} + {prior} * {parent(p)}) div (total + {prior})").alias(f"p{p}") for p in percents]
    return joined.select("lang", "source", "metric", *shrunk)


def with_fences(feats: DataFrame, fences: DataFrame) -> DataFrame:
    f = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    return feats.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")


def length_fences(sound: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_word_length, hi_word_length) from the documents that pass the base rule."""
    q = shrunk_quantiles(sketch(sound, ["word_length"]), [10, 50, 90], prior)
    return q.select("lang", "source", F.expr(f"p50 - {REACH} * (p50 - p10)").alias("lo_word_length"), F.expr(f"p50 + {REACH} * (p90 - p50)").alias("hi_word_length"))


def tail_fences(inside: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, hi_<metric>...) from the documents inside the fences of word length."""
    q = shrunk_quantiles(sketch(inside, TAILS), [TAIL], prior)
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(f"p{TAIL}"))).alias(f"hi_{m}") for m in TAILS])


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The counts of every document with base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    feats = through_table(features(docs).withColumns(metric_columns()).withColumn("base_failed", base), "rules")
    judged = with_fences(feats, length_fences(feats.where("NOT base_failed"), prior))
    judged = judged.withColumn("inside", F.expr("coalesce(word_length BETWEEN lo_word_length AND hi_word_length, false)"))
    judged = with_fences(judged, tail_fences(judged.where("NOT base_failed AND inside"), prior))
    kept = F.expr("NOT base_failed AND inside")
    for m in TAILS:
        kept = kept & F.coalesce(rounded_down(m) <= F.col(f"hi_{m}"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"


def _bin(v: str) -> str:
    return f"(({v} >> greatest(length(bin({v})) - 5, 0)) << greatest(length(bin({v})) - 5, 0))"


def _shrunk_sql(cells: str, percents: list[int]) -> str:
    """Percentiles of (lang, source, metric, bin, n), shrunk to language and all documents."""
    at = ", ".join(f"coalesce(min(CASE WHEN upto * 100 >= (total + 1) * {p} THEN bin END), max(bin)) AS p{p}" for p in percents)

    def level(keys: str) -> str:
        by = f"{keys}, metric" if keys else "metric"
        return (
            f"(SELECT {by}, max(total) AS total, {at} FROM (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total "
            f"FROM (SELECT {by}, bin, sum(n) AS n FROM {cells} GROUP BY {by}, bin)) GROUP BY {by})"
        )

    shrunk = ", ".join(
        f"((o.total * o.p{p} + {PRIOR} * ((g.total * g.p{p} + {PRIOR} * a.p{p}) // (g.total + {PRIOR}))) // (o.total + {PRIOR}))::BIGINT AS p{p}" for p in percents
    )
    return (
        f"SELECT o.lang, o.source, o.metric, {shrunk} FROM {level('lang, source')} o "
        f"JOIN {level('lang')} g ON o.lang IS NOT DISTINCT FROM g.lang AND o.metric = g.metric JOIN {level('')} a ON o.metric = a.metric"
    )


def oracle() -> str:
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_bin(m)} AS bin, 1 AS n FROM i WHERE NOT base_failed AND inside" for m in TAILS)
    hi = ", ".join(f"max(CASE WHEN metric = '{m}' THEN p{TAIL} END) AS hi_{m}" for m in TAILS)
    under = " AND ".join(f"coalesce({_bin(m)} <= hi_{m}, false)" for m in TAILS)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
    p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
    r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY rid),
    l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    f AS (SELECT d.doc_id, d.lang, d.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
          FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
    m AS (SELECT *, (100 * word_chars) // greatest(n_words, 1) AS word_length, (10000 * n_symbols) // greatest(n_words, 1) AS symbols,
            (10000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines, (10000 * n_repeat_words) // greatest(n_words, 1) AS repeats,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
    lc AS (SELECT lang, source, 'word_length' AS metric, {_bin("word_length")} AS bin, 1 AS n FROM m WHERE NOT base_failed),
    lq AS ({_shrunk_sql("lc", [10, 50, 90])}),
    lf AS (SELECT lang AS fl, source AS fs, p50 - {REACH} * (p50 - p10) AS lo, p50 + {REACH} * (p90 - p50) AS hi FROM lq),
    i AS (SELECT m.*, coalesce(word_length BETWEEN lo AND hi, false) AS inside FROM m LEFT JOIN lf ON lang IS NOT DISTINCT FROM fl AND source IS NOT DISTINCT FROM fs),
    tc AS ({cells}),
    tq AS ({_shrunk_sql("tc", [TAIL])}),
    tf AS (SELECT lang AS tl, source AS ts, {hi} FROM tq GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AND {under} AS kept
    FROM i LEFT JOIN tf ON lang IS NOT DISTINCT FROM tl AND source IS NOT DISTINCT FROM ts
    """
