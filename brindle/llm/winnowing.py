"""Benchmark decontamination by winnowing (operator 13).

Words are maximal runs of ASCII letters and digits, lower-cased, and of characters beyond ASCII. A window of t words (ten; for
a shorter item, all its words) holds ``t - k + 1`` grams of ``k = max(1, t // 2)`` words, and its fingerprint is the
least hash of them, the leftmost of equals. A window has the same fingerprint wherever it stands, so every shared span of
t words is found, though neighbouring windows mostly share a fingerprint and a text of n words has about n / 3.5 rows
(lengths t that no item has are not looked for). Fingerprints of the documents that are in no item go at once: a bitmap
of ``BITS`` bits, whatever the size of the benchmark, travels with the tasks. The rest meets the fingerprints of the
items in a join, each hit is extended to the windows that it stands for, and these are compared with those of the items
word by word. A passage that a third of all documents shares gives rows in proportion to them, and by the measured size of
the benchmark's side Spark broadcasts it or splits such keys; items never meet each other.

Defined cases: a null or empty text has no words; an item without words has no window; repeated rows are documents of
their own and a repeated item_id is one item with several texts; a null item_id sorts as the empty string; an empty table
of documents gives an empty result, an empty benchmark no hit; other columns are ignored. What a document gathers is
bounded by its own words and the items that it shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import U, hashed_words, mixed, window_hashes
from .text import table, through_table

WINDOW = 10
BITS = 24  # the bitmap holds 2^24 bits, 2 MB
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def gram(t: int) -> int:
    return max(1, t // 2)


def folded(text: str | None) -> bytes:
    """Lower-cased words, apart by spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def groups(h: np.ndarray, count: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """(text, fingerprint, first window, windows) of every group of neighbouring windows of t words with one fingerprint."""
    size, k = len(h) - t + 1, gram(t)
    if size <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    g = window_hashes(h, k)
    least, place = g[:size].copy(), np.arange(size)
    for j in range(1, t - k + 1):
        less = g[j : j + size] < least
        least[less] = g[j : j + size][less]
        place[less] = np.flatnonzero(less) + j
    doc = np.repeat(np.arange(len(count)), count)
    whole = doc[:size] == doc[t - 1 :]
    new = np.ones(size, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:size] != doc[: size - 1]) | (whole[1:] != whole[:-1])
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, size))
    lo, n = lo[whole[lo]], n[whole[lo]]
    first = np.cumsum(count) - count
    return doc[lo], mixed(least[lo] ^ U(t)).view(np.int64), lo - first[doc[lo]], n


def fingerprint_batches(window: int, lengths: tuple[int, ...] | None, seen: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, id, n_words) of every text, and (row, t, fp, lo, span): its fingerprints with the words of their windows.

    Without lengths the texts are items: windows of as many words as they have, at most ``window``. With a bitmap only
    fingerprints in it are given.
    """
    names = ["row", "id", "n_words", "t", "fp", "lo", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [folded(x) for x in batch.column("text").to_pylist()]
            rows, ids = batch.column("row").to_numpy(), batch.column("id")
            words_in, at, t_of, fp_of, lo_of, spans = np.zeros(len(plain), np.int64), [], [], [], [], []
            for start, size, h, count in hashed_words([p.decode("utf-8", "surrogatepass") for p in plain]):
                words_in[start : start + size] = count
                for t in lengths or sorted({min(window, int(c)) for c in count} - {0}):
                    doc, fp, lo, n = groups(h, count, t)
                    if lengths is None:
                        own = np.minimum(count[doc], window) == t
                        doc, fp, lo, n = doc[own], fp[own], lo[own], n[own]
                    if seen is not None:
                        cell = fp & ((1 << BITS) - 1)
                        hit = (seen[cell >> 6] >> (cell & 63).view(np.uint64)) & U(1) > 0
                        doc, fp, lo, n = doc[hit], fp[hit], lo[hit], n[hit]
                    last, words = -1, []
                    for d, a, m in zip(doc.tolist(), lo.tolist(), n.tolist(), strict=True):
                        if d != last:
                            last, words = d, plain[start + d].split()
                        spans.append(b" ".join(words[a : a + m + t - 1]).decode("utf-8", "surrogatepass"))
                    at.append(start + doc)
                    t_of.append(np.full(len(doc), t, np.int32))
                    fp_of.append(fp)
                    lo_of.append(lo)
            none = lambda kind: pa.nulls(len(plain), kind)
            yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(words_in), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.string())], names)
            if spans:
                at, t_of, fp_of, lo_of = map(np.concatenate, (at, t_of, fp_of, lo_of))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), ids.take(pa.array(at)), pa.nulls(len(at), pa.int64()), pa.array(t_of), pa.array(fp_of), pa.array(lo_of.astype(np.int32)), pa.array(spans, pa.string())], names)

    return run


def fingerprints(df: DataFrame, key: str, window: int, lengths: tuple[int, ...] | None = None, seen: np.ndarray | None = None) -> DataFrame:
    """The written rows of all texts; each input row has a number of its own."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col("text").cast("string").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return through_table(rows.mapInArrow(fingerprint_batches(window, lengths, seen), f"row long, id {kind}, n_words long, t int, fp long, lo int, span string"), "winnowed")


def bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the items' fingerprints in words of 64, at most 2^BITS / 64 of them collected."""
    cells = items.select(F.col("fp").bitwiseAND((1 << BITS) - 1).alias("cell"))
    words = cells.groupBy(F.expr("CAST(shiftright(cell, 6) AS INT)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("b")).toPandas()
    seen = np.zeros(1 << (BITS - 6), np.uint64)
    seen[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return seen


def windows(hits: DataFrame, *keep: str) -> DataFrame:
    """(start, words) of every window that fingerprints stand for."""
    words = F.split("span", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - F.col("t")), lambda i: F.struct((F.col("lo") + i).alias("start"), F.array_join(F.slice(words, i + 1, F.col("t")), " ").alias("words")))
    return hits.select(*keep, "t", F.explode(cut).alias("w")).select(*keep, "t", "w.start", "w.words")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, hits, items) of every document: hit word ranges (start, end), apart and in order, and the items shown."""
    train = fingerprints(items, item, window).where("t IS NOT NULL")
    lengths = tuple(sorted(r["t"] for r in train.select("t").distinct().collect()))  # at most a window's words
    found = fingerprints(docs, key, window, lengths, bitmap(train))
    hits = found.where("t IS NOT NULL").join(train.select("t", "fp").distinct(), ["t", "fp"], "left_semi")
    known = windows(train, "id").groupBy("words").agg(F.collect_set(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("items"))
    same = windows(hits, "row").join(known, "words").select("row", "start", (F.col("start") + F.col("t")).alias("end"), "items")
    by = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("apart", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(by))
    both = lambda c: F.array_distinct(F.flatten(c))
    ranges = same.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), both(F.collect_set("items")).alias("items"))
    shown = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"), F.array_sort(both(F.collect_list("items"))).alias("items"))
    heads = found.where("t IS NULL").select("row", F.col("id").alias("_id"), "n_words")
    out = heads.join(shown, "row", "left")
    return out.select(F.col("_id").alias(key), "n_words", F.coalesce("hits", F.expr("CAST(array() AS array<struct<start: int, end: int>>)")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle() -> str:
    """The same rows by the words of all windows."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    cut = "unnest(list_transform(range(1, len(w) - t + 2), lambda i: {'start': i, 'words': array_to_string(w[i : i + t - 1], ' ')}))"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
        b AS (SELECT item_id, least({WINDOW}, len(w)) AS t, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
        bw AS MATERIALIZED (SELECT DISTINCT item_id, t, c.words FROM (SELECT item_id, t, {cut} AS c FROM b)),
        dw AS (SELECT rid, t, c.start, c.words FROM (SELECT rid, t, {cut} AS c FROM d, (SELECT DISTINCT t FROM bw) WHERE len(w) >= t)),
        m AS MATERIALIZED (SELECT rid, start, dw.t, item_id FROM dw JOIN bw USING (words)),
        h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, start + j AS place FROM m, range({WINDOW}) AS g(j) WHERE j < t) GROUP BY 1),
        i AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS x FROM m) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)"""
