"""Substring dedup with a log-structured fingerprint index (operator 7).

A word is removed when it lies in a window of ``WINDOW`` words that also starts
earlier, in a smaller doc_id or earlier in the same document.

Every window holds ``WINDOW - GRAM + 1`` grams of ``GRAM`` words; the one with the
least hash (the leftmost of equals) is its anchor. Equal windows have equal
anchors, and neighbouring windows mostly share one, so a document of n words has
about n / 7 anchor rows: (anchor hash, hash of all words of the windows that
share it, document, first window, windows). The index keeps them in immutable
runs, bucketed and sorted by anchor hash. A batch of new documents (with ids
above those before) becomes a run, which is merge-joined by anchor with the runs
of history; no run is shuffled again. Rows of which another row has the same
words are settled at once. Where one anchor stands in different words, the
windows around it are hashed in full from the texts (two independent 64-bit
hashes of all 20 words verify each match). Runs are compacted into one before a
batch is added when there are more than ``MAX_RUNS``. ``save`` writes a manifest of
the runs and ``reopen`` goes on from it, given the documents indexed so far; the
catalogue holds names of runs only between ``reopen`` or the first batch and
``close``.

Copies within a batch of rows are settled before the shuffle, so a passage that
a third of all documents share is one row a batch and not one a document. Which
rows are copies depends on how the input is cut into batches, so one pass flags
them and writes all rows to the shared folder; the run and the copies are read
from there. What a run replaces is deleted: the rows it was sorted from, and on
compaction the runs it was merged from.

Defined cases: a null text has no words; a text of fewer than 20 words loses
none; rows of one doc_id, repeated or with different texts, are one document
(equal ids and starts are not earlier, a later start is) of which each row is
cut by its own words; a null doc_id counts as the greatest, so all such rows are
one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import U, hashed_words, mixed, powers, window_hashes
from .text import remove_folder, shared_dir, table, through_table

WINDOW = 20
GRAM = 8
SPAN = WINDOW - GRAM + 1
MAX_RUNS = 1
BATCHES = 3  # the third batch meets a compacted run
LAST = 2**63 - 1
WORD = re.compile(r"[^ \t-\r]+")
PLACE = ("k", "v", "lo", "n")
ROW = "anchor long, ctx long, k long, v long, lo int, n int, again boolean"


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, from running sums of word hash x power."""
    return mixed((sums[end] - sums[start]) * powers(len(sums), "down")[start])


def running(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])


def anchors(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, ctx, lo, n) of every group of neighbouring windows with one anchor."""
    size = len(h) - WINDOW + 1
    if size <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    g = window_hashes(h, GRAM)
    two = np.minimum(g[:-1], g[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[:size], eight[SPAN - 8 : SPAN - 8 + size])
    off = np.zeros(size, np.int64)
    for d in range(SPAN - 1, -1, -1):
        off[g[d : d + size] == least] = d
    place = np.arange(size) + off
    doc = np.repeat(np.arange(len(count)), count)
    whole = doc[:size] == doc[WINDOW - 1 :]
    place[~whole] = -1
    new = np.ones(size, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:size] != doc[: size - 1])
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, size))
    keep = whole[lo]
    lo, n = lo[keep], n[keep]
    ctx = span_hash(running(h), lo, lo + n + WINDOW - 1) ^ mixed(n.astype(np.uint64))
    first = np.cumsum(count) - count
    return doc[lo], g[place[lo]], ctx, lo - first[doc[lo]], n


def repeats(keys: tuple[np.ndarray, np.ndarray], k: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Rows whose key pair stands at a smaller (k, lo) in the same arrays, which are ordered by k."""
    by_place = np.lexsort((lo, k))  # rows of one id follow one another, so their starts may not be in order
    order = by_place[np.argsort((keys[0] ^ mixed(keys[1]))[by_place], kind="stable")]
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else order
    out = np.zeros(len(a), bool)
    out[order] = (k[order] != k[head]) | (lo[order] != lo[head])
    return out


def anchor_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchor rows; those that are not the first of their words in the batch are flagged."""
    for batch in batches:
        batch = batch.drop_duplicates(["k", "v"]).sort_values("k", kind="stable")  # the same row again tells nothing new
        ids, own, parts = batch["k"].to_numpy(np.int64), batch["v"].to_numpy(np.int64), []
        for at, _, h, count in hashed_words(list(batch["text"])):
            doc, anchor, ctx, lo, n = anchors(h, count)
            parts.append((ids[at + doc], own[at + doc], anchor, ctx, lo, n))
        if parts:
            k, v, anchor, ctx, lo, n = map(np.concatenate, zip(*parts, strict=True))
            yield pd.DataFrame({"anchor": anchor.view(np.int64), "ctx": ctx.view(np.int64), "k": k, "v": v, "lo": lo.astype(np.int32), "n": n.astype(np.int32), "again": repeats((anchor, ctx), k, lo)})


def window_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Full hashes of the windows of the given groups; local repeats are flagged."""
    for batch in batches:
        batch = batch.sort_values("k", kind="stable")
        ids, own, groups, parts = batch["k"].to_numpy(np.int64), batch["v"].to_numpy(np.int64), batch["groups"].to_list(), []
        for at, size, h, count in hashed_words(list(batch["text"])):
            one, two = running(h), running(mixed(h ^ U(0xA5A5A5A5A5A5A5A5)))
            first = np.cumsum(count) - count
            for d in range(size):
                got = sorted({(x["lo"], x["n"]) for x in groups[at + d]})
                start = np.concatenate([np.arange(a, a + m) for a, m in got]) + first[d]
                parts.append((np.full(len(start), ids[at + d]), np.full(len(start), own[at + d]), span_hash(one, start, start + WINDOW), span_hash(two, start, start + WINDOW), start - first[d]))
        if parts:
            k, v, a, b, lo = map(np.concatenate, zip(*parts, strict=True))
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "k": k, "v": v, "lo": lo.astype(np.int32), "again": repeats((a, b), k, lo)})


def removal_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, removed, kept_text = [], [], []
        for text, groups in zip(batch["text"], batch["groups"], strict=True):
            own = WORD.findall(text) if text else []
            gone = np.zeros(len(own) + 1, np.int64)
            if groups is not None:
                lo = np.array([x["lo"] for x in groups], np.int64)
                np.add.at(gone, lo, 1)
                np.add.at(gone, lo + np.array([x["n"] for x in groups], np.int64) + WINDOW - 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            words.append(len(own))
            removed.append(int(gone.sum()))
            kept_text.append(" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g) if gone.any() else " ".join(own))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": np.array(words, np.int64), "n_removed": np.array(removed, np.int64), "kept_text": kept_text})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k (the id, the greatest for a null one), v, text: rows of one k and different texts differ in v.

    v is 0 for all rows when no id stands with two texts, and costs the index nothing then; else it is a hash of the text.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("v"), "text")
    several = not rows.select("k", "v").groupBy("k").agg((F.min("v") != F.max("v")).alias("several")).where("several").isEmpty()
    return rows if several else rows.withColumn("v", F.lit(0).cast("long"))


@dataclass
class FingerprintIndex:
    """Immutable sorted runs of anchor rows. Batches must come in the order of their ids."""

    spark: SparkSession
    buckets: int = 0
    runs: list[str] = field(default_factory=list)
    documents: list[DataFrame] = field(default_factory=list)
    own: dict[str, str] = field(default_factory=dict)  # folders of the runs that this index wrote and no manifest names

    def __post_init__(self):
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"brindle_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor", "ctx")
        self.own[name] = folder = shared_dir(self.spark, "run")
        out = dealt.write.format("parquet").option("compression", "zstd").option("path", folder)
        out.bucketBy(self.buckets, "anchor").sortBy("anchor", "ctx").saveAsTable(name)
        return name

    def save(self, path: str) -> None:
        """The manifest: one row a run, with its folder and buckets."""
        where = lambda name: self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.createDataFrame([(k, where(n), self.buckets) for k, n in enumerate(self.runs)], "run int, folder string, buckets int").coalesce(1).write.parquet(path)
        self.own = {}

    @classmethod
    def reopen(cls, spark: SparkSession, path: str, documents: DataFrame) -> FingerprintIndex:
        """The index of a manifest; documents are the keyed documents of all its runs."""
        runs = spark.read.parquet(path).orderBy("run").collect()  # one row a run, MAX_RUNS + 1 at most
        index = cls(spark, runs[0]["buckets"], documents=[documents])
        for r in runs:
            name = f"brindle_run_{uuid.uuid4().hex}"
            columns = ", ".join(x for x in ROW.split(", ") if not x.startswith("again"))
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor, ctx) INTO {r['buckets']} BUCKETS LOCATION '{r['folder']}'")
            index.runs.append(name)
        return index

    def close(self) -> None:
        """Take the runs out of the catalogue; their files stay."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch of keyed documents; (k, lo, n): its window groups that start earlier, in history or in the batch."""
        if len(self.runs) > MAX_RUNS:
            self.compact()
        folder = shared_dir(self.spark, "marked")
        docs.select("k", "v", "text").mapInPandas(anchor_batches, ROW).write.partitionBy("again").option("compression", "zstd").parquet(folder)
        marked = self.spark.read.schema(ROW).parquet(folder)
        run = self._write(marked.where("NOT again").drop("again"))
        remove_folder(self.spark, f"{folder}/again=false")  # the run holds them now
        here = marked.where("again").select(*PLACE)
        new = self.spark.table(run)  # bucketed by anchor as all runs are, so nothing moves in these joins
        new = new.join(self.spark.table(run).groupBy("anchor").agg(F.count("*").alias("c")), "anchor")
        past = []
        for k, name in enumerate(self.runs):
            old = self.spark.table(name)
            past.append(old.join(self.spark.table(run).select("anchor"), "anchor", "left_semi").withColumn("old", F.lit(True)))
            known = old.groupBy("anchor").agg(F.lit(True).alias(f"in{k}"))
            new = new.join(known, "anchor", "left").withColumn("c", F.when(F.col(f"in{k}"), 2).otherwise(F.col("c"))).drop(f"in{k}")
        rows = new.where("c > 1").drop("c").withColumn("old", F.lit(False))
        for p in past:
            rows = rows.unionByName(p)
        by = Window.partitionBy("anchor", "ctx").orderBy("k", "lo")
        rows = rows.withColumns({"rank": F.rank().over(by), "head": (F.row_number().over(by) == 1).cast("int")})
        rows = through_table(rows.select("anchor", *PLACE, "old", "rank", "head"), "anchors")
        same = rows.where("rank > 1 AND NOT old").select(*PLACE)
        several = rows.where("head = 1").groupBy("anchor").count().where("count > 1").select("anchor")  # one anchor in different words
        self.runs.append(run)
        self.documents.append(docs)
        first = rows.where("rank = 1").join(several, "anchor", "left_semi")  # more than the head, if rows of one id tie
        windows = self._windows(first.select(*PLACE))
        return here.unionAll(same).unionAll(windows)

    def _windows(self, groups: DataFrame) -> DataFrame:
        """(k, v, lo, n = 1) of windows that start earlier elsewhere among the given groups."""
        groups = groups.groupBy("k", "v").agg(F.collect_set(F.struct("lo", "n")).alias("groups"))  # at most a document's windows
        hashed = None
        for docs in self.documents:  # the columns of the join with all groups in remove_repeats, so that texts are shuffled once for both
            part = docs.join(groups, ["k", "v"]).select("doc_id", "k", "v", "text", "groups").mapInPandas(window_batches, "a long, b long, k long, v long, lo int, again boolean")
            hashed = part if hashed is None else hashed.unionAll(part)
        rank = F.rank().over(Window.partitionBy("a", "b").orderBy("k", "lo"))
        later = hashed.where("NOT again").withColumn("rank", rank).where("rank > 1")
        one = ("k", "v", "lo", F.lit(1).alias("n"))
        return later.select(*one).unionAll(hashed.where("again").select(*one))

    def compact(self) -> None:
        """Merge all runs into one, keeping the first row of equal words; what it replaces goes, unless a manifest names it."""
        rows = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        first = rows.groupBy("anchor", "ctx").agg(F.min(F.struct("k", "lo", "v", "n")).alias("f"))
        merged = self._write(first.select("anchor", "ctx", "f.k", "f.v", "f.lo", "f.n"))
        replaced = [self.own.pop(name) for name in self.runs if name in self.own]
        self.close()
        for folder in replaced:
            remove_folder(self.spark, folder)
        self.runs = [merged]


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row, indexing the documents in so many batches by id."""
    rows = keyed(docs)
    cuts = rows.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    index, out = FingerprintIndex(docs.sparkSession), None
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows.where((F.col("k") > low if low is not None else F.lit(True)) & (F.col("k") <= high if high is not None else F.lit(True)))
        gone = index.add(part).groupBy("k", "v").agg(F.collect_list(F.struct("lo", "n")).alias("groups"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        done = part.join(gone, ["k", "v"], "left").select("doc_id", "k", "v", "text", "groups").mapInPandas(removal_batches, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
        out = done if out is None else out.unionAll(done)
    index.close()  # what is left to do reads texts and written rows only
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
