"""Near-duplicates by improved consistent weighted sampling (operator 4).

A document is a weighted set of five-word shingles (lower-cased words; a shorter
text is one shingle). The weight of a shingle is its count times the mean
inverse document frequency of its words, where words share a table of 2^18
hashed cells that is counted over all documents, so what tasks are sent has a
fixed size. ``SAMPLES`` consistent samples of a set agree between two documents
with the probability of their weighted Jaccard similarity; bands of ``ROWS``
samples are the candidate keys, and every candidate pair is verified by the
exact weighted Jaccard similarity of the whole texts.

Equal texts are one node from the start; the texts of nodes that share a bucket
are stored once, bucketed by digest, so that no later step shuffles them again.
In a bucket, members are verified against pivots only: the member that shares
most buckets with others (the original of a group of copies, if it is there) and
a few chosen by hash, which is linear in the bucket and covers small buckets
wholly. Larger buckets with one central member are then taken together, and what
is still in different components there is compared by ``WIDE`` one-bit samples;
those pairs are verified that differ in no more places than a just similar pair
does plus four and a half standard deviations (a weighted similarity of about
0.74). So no link between different classes is left
out, copies are never paired with each other, and pairs of text that are not
similar are not made.

Defined cases: a null text is empty; documents without words are classes of
their own; repeated rows share a class; class_id is the least doc_id of a class
(nulls count as greater); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .hashing import U, hashed_words, mixed, window_hashes
from .text import WS_CHARS, bound_batches, shared_dir, table, through_table

SHINGLE = 5
LEAST = 0.8
CELLS = 1 << 18
SAMPLES = 48
ROWS = 4
POOL = 1 << 16
WIDE = 2048  # samples that decide which pairs are verified beyond those with pivots
PIVOTS = 4  # chosen by hash in a bucket, besides the central one

_rng = np.random.default_rng(7)
_odd = _rng.integers(0, 2**63, WIDE, dtype=np.uint64) * U(2) + U(1)
_r = (-np.log(_rng.random(POOL)) - np.log(_rng.random(POOL))).astype(np.float32)  # Gamma(2, 1)
_log_c = np.log(-np.log(_rng.random(POOL)) - np.log(_rng.random(POOL))).astype(np.float32)
_beta = _rng.random(POOL).astype(np.float32)
_inv_r = (1 / _r).astype(np.float32)


def lowered(texts: pd.Series) -> list[str]:
    return [t.lower() if t else "" for t in texts]


def count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, docs = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        docs += len(batch)
        for _, n, h, count in hashed_words(lowered(batch["text"])):
            doc = np.repeat(np.arange(n, dtype=np.int64), count)
            total += np.bincount(np.unique(doc * CELLS + (h % U(CELLS)).astype(np.int64)) % CELLS, minlength=CELLS)
    cell = np.flatnonzero(total)
    yield pd.DataFrame({"cell": np.append(cell, -1), "n": np.append(total[cell], docs)})


def word_idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by hashed cell; 2^18 numbers whatever the corpus."""
    rows = docs.select("text").mapInPandas(count_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(CELLS), 0
    for_cell = rows[rows["cell"] >= 0]
    df[for_cell["cell"].to_numpy(np.int64)] = for_cell["n"]
    if len(last := rows[rows["cell"] < 0]):
        n = int(last["n"].sum())
    return (np.round((np.log((1 + n) / (1 + df)) + 1) * 65536) / 65536).astype(np.float32)  # sums of these are exact in any order


def weighted_sets(texts: list[str], idf: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, shingle hashes, weights, distinct shingles of each text), texts by chunks, hashes of a text ascending."""
    for at, n, h, count in hashed_words(texts, most):
        first = np.cumsum(count) - count
        weight = np.concatenate([[0], np.cumsum(idf[(h % U(CELLS)).astype(np.int64)], dtype=np.float64)])
        number = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(n, dtype=np.int64), number)
        start = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        long = count[doc] >= SHINGLE
        s, w = np.zeros(len(doc), np.uint64), np.zeros(len(doc))
        s[long] = window_hashes(h, SHINGLE)[start[long]]
        w[long] = (weight[start[long] + SHINGLE] - weight[start[long]]) / SHINGLE
        for k in np.flatnonzero(~long):
            a, m = start[k], count[doc[k]]
            s[k] = mixed(np.bitwise_xor.reduce(mixed(h[a : a + m] + U(1) * np.arange(1, m + 1, dtype=np.uint64)))[None])[0]
            w[k] = (weight[a + m] - weight[a]) / m
        order = np.lexsort((s, doc))
        s, w, doc = s[order], w[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(new)
        yield at, s[new], np.add.reduceat(w, where) if len(w) else w, np.bincount(doc[new], minlength=n)


def signatures(s: np.ndarray, w: np.ndarray, count: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Consistent weighted samples (texts x samples) of sets laid end to end; texts without shingles give zeros."""
    out = np.zeros((len(count), samples), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    size = count[full]
    first = np.cumsum(size) - size
    log_w = np.log(w).astype(np.float32)
    for k in range(samples):
        at = ((s * _odd[k]) >> U(48)).astype(np.int64)
        t = np.floor(log_w * _inv_r[at] + _beta[at])
        log_a = _log_c[at] - _r[at] * (t - _beta[at] + np.float32(1))
        hit = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, first), size))
        hit = hit[np.searchsorted(hit, first)]
        out[full, k] = mixed(s[hit] ^ mixed(t[hit].astype(np.int64).view(np.uint64) + U(k)))
    return out


def sign_batches(idf: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    bands = SAMPLES // ROWS
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = lowered(batch["text"])
            keys: list[list[int]] = []
            for _, s, w, count in weighted_sets(texts, idf):
                sig = signatures(s, w, count)
                key = np.repeat(salt[None, :], len(sig), 0)
                for j in range(ROWS):
                    key = mixed(key ^ sig[:, j::ROWS][:, :bands] * U(2 * j + 3))
                keys += [row if n else [] for row, n in zip(key.view(np.int64).tolist(), count, strict=True)]
            node = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": node, "keys": keys})

    return run


def wide_batches(idf: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One bit of each of WIDE samples of each text, packed into longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wide: list[list[int]] = []
            for _, s, w, count in weighted_sets(lowered(batch["text"]), idf):
                bits = (signatures(s, w, count, WIDE) & U(1)).astype(np.uint8)
                wide += np.packbits(bits, axis=1).view(">i8").tolist()
            yield pd.DataFrame({"id": batch["id"], "wide": wide})

    return run


def most_misses(least: float, bits: int = WIDE, deviations: float = 4.5) -> int:
    """Differing bits of a pair that is just similar enough, plus so many standard deviations."""
    p = (1 - least) / 2  # half of the differing samples have equal bits
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def misses(a: str, b: str, bits: int = WIDE) -> Column:
    """Bits at which the first so many bits of two packed signatures differ."""
    return reduce(lambda p, q: p + q, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)])


def close(a: str, b: str, least: float) -> Column:
    """Whether two packed signatures may be of a similar pair; an eighth of the bits settles most pairs."""
    return reduce(lambda p, q: p & q, [misses(a, b, n) <= most_misses(least, n) for n in (WIDE // 8, WIDE)])


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets with ascending hashes."""
    at = np.minimum(np.searchsorted(two[0], one[0]), max(len(two[0]) - 1, 0))
    both = two[0][at] == one[0] if len(two[0]) else np.zeros(len(one[0]), bool)
    low, high = np.minimum(one[1][both], two[1][at[both]]).sum(), one[1].sum() + two[1].sum()
    return float(low / (high - low)) if high > low else 0.0


def verify_batches(idf: np.ndarray, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sets(texts: pd.Series) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        distinct = list(dict.fromkeys(texts))
        out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for at, s, w, count in weighted_sets([t.lower() for t in distinct], idf):
            ends = np.cumsum(count)
            out |= {distinct[at + k]: (s[e - n : e], w[e - n : e]) for k, (e, n) in enumerate(zip(ends, count, strict=True))}
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):  # bounds the sets held at once
                part = batch.iloc[at : at + 1000]
                known = sets(pd.concat([part["text_a"], part["text_b"]]))
                sim = np.array([similarity(known[a], known[b]) for a, b in zip(part["text_a"], part["text_b"], strict=True)])
                yield part[["a", "b"]].assign(similarity=sim)[sim >= least]

    return run


def bucketed(rows: DataFrame, key: str, purpose: str) -> str:
    """Write rows, which an aggregation or join has dealt by key, as a table bucketed and sorted by key; its name."""
    spark = rows.sparkSession
    name, n = f"brindle_{purpose}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, purpose))
    out.bucketBy(n, key).sortBy(key).saveAsTable(name)
    return name


def digest(text: Column) -> Column:
    """The node of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signed_texts(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return through_table(docs.mapInPandas(sign_batches(idf), f"doc_id {kind}, node binary, keys array<long>"), "signed")


def text_classes(docs: DataFrame, signed: DataFrame, idf: np.ndarray, least: float = LEAST) -> DataFrame:
    """(node, class_id, first) of every distinct text with words; first marks the text of the class's least doc_id."""
    spark = docs.sparkSession
    keyed = signed.where(F.size("keys") > 0).groupBy("node").agg(F.first("keys").alias("keys"))  # equal texts have equal keys
    nodes = through_table(keyed.select(F.monotonically_increasing_id().alias("id"), "node", "keys"), "nodes")
    members = nodes.select("id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    order = F.pmod(F.xxhash64("key", "id"), F.col("n"))  # each of a bucket's pivots by hash has its turn
    shared = through_table(members.join(buckets, "key").withColumn("turn", order), "buckets")
    nodes = nodes.select("id", "node").join(shared.select("id").distinct(), "id", "left_semi")
    nodes = through_table(nodes, "shared")
    texts = docs.groupBy(digest(F.col("text")).alias("node")).agg(F.first("text").alias("text"))
    store = bucketed(texts.join(nodes.select("node").hint("merge"), "node", "left_semi"), "node", "texts")
    try:
        labels = linked(spark, shared, nodes, store, idf, least)
    finally:
        spark.sql(f"DROP TABLE {store}")  # the files stay in the shared folder
    equal = signed.where(F.size("keys") > 0).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = equal.join(nodes.join(labels.withColumnRenamed("node", "id"), "id").select("node", "label"), "node", "left")
    named = through_table(named, "named")
    order = F.struct(F.col("least").isNull(), "least", "node")
    classes = named.where("label IS NOT NULL").groupBy("label").agg(F.min(order)["node"].alias("head"), F.min("least").alias("class_id"))
    named = named.join(classes, "label", "left")
    return named.select("node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce(F.col("head") == F.col("node"), F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id of every row."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    idf = word_idf(docs)
    signed = signed_texts(docs, idf)
    named = text_classes(docs, signed, idf, least).select("node", "class_id")
    return signed.select("doc_id", "node").join(named, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, of each class of near-duplicates only one with the least doc_id; rows without words all stay.

    Rows are told apart by their texts, not by doc_id, so ids may repeat or be null.
    """
    bound_batches(docs.sparkSession)
    read = docs.select("doc_id", "text")
    idf = word_idf(read)
    copies = text_classes(read, signed_texts(read, idf), idf, least).where("NOT first").select("node")
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(WS_CHARS)) == ""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.where(~blank).select(digest(F.col("text")).alias("node"), row.alias("row"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(row)).alias("turn"))
    texts = rows.groupBy("node").agg(F.min_by("row", "turn").alias("row"))
    return texts.join(copies.hint("merge"), "node", "left_anti").select("row.*").unionByName(docs.where(blank))


def linked(spark: SparkSession, shared: DataFrame, nodes: DataFrame, store: str, idf: np.ndarray, least: float) -> DataFrame:
    """(node, label) of the nodes that have links, from the buckets (key, id, n, turn)."""
    check = lambda pairs: through_table(verified(pairs, nodes, spark.table(store), idf, least), "links")
    ordered = lambda rows: rows.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    central = shared.select("key", "id").join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id"))["id"].alias("p"))
    central = through_table(central, "central")
    pivots = central.unionAll(shared.where(F.col("turn") < PIVOTS).select("key", F.col("id").alias("p"))).distinct()
    done = through_table(ordered(shared.join(pivots, "key").where("id <> p")), "pairs")
    links = check(done)
    labels = components(links)
    placed = shared.where(F.col("n") > PIVOTS).join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = placed.join(split, "key", "left_semi").join(central, "key").select(F.col("p").alias("key"), "id", "label").distinct()
    rest = through_table(rest, "rest")  # buckets of one central member are one, so a pair meets once in them
    found = rest.select("id").distinct().join(nodes, "id").join(spark.table(store), "node")
    wide = through_table(found.select("id", "text").mapInPandas(wide_batches(idf), "id long, wide array<long>"), "wide")
    left, right = (rest.withColumnsRenamed({"id": x, "label": f"label_{x}"}).join(wide.withColumnsRenamed({"id": x, "wide": f"wide_{x}"}), x) for x in "ab")
    near = left.join(right, (left.key == right.key) & (F.col("label_a") < F.col("label_b")) & close("wide_a", "wide_b", least))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = check(through_table(near.join(done, ["a", "b"], "left_anti"), "pairs"))
    return labels if more.isEmpty() else merged(labels, more)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with further links: only components and nodes without one are linked anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    up = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = components(up.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    known = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return known.unionAll(top.join(labels.select("node"), "node", "left_anti").select("node", "label"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Pairs of nodes whose texts are similar enough; texts is bucketed by node, so only pairs move."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("node").alias(f"node_{x}"))
    text = lambda x: texts.select(F.col("node").alias(f"node_{x}"), F.col("text").alias(f"text_{x}")).hint("merge")
    named = pairs.join(side("a"), "a").join(side("b"), "b")
    both = named.join(text("a"), "node_a").join(text("b"), "node_b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(verify_batches(idf, least), "a long, b long, similarity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
