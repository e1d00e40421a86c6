"""Quality classifier: interpolated modified Kneser-Ney perplexity (operator 2).

Symbols are the UTF-16 code units of the lower-cased text, with runs of white
space as one space; none is folded with another, and four of them are a long.
Trusted text is that of documents labelled quality = 1; all of it is counted.
Counts are sharded by n-gram, and so are the n-grams of all documents: these
stand among the counts, with zero where trusted text lacks them. Continuation
counts, contexts and discounts of each order come from groups of those shards,
and an n-gram's probability from a join with that of its shorter end. The
probabilities then go back, by join, to the documents that asked for them; no
model is gathered anywhere.

For this, documents are dealt by their id into buckets of some 16 MB of text.
A bucket asks once for each n-gram of a language, so what is joined are its
distinct n-grams and not their occurrences. Texts travel compressed.

Each language has a model; languages with fewer than ``MIN_TRUSTED`` trusted
documents, and documents without a language, use the model of all trusted text.

A document's perplexity is that of its symbols, with ``PRIOR`` symbols of its
language's mean added so that short texts are not judged by chance. A document
is rejected when this exceeds the ``QUANTILE`` of trusted documents of its
language by more than ``MARGIN``.

Defined cases: a null or empty text has the mean perplexity of its language and
is kept; without trusted text every document is kept; repeated rows give
repeated result rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .text import table, through_table

BITS = 16
A = 1 << BITS
ORDER = 4
MIN_TRUSTED = 100
QUANTILE = 0.99
MARGIN = 1.15
PRIOR = 150
ALL = "*"  # the model of all trusted text; a language of this name has no other
PART = 1 << 20  # symbols counted or scored at once
BUCKET = 16 << 20  # bytes of text in a bucket, on average

SPACE = np.array([chr(c).isspace() for c in range(A)])


def symbols(text: str | None) -> np.ndarray:
    """UTF-16 code units of the lower-cased text, runs of white space as one space."""
    s = np.frombuffer((text or "").lower().encode("utf-16-le", "surrogatepass"), np.uint16)
    space = SPACE[s]
    s = np.where(space, np.uint16(ord(" ")), s)
    return s[np.concatenate([[True], ~space[1:] | ~space[:-1]])] if len(s) else s


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the n-grams that end at each symbol, in parts; zeros stand before the text."""
    s = np.concatenate([np.zeros(ORDER - 1, np.uint16), symbols(text)])
    for at in range(0, len(s) - ORDER + 1, PART):
        part = s[at : at + PART + ORDER - 1].astype(np.int64)
        out = np.zeros(len(part) - ORDER + 1, np.int64)
        for j in range(ORDER):
            out = (out << BITS) | part[j : j + len(out)]
        yield out


def tally(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of some texts, ascending, and how often each stands."""
    g, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for part in chain(chain.from_iterable(map(grams, texts)), [None]):
        if part is not None:
            held.append(part)
            size += len(part)
        if held and (part is None or size >= PART):
            own, k = np.unique(np.concatenate(held), return_counts=True)
            g, at = np.unique(np.concatenate([g, own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), len(g)).astype(np.int64)
            held, size = [], 0
    return g, n


@F.pandas_udf(BinaryType())
def packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: zlib.compress((t or "").encode("utf-8", "surrogatepass")))


def unpacked(column: pa.ChunkedArray) -> Iterator[str]:
    return (zlib.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in column)


def buckets(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """doc_id, lang, the columns in carry, id, model, bucket and the packed text, and the number of buckets."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 256)).first()[0] or 0
    many = 1 + size // BUCKET
    dealt = docs.select("doc_id", "lang", *carry, "text", F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit(ALL)).alias("model"))
    dealt = dealt.withColumn("bucket", bucket_of(F.coalesce("id", "text", F.lit("")), many))  # rows without an id are dealt by their text
    return dealt.withColumn("text", packed("text")), many


def bucket_of(key: Column, many: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(many)).cast("int")


def count_bucket(docs: pa.Table, good: pa.Table) -> pa.Table:
    """The n-grams of each language in a bucket with their number in its trusted texts; a null n-gram has that of those texts."""
    trusted, out = pc.is_in(docs["id"], value_set=good["id"].combine_chunks()), []
    for model in pc.unique(docs["model"]):
        mine = pc.equal(docs["model"], model)
        (g, n), (other, _) = (tally(unpacked(docs["text"].filter(pc.and_(mine, x)))) for x in (trusted, pc.invert(trusted)))
        other = np.setdiff1d(other, g, assume_unique=True)
        texts = pc.sum(pc.and_(mine, trusted)).as_py() or 0
        codes = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(g), pa.array(other)])
        n = np.concatenate([[texts], n, np.zeros(len(other), np.int64)])
        out.append(pa.table({"model": pa.array([model.as_py()] * len(n), pa.string()), "g": codes, "n": pa.array(n.astype(np.int64))}))
    rows = pa.concat_tables(out) if out else pa.schema([("model", pa.string()), ("g", pa.int64()), ("n", pa.int64())]).empty_table()
    bucket = docs["bucket"][0].as_py() if len(docs) else 0
    return rows.append_column("bucket", pa.array(np.full(len(rows), bucket, np.int32)))


def counted(dealt: DataFrame, many: int, labels: DataFrame) -> DataFrame:
    """(model, g, n, bucket) of every bucket, with the model that its documents use, and own: whether that is one of their language."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("id")).withColumn("bucket", bucket_of(F.col("id"), many))
    docs = dealt.select("id", "model", "bucket", "text")
    rows = docs.groupBy("bucket").cogroup(good.groupBy("bucket")).applyInArrow(count_bucket, "model string, g long, n long, bucket int")
    rows = through_table(rows, "grams")
    own = rows.where("g IS NULL").groupBy("model").agg(F.sum("n").alias("texts"))
    own = through_table(own.select(F.col("model").alias("lang"), ((F.col("texts") >= MIN_TRUSTED) & (F.col("model") != ALL)).alias("own")), "models")
    rows = rows.where("g IS NOT NULL").withColumnRenamed("model", "lang").join(own, "lang")
    return rows.select("lang", F.when(F.col("own"), F.col("lang")).otherwise(F.lit(ALL)).alias("model"), "g", "n", "bucket", "own")


def probabilities(rows: DataFrame) -> DataFrame:
    """(model, g, p) of every n-gram asked for: the probability of its last symbol after the others. rows as of counted."""
    both = F.when(F.col("own") & (F.col("n") > 0), F.array("model", F.lit(ALL))).otherwise(F.array("model"))
    shards = [through_table(rows.select(F.explode(both).alias("model"), "g", "n").groupBy("model", "g").agg(F.sum("n").alias("c")), "order4")]
    for k in range(ORDER - 1, 0, -1):  # how many symbols are seen before the shorter n-gram
        shards.append(through_table(shards[-1].groupBy("model", ending(k).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")), f"order{k}"))
    p = None
    for k, shard in enumerate(reversed(shards), 1):
        few = shard.groupBy("model").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        d = [F.least(F.lit(float(i)), F.greatest(F.lit(0.0), F.coalesce(i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.5 * i)))) for i in (1, 2, 3)]
        few = F.broadcast(few.select("model", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)]))  # a row for each model
        context = Window.partitionBy("model", F.shiftrightunsigned("g", BITS))  # at most 2^16 symbols follow one
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = shard.join(few, "model").withColumn("cut", cut).withColumns({"total": F.sum("c").over(context), "left": F.sum("cut").over(context)})
        lower = F.lit(1 / A)
        if p is not None:
            seen = seen.withColumn("ending", ending(k - 1)).join(p.select("model", F.col("g").alias("ending"), F.col("p").alias("lower")), ["model", "ending"])
            lower = F.col("lower")
        p = seen.select("model", "g", F.when(F.col("total") > 0, (F.col("c") - F.col("cut") + F.col("left") * lower) / F.col("total")).otherwise(lower).alias("p"))
    return p


def ending(k: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))


def score_bucket(docs: pa.Table, asked: pa.Table) -> pa.Table:
    loss, size = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
    for model in pc.unique(docs["model"]):
        own = asked.filter(pc.equal(asked["lang"], model))
        g, p = own["g"].to_numpy(), own["loss"].to_numpy()
        order = np.argsort(g)
        g, p = g[order], p[order]
        mine = np.flatnonzero(pc.equal(docs["model"], model).to_numpy())
        for row, text in zip(mine, unpacked(docs["text"].take(mine)), strict=True):
            for part in grams(text):
                loss[row] += p[np.searchsorted(g, part)].sum()
                size[row] += len(part)
    return docs.drop_columns(["id", "model", "bucket", "text"]).append_column("loss", pa.array(loss)).append_column("n_symbols", pa.array(size))


def scores(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the columns in carry, loss (negative log-likelihood), n_symbols."""
    dealt, many = buckets(docs, carry)
    rows = counted(dealt, many, labels)
    asked = rows.join(probabilities(rows), ["model", "g"]).select("bucket", "lang", "g", (-F.log(F.greatest("p", F.lit(1e-12)))).alias("loss"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name not in ("id", "model", "bucket", "text"))
    return dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(score_bucket, f"{schema}, loss double, n_symbols long")


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the columns in carry, n_symbols, perplexity, threshold, kept of every row."""
    scored = through_table(scores(docs, labels, carry), "scores")
    good = scored.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    mean = lambda df, *by: df.groupBy(*by).agg(F.try_divide(F.sum("loss"), F.sum("n_symbols")).alias("mean"), F.count("*").alias("trusted"))
    own = mean(good, "lang").where((F.col("trusted") >= MIN_TRUSTED) & (F.col("lang") != ALL)).select(F.col("lang").alias("own_lang"), "mean")
    all_mean = mean(good).select(F.col("mean").alias("all_mean"))

    def shrunk(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(own), F.col("lang") == F.col("own_lang"), "left").join(all_mean)  # all_mean is one row
        group, centre = F.coalesce("own_lang", F.lit(ALL)), F.coalesce("mean", "all_mean", F.lit(0.0))
        return df.withColumns({"group": group, "perplexity": F.exp((F.col("loss") + PRIOR * centre) / (F.col("n_symbols") + PRIOR))})

    cut = shrunk(good).select("group", "perplexity")
    cut = cut.unionAll(cut.where(F.col("group") != ALL).withColumn("group", F.lit(ALL)))
    cut = cut.groupBy("group").agg((MARGIN * F.percentile_approx("perplexity", QUANTILE, 10000)).alias("threshold"))
    cut = F.broadcast(cut)  # a row for each model
    judged = shrunk(scored).join(cut.withColumnRenamed("group", "cut_group"), F.col("group") == F.col("cut_group"), "left")
    return judged.select("doc_id", "lang", *carry, "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
