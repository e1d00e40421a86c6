"""Toxicity: a bidirectional GRU with attention pooling, trained in numpy (operator 6).

A word enters as two vectors: one of its own, if it is among the ``VOCABULARY``
most frequent training words, and the mean of those of its hashed character
n-grams. A text is read in overlapping windows of ``WINDOW`` words, each starting
``STRIDE`` words after the last and the final one ending with the text; a window is pooled by attention and its logit
taken, and a document's logit is its largest. Training is by multiple instances:
in every epoch all windows are scored and the largest of each document learns
the document's label.

Labels are learnt from at most ``MOST`` documents of each label (the documented
bound of the sample, picked by a hash of doc_id) among those whose crc32(doc_id)
mod 5 is not 0, of a longer text from ``MOST_WORDS`` words in evenly spaced runs (so
the driver holds 2 x MOST x MOST_WORDS words at most, of 100 characters at most in
a text that is cut); scoring covers all windows of all documents whole.

Defined cases: a null text is empty; an empty text is one window of one blank
word; without labelled rows every score is the blank model's; repeated rows give
repeated result rows, and repeated labels or documents train once; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table

WINDOW, STRIDE = 24, 16
MOST = 1500
MOST_WORDS = 8192
VOCABULARY = 4000
GRAMS = 1 << 14
D, H = 8, 8
EPOCHS, BATCH, RATE = 16, 32, 0.01
WORD = re.compile(r"[^\W_]+")
CHUNK = 4096


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of three to five characters of each word, edges marked, and how many each word has."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    grams, owner = [], []
    for n in (2, 3, 4, 5):
        at = np.flatnonzero(left >= n if n > 2 else (left == 2) & (np.repeat(size, size) == 2))  # an empty word has one gram
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = (h + codes[at + j] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(((h >> np.uint64(40)) % np.uint64(GRAMS)).astype(np.int64))
        owner.append(word[at])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    return grams[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Batch:
    """Windows as rows of indices into the distinct words; -1 where a window has ended."""

    def __init__(self, texts: list[str | None], words: dict[str, int]):
        seen: dict[str, int] = {}
        ids, count = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = [seen.setdefault(w, len(seen)) for w in WORD.findall((t or "").lower())] or [seen.setdefault("", len(seen))]
            ids.append(np.array(own, np.int32))
            count[k] = len(own)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        per = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        first = np.repeat(np.cumsum(count) - count, per)
        at = np.minimum(nth * STRIDE, np.maximum(count - WINDOW, 0)[self.doc])[:, None] + np.arange(WINDOW)
        inside = at < count[self.doc][:, None]
        self.rows = np.where(inside, flat[np.minimum(first[:, None] + at, max(len(flat) - 1, 0))], -1) if len(flat) else np.zeros((0, WINDOW), np.int32)
        self.word = np.array([words.get(w, 0) for w in seen], np.int64)
        self.gram, self.n_grams = gram_ids(list(seen))


class BiGRU:
    def __init__(self, words: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        init = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        self.words = {w: i for i, w in enumerate(words, 1)}
        self.p = {"word": init(len(words) + 1, D), "gram": init(GRAMS, D)}
        for way in "fb":
            self.p |= {f"W{way}": init(2 * D, 3 * H), f"U{way}": init(H, 3 * H), f"c{way}": np.zeros(3 * H, np.float32)}
        self.p |= {"A": init(2 * H, H), "a": np.zeros(H, np.float32), "v": init(H), "o": init(2 * H), "bias": np.full(1, -1, np.float32)}

    def inputs(self, b: Batch) -> np.ndarray:
        """Vectors of the distinct words."""
        starts = np.cumsum(b.n_grams) - b.n_grams
        grams = np.add.reduceat(self.p["gram"][b.gram], starts) / b.n_grams[:, None] if len(starts) else np.zeros((0, D))
        return np.concatenate([self.p["word"][b.word], grams], 1).astype(np.float32)

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows; with keep also what backward needs. x: vectors of distinct words."""
        p, n = self.p, len(rows)
        mask = rows >= 0
        full = bool(mask.all())
        states, trace = np.zeros((n, WINDOW, 2 * H), np.float32), {}
        for way, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            xw = np.concatenate([x @ p[f"W{way}"] + p[f"c{way}"], np.zeros((1, 3 * H), np.float32)])
            h, steps = np.zeros((n, H), np.float32), []
            for t in order:
                i = xw[rows[:, t]]
                u = h @ p[f"U{way}"]
                zr = sigmoid(i[:, : 2 * H] + u[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(i[:, 2 * H :] + r * u[:, 2 * H :])
                new = c + z * (h - c)
                if not full:
                    new = np.where(mask[:, t : t + 1], new, h)
                if keep:
                    steps.append((t, h, z, r, c, u[:, 2 * H :]))
                h = new
                states[:, t, slice(0, H) if way == "f" else slice(H, 2 * H)] = h
            trace[way] = steps
        s = np.tanh(states @ p["A"] + p["a"])
        e = np.where(mask, s @ p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        w = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", w, states)
        logit = pooled @ p["o"] + p["bias"][0]
        return (logit, (mask, states, trace, s, w, pooled)) if keep else logit

    def backward(self, b: Batch, x: np.ndarray, rows: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        mask, states, trace, s, w, pooled = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"][0], g["o"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["o"]
        d_states = w[:, :, None] * d_pooled[:, None, :]
        d_w = np.einsum("ntk,nk->nt", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", d_e, s)
        d_s = d_e[:, :, None] * p["v"] * (1 - s * s)
        g["A"], g["a"] = np.einsum("ntk,nth->kh", states, d_s), d_s.sum((0, 1))
        d_states += d_s @ p["A"].T
        d_x = np.zeros((len(x) + 1, 2 * D), np.float32)
        for way, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            d_h, d_xw = np.zeros((len(rows), H), np.float32), np.zeros((len(x) + 1, 3 * H), np.float32)
            for t, h, z, r, c, u in reversed(trace[way]):
                d_h = d_h + d_states[:, t, part]
                m = mask[:, t : t + 1]
                d_new = np.where(m, d_h, 0)
                d_z = d_new * (h - c) * z * (1 - z)
                d_c = d_new * (1 - z) * (1 - c * c)
                d_r = d_c * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                np.add.at(d_xw, rows[:, t], np.concatenate([d_z, d_r, d_c], 1))
                g[f"U{way}"] += h.T @ d_u
                d_h = np.where(m, d_new * z, d_h) + d_u @ p[f"U{way}"].T
            d_xw = d_xw[:-1]
            g[f"c{way}"], g[f"W{way}"] = d_xw.sum(0), x.T @ d_xw
            d_x[:-1] += d_xw @ p[f"W{way}"].T
        np.add.at(g["word"], b.word, d_x[:-1, :D])
        np.add.at(g["gram"], b.gram, np.repeat(d_x[:-1, D:] / b.n_grams[:, None], b.n_grams, 0))
        return g

    def logits(self, b: Batch) -> np.ndarray:
        x = self.inputs(b)
        order = np.argsort(b.rows[:, -1] < 0, kind="stable")  # windows without blanks first
        out = np.zeros(len(order), np.float32)
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            out[part] = self.forward(x, b.rows[part])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text's most toxic window."""
        out = []
        for at in range(0, len(texts), 4000):
            b = Batch(texts[at : at + 4000], self.words)
            z = self.logits(b)
            out.append(sigmoid(np.maximum.reduceat(z, np.flatnonzero(np.diff(b.doc, prepend=-1)))))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> BiGRU:
    """Adam on the cross-entropy of each document's largest window, classes weighted alike."""
    counts = Counter(w for t in texts for w in set(WORD.findall(t.lower())))
    model = BiGRU([w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3], seed)
    if not len(texts) or len(set(labels.tolist())) < 2:
        return model
    rng, y = np.random.default_rng(seed), labels.astype(np.float32)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    b = Batch(texts, model.words)
    first = np.flatnonzero(np.diff(b.doc, prepend=-1))
    size = np.diff(np.append(first, len(b.doc)))
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        if epoch < 2:  # before the model knows anything, any window may speak for its text
            chosen = first + (rng.random(len(first)) * size).astype(np.int64)
        elif epoch % 2 == 0:
            z = model.logits(b) + rng.normal(0, 0.05, len(b.rows))
            top = np.repeat(np.maximum.reduceat(z, first), size)
            hit = np.flatnonzero(z == top)
            chosen = hit[np.searchsorted(hit, first)]
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            rows = b.rows[chosen[pick]]
            used, local = np.unique(rows[rows >= 0], return_inverse=True)
            small = np.full(rows.shape, -1, np.int64)
            small[rows >= 0] = local
            part = Batch.__new__(Batch)
            starts = (np.cumsum(b.n_grams) - b.n_grams)[used]
            part.word, part.n_grams = b.word[used], b.n_grams[used]
            part.gram = np.concatenate([b.gram[s : s + n] for s, n in zip(starts, part.n_grams, strict=True)])
            x = model.inputs(part)
            z, kept = model.forward(x, small, True)
            g = model.backward(part, x, small, kept, (sigmoid(z) - y[pick]) * weight[pick] / len(pick))
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.001 * (v * v - m2[k])
                model.p[k] -= rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)
    return model


def shortened(text: str) -> str:
    """A text of more than ``MOST_WORDS`` words by evenly spaced runs of ``STRIDE`` words, as many words in all."""
    words = text.split()
    if len(words) <= MOST_WORDS:
        return text if len(text) <= 100 * MOST_WORDS else " ".join(w[:100] for w in words)
    starts = np.linspace(0, len(words) - STRIDE, MOST_WORDS // STRIDE).astype(int)
    return " ".join(w[:100] for at in starts.tolist() for w in words[at : at + STRIDE])


def shorten_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[shortened(t or "") for t in batch["text"]])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST) -> pd.DataFrame:
    """At most ``most`` texts of each label, by hash of doc_id, never of a held-out row, each of ``MOST_WORDS`` words at most.

    A doc_id counts once: toxic if any of its labels is, with the least of its texts.
    """
    seen = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [seen.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]))  # 2 x most rows at most
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (docs.schema["doc_id"], labels.schema["toxic"]))
    found = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "toxic", "text").mapInPandas(shorten_batches, f"{kinds}, text string")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")


def score_batches(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].assign(score=shared.value.scores(batch["text"].to_list()))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sample = training_rows(docs, labels, most)
    model = fit([t or "" for t in sample["text"]], sample["toxic"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(score_batches(shared), f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
