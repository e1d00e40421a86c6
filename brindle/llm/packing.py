"""Mixture-controlled packing (operator 8).

Every source is a queue of its documents, whose tokens are served in quanta.
Windows of ``WINDOW`` tokens are filled by deficit round-robin: with every slot of
a window a source is owed its target proportion of a quantum, the slot goes to
the source whose deficit reached half a quantum first, and what a source is owed
is carried to the next window. When a queue is exhausted, its proportion is
shared among the others by theirs. The targets are given as weights of sources;
without them they are the sources' own shares, so that all last to the end.

What a source has been owed at a time is a line with a bend where another queue
ends, so a quantum's due time, and the number of quanta of other sources that are
due before it, have a closed form. Every task thus places its own documents
exactly, with the deficits of all windows and partitions before, and no state is
handed from window to window or from partition to partition.

What fills no whole window (fewer quanta than a window has, and less than a
quantum of each source) is laid end to end, cut into windows, and the rest into
lengths that are powers of two, so nothing is padded.

Documents are tokenized once; ids go to a table in the shared folder, whose
partitions and row order define the queues. Where the queue of each partition
and source begins goes to a short table of its own. The driver holds one row per
source (documented bound: sources, not documents).

Defined cases: a null or empty text is the end id alone; a null source is a
queue of its own; repeated rows are packed as often as they stand; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import table, through_table

WINDOW = 2048
QUANTUM = 256
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000
NON_SPACE = re.compile(r"[^ \t-\r]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next above 255."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Word -> its ids as bytes, encoded at the first use and kept while the process lives.

    A word of Latin letters, with or without full stops and commas behind it, is
    split into letters and marks by the tokenizer in any case; its letters go to
    the vocabulary's merges directly. All other words take the whole tokenizer.
    """

    kept: dict[str, WordIds] = {}

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
        self.letter = byte_letters()

    @classmethod
    def of(cls, path: str, end_id: int) -> WordIds:
        have = cls.kept.get(path)
        if have is None or len(have) > CACHE_WORDS:
            have = cls.kept[path] = cls(path, end_id)
        return have

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,").lower()
        if core != word and self.latin(core):
            data = self[core] + (self[word[len(core) :]] if len(word) > len(core) else b"")
        elif core == word and self.latin(word):
            text = word if word.isascii() else "".join(self.letter[b] for b in word.encode())
            data = np.array([t.id for t in self.tok.model.tokenize(text)], self.kind).tobytes()
        else:
            data = np.array(self.tok.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = data
        return data

    @staticmethod
    def latin(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def tokenize_batches(path: str, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with ids (binary, little-endian 32-bit or 16-bit) and the document's place in its (partition, source) queue.

    The tokenizer drops white space and never joins across it, so texts are encoded word by word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        pid, queued = TaskContext.get().partitionId(), {}
        for batch in batches:
            known = WordIds.of(path, end_id)
            wide, end = np.dtype(known.kind).itemsize, np.array([end_id], known.kind).tobytes()
            ids, counts, places = [], [], []
            for text, key in zip(batch.pop("text"), batch["skey"], strict=True):
                data = b"".join(map(known.__getitem__, NON_SPACE.findall(text or ""))) + end
                n = len(data) // wide
                ids.append(data)
                counts.append(n)
                places.append(queued.get(key, 0))
                queued[key] = places[-1] + n
            yield batch.assign(pid=pid, n=np.array(counts, np.int64), place=np.array(places, np.int64), wide=wide, ids=ids)

    return run


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "text")
    return rows.mapInPandas(tokenize_batches(path or tokenizer_path(), end_id), f"doc_id {kind}, skey string, pid int, n long, place long, wide int, ids binary")


@dataclass(frozen=True)
class Schedule:
    """Where every token of every source goes; sources are numbered in the order of their keys."""

    totals: tuple[int, ...]
    window: int = WINDOW
    quantum: int = QUANTUM
    targets: tuple[float, ...] | None = None  # weights; the totals if not given

    def __post_init__(self):
        assert self.window % self.quantum == 0
        put = lambda k, v: object.__setattr__(self, k, v)
        slots = [t // self.quantum for t in self.totals]
        put("slots", slots), put("lines", self._lines(slots, self.targets))
        per = self.window // self.quantum
        windows = sum(slots) // per
        kept = []
        for s, n in enumerate(slots):
            last = np.arange(max(0, n - per), n)
            kept.append(n - int((self.rank(s, last) >= windows * per).sum()))
        tails = [t - k * self.quantum for t, k in zip(self.totals, kept, strict=True)]
        rest, cuts = sum(tails), []
        for at in range(0, rest - rest % self.window, self.window):
            cuts.append(at)
        at, size = rest - rest % self.window, self.window
        while at < rest:
            if rest - at >= size:
                cuts.append(at)
                at += size
            else:
                size //= 2
        put("windows", windows), put("kept", kept)
        put("tail_at", np.concatenate([[0], np.cumsum(tails)]).astype(np.int64)), put("cuts", np.array([*cuts, rest], np.int64))

    @staticmethod
    def _lines(slots: list[int], targets: tuple[float, ...] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each source the quanta it has been owed, and the slots of all sources, at each bend."""
        left, weight = np.array(slots, float), np.array(slots if targets is None else targets, float)
        owed, time, lines = np.zeros(len(slots)), 0.0, [([0.0], [0.0]) for _ in slots]
        while (left > 0).any():
            rate = np.where(left > 0, weight, 0.0)
            if not rate.any():  # sources without a weight come last, by what they have
                rate = left.copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(rate > 0, left / rate, np.inf)
            served = np.where(step <= step.min(), left, rate * step.min())
            time, owed, left = time + served.sum(), owed + served, np.where(step <= step.min(), 0.0, left - served)
            for s in np.flatnonzero(served):
                lines[s][0].append(owed[s]), lines[s][1].append(time)
            for s in np.flatnonzero((served == 0) & (left > 0)):
                lines[s][1][-1] = time  # has not begun yet
        return [(np.array(x), np.array(t)) for x, t in lines]

    def due(self, s: int, j: np.ndarray) -> np.ndarray:
        """The time at which source s is owed half of its quantum j; never falls with j."""
        x, t = self.lines[s]
        k = np.clip(np.searchsorted(x, j + 0.5, "right") - 1, 0, len(x) - 2)
        return np.minimum(t[k] + (j + 0.5 - x[k]) * ((t[k + 1] - t[k]) / (x[k + 1] - x[k])), t[k + 1])

    def rank(self, s: int, j: np.ndarray) -> np.ndarray:
        """Quanta of all sources that are due before quantum j of source s, ties by the number of the source."""
        out = np.array(j, np.int64)
        if not len(out):
            return out
        when = self.due(s, out)
        for other, n in enumerate(self.slots):
            if other == s or not n:
                continue
            before = lambda c: (self.due(other, c) < when) | (self.due(other, c) == when) & (other < s)  # noqa: E731, B023
            c = np.clip(np.floor(np.interp(when, self.lines[other][1], self.lines[other][0]) + 0.5), 0, n).astype(np.int64)
            while (wrong := (c > 0) & ~before(np.maximum(c - 1, 0))).any():
                c -= wrong
            while (wrong := (c < n) & before(np.minimum(c, n - 1))).any():
                c += wrong
            out = out + c
        return out

    def pieces(self, s: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents on the line of source s, (document, start, length, sequence, offset) of each piece."""
        end, edge = at + n, self.kept[s] * self.quantum
        first, last = at // self.quantum, -(-np.minimum(end, edge) // self.quantum)
        count = np.maximum(last - first, 0)
        doc = np.repeat(np.arange(len(at)), count)
        j = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.maximum(j * self.quantum, at[doc]), np.minimum((j + 1) * self.quantum, end[doc])
        rank, per = self.rank(s, j), self.window // self.quantum
        whole = (doc, low - at[doc], high - low, rank // per, rank % per * self.quantum + low - j * self.quantum)
        rows = np.nonzero(end > edge)[0]
        a = np.maximum(at[rows], edge) - edge + self.tail_at[s]
        b = end[rows] - edge + self.tail_at[s]
        lo, hi = np.searchsorted(self.cuts, a, "right") - 1, np.searchsorted(self.cuts, b, "left")
        count = hi - lo
        doc = np.repeat(np.arange(len(rows)), count)
        c = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.maximum(self.cuts[c], a[doc]), np.minimum(self.cuts[c + 1], b[doc])
        start = low - self.tail_at[s] + edge - at[rows][doc]
        tail = (rows[doc], start, high - low, self.windows + c, low - self.cuts[c])
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(whole, tail, strict=True))


def piece_batches(keys: list[str], plan: Schedule) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    number = {k: i for i, k in enumerate(keys)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for key, own in batch.groupby("skey", sort=False):
                at = own["at"].to_numpy()
                doc, start, length, seq, offset = plan.pieces(number[key], at, own["n"].to_numpy())
                data = [memoryview(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(own["ids"], own["wide"], strict=True)]
                crc = [zlib.crc32(data[d][4 * a : 4 * (a + m)]) for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                ids, total = own["doc_id"].to_numpy()[doc], own["n"].to_numpy()[doc]
                parts.append(pd.DataFrame({"doc_id": ids, "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": total, "sequence_id": seq, "offset": offset}))
            if parts:
                yield pd.concat(parts)

    return run


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, quantum: int = QUANTUM, targets: dict[str | None, float] | None = None
) -> DataFrame:
    """One row per piece; sequences are gapless from offset 0. targets: weights of sources (0 where not named: they come last)."""
    tokens = through_table(tokenized(docs, path, end_id), "tokens")
    queues = tokens.groupBy("skey", "pid").agg(F.sum("n").alias("queued"))
    before = F.sum("queued").over(Window.partitionBy("skey").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("queued")
    # written, so that the size of this short table is known when the join is planned and ids need no shuffle
    base = through_table(queues.select("skey", "pid", "queued", before.alias("base")), "queues")
    totals = base.groupBy("skey").agg(F.sum("queued").alias("n")).orderBy("skey").collect()  # one row per source
    weight = None if targets is None else {"" if k is None else f"={k}": v for k, v in targets.items()}
    weights = None if weight is None else tuple(weight.get(r["skey"], 0.0) for r in totals)
    plan = Schedule(tuple(r["n"] for r in totals), window, quantum, weights)
    placed = tokens.join(base.drop("queued"), ["skey", "pid"]).select("doc_id", "skey", (F.col("base") + F.col("place")).alias("at"), "n", "wide", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInPandas(
        piece_batches([r["skey"] for r in totals], plan),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
