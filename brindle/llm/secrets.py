"""Secret scans (operator 5).

Three fixed patterns give the base spans. Beyond them, every run of 16 or more
characters that a key could be made of is scored by two character Markov
models, one of random strings and one of ordinary identifiers, and becomes a
span of kind "markov" when the log-likelihood ratio exceeds ``MIN_RATIO`` (the
natural logarithm of a million: random strings may be that much rarer) and
``MIN_RATIO_PER_CHAR`` a character (long ordinary paths have a weak surplus). Both
models are trained from labelled samples: the values of base spans are random
strings, other runs of eight or more such characters are ordinary if they are
words and short numbers between separators; the rest, where unknown secrets are,
trains neither. Counts
of character pairs cover all documents; they fill two tables of 68 x 68 cells,
so the size of what is sent to tasks is fixed.

Spans are code points of the whole match, end exclusive. Where a run overlaps
a base span, only the base span is given.

Defined cases: a null text is empty; an empty text has no spans and the digest
of the empty string; repeated rows give repeated result rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table, through_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Words, numbers of up to four digits and separators: what an ordinary identifier or path is made of.
_PART = r"(?:[A-Za-z][a-z]*(?:[A-Z][a-z]{2,})*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4})"
PLAIN = re.compile(rf"{_PART}(?:[+/_.=-]+{_PART})*[+/_.=-]*")
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
EDGE = len(ALPHABET)  # stands before the first and after the last character
SIZE = EDGE + 1
CODE = np.full(256, EDGE, np.uint8)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(EDGE)

MIN_LENGTH = 16
BACKOFF = 20
MIN_RATIO = float(np.log(1e6))
MIN_RATIO_PER_CHAR = 1.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, by start and then kind."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[re.Match]:
    """Runs that overlap no base span; base is ordered by start, so one sweep over both is enough."""
    at, reach = 0, 0  # reach: the farthest end of the base spans that start before the run ends
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            yield m


def pair_counts(strings: Iterable[str]) -> np.ndarray:
    """Counts of adjacent character pairs, string edges included."""
    codes = CODE[np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("ascii"), np.uint8)].astype(np.int32)
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def samples(base: list[tuple[int, int, int, str]], runs: list[str], out: tuple[list[str], list[str]]) -> None:
    """Add a text's labelled samples: values of base spans are random strings, other runs ordinary ones if they look like it."""
    out[0].extend(v for _, kind, _, v in base if kind or len(v) >= MIN_LENGTH)
    out[1].extend(filter(PLAIN.fullmatch, runs))


def cells(total: np.ndarray) -> pd.DataFrame:
    label, cell = np.nonzero(total)
    return pd.DataFrame({"label": label.astype(np.int32), "cell": cell.astype(np.int32), "n": total[label, cell]})


def count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        found: tuple[list[str], list[str]] = ([], [])
        for text in filter(None, batch["text"]):
            base = base_spans(text)
            samples(base, [m.group() for m in other_runs(text, base)], found)
        total += np.stack([*map(pair_counts, found)])
    yield cells(total)


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each character pair: random string against ordinary identifier."""
    return ratio_of(docs.select("text").mapInPandas(count_batches, "label int, cell int, n long"))


def ratio_of(counted: DataFrame) -> np.ndarray:
    rows = counted.groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()  # 2 x 68 x 68 cells at most
    counts = np.zeros((2, SIZE * SIZE))
    for label, cell, n in rows:
        counts[label, cell] = n
    counts = counts.reshape(2, SIZE, SIZE)
    single = counts.sum(1, keepdims=True) + 0.5
    single /= single.sum(2, keepdims=True)
    logs = np.log((counts + BACKOFF * single) / (counts.sum(2, keepdims=True) + BACKOFF))  # rare pairs by their second character
    ratio = logs[0] - logs[1]
    ratio[EDGE, EDGE] = 0
    return ratio


def log_ratio(run: str, ratio: np.ndarray) -> float:
    codes = CODE[np.frombuffer(f"\n{run}\n".encode("ascii"), np.uint8)].astype(np.intp)
    return float(ratio[codes[:-1], codes[1:]].sum())


def is_random(run: str, ratio: np.ndarray) -> bool:
    return log_ratio(run, ratio) > max(MIN_RATIO, MIN_RATIO_PER_CHAR * len(run))


def scan(text: str, ratio: np.ndarray) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int]]]:
    base = base_spans(text)
    return base, [m.span() for m in other_runs(text, base) if m.end() - m.start() >= MIN_LENGTH and is_random(m.group(), ratio)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, base string, runs string, label int, cell int, n long"


def find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two kinds of rows: of documents, with base spans and long other runs ("start:run", space between), and of pair counts."""
    total = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        rows, labelled = [], ([], [])
        for text in batch.pop("text"):
            base = base_spans(text or "")
            runs = [*other_runs(text or "", base)]
            samples(base, [m.group() for m in runs], labelled)
            kinds, named = [k for _, k, _, _ in base], joined([(s, KINDS[k], e) for s, k, e, _ in base])
            long_runs = " ".join(f"{m.start()}:{m.group()}" for m in runs if m.end() - m.start() >= MIN_LENGTH)
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(named.encode()).hexdigest(), named, long_runs))
        total += np.stack([*map(pair_counts, labelled)])
        found = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])
        yield pd.concat([batch.reset_index(drop=True), found], axis=1).assign(label=None, cell=None, n=None)
    counted = cells(total)
    yield counted.assign(**dict.fromkeys(("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs")))


def span_batches(ratio: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The spans of each row: base ones, and runs that the models call random."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for base, runs in zip(batch.pop("base"), batch.pop("runs"), strict=True):
                spans = [(int(s), KINDS.index(k), int(e), k) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                for at, text in (x.split(":", 1) for x in runs.split(" ") if x):
                    if is_random(text, ratio):
                        spans.append((int(at), len(KINDS), int(at) + len(text), "markov"))
                out.append(joined([(s, name, e) for s, _, e, name in sorted(spans)]))
            yield batch.assign(spans=out)

    return run


def find_secrets(docs: DataFrame, model_docs: DataFrame | None = None) -> DataFrame:
    """doc_id with span counts, the digest of the base spans and all spans; the models are trained on model_docs or docs.

    The patterns run once over every text; what they find is written and scored when the models are there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = through_table(docs.select("doc_id", "text").mapInPandas(find_batches, f"doc_id {kind}, {FOUND}"), "secrets")
    ratio = ratio_of(found.where("label IS NOT NULL").select("label", "cell", "n")) if model_docs is None else train(model_docs)
    rows = found.where("label IS NULL").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs")
    return rows.mapInPandas(span_batches(ratio), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_batches(ratio: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, more = scan(text, ratio)
        out, at = [], 0
        for start, end in sorted([(s, e) for s, _, e, _ in base] + more):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = batch["text"].map(clean)
            yield batch

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with every span of the text replaced by [SECRET]; columns and order of columns stay.

    n_chars, if there is one, is that of the new text; rows with a null text keep theirs.
    """
    ratio = train(docs)
    cleaned = docs.mapInPandas(redact_batches(ratio), docs.schema)
    if "n_chars" in docs.columns:
        n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n)
    return cleaned


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
