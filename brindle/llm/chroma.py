"""Media columns: chroma audio fingerprints (operator 3).

Sound is cut into overlapping frames, each frame's power spectrum is folded to
twelve pitch classes, and sixteen box filters over the frames x pitch classes
image, evaluated on its integral image, are quantised to two bits each: one
packed 32-bit integer a frame. Recordings are aligned by a histogram over frame
offsets in which every bit of every frame that overlaps has a vote; the offset with
the least share of differing bits is the alignment, and a pair is a match up to
``MAX_BIT_ERROR`` there. At that share no key of some bits is safe to be equal, so
blocks of query classes meet blocks of classes, which is work in proportion to
queries x classes. Matrix products over the frequencies of a Fourier transform give
an upper bound of the equal bits of a pair at every offset; the pairs that it does
not rule out are compared bit by bit. ``votes`` are the frames of the overlap whose
leading bits are equal.

Recordings with equal fingerprints are one class. A search takes query classes
against all classes; result rows are of two kinds, "member" (id_a is a recording,
id_b the least id of its class) and "match" (id_a and id_b are the least ids of a
query class and of a matching class), so copies are never expanded into pairs.

The test tables hold no audio, so the query derives recordings from the whole
table ``embeddings``: a value v of a vector of d values is a note, of the pitch
class floor(12 logistic(1.702 v sqrt(d))), so that all twelve are about as frequent
and tunes of unlike vectors are unlike. A frame of such a sound holds two notes, so
its power is read from a table of pairs of notes, by the phase it begins at, and no
sound is made. Query rows are those whose id is divisible by 50.

Defined cases: null or short sound has no fingerprint, is a class of its own and
matches nothing; null values of a vector are silence; repeated rows share a
class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table, through_table

RATE, FRAME, HOP = 5512, 1024, 512
LOW, HIGH = 60.0, 2700.0
WIDTH = 8  # frames under one filter
KEY_BITS = 20
MAX_BIT_ERROR = 0.3
MIN_OVERLAP = 0.5
BLOCK = 1 << 16  # codes in a block, or one longer recording
LONG = 512  # pairs with more codes have no bound before the comparison
CELLS = 1 << 15  # notes, or frequencies of classes, in memory at once
QUERIES = 128  # in memory with them
SHARE = 0.88  # of the bits, to which the bound is true
A4 = 440.0


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, frames): four shapes at four places and two sizes, by rule."""
    return [(shape, 3 * place, 4 + 2 * (shape % 2), WIDTH if place % 2 == 0 else WIDTH // 2) for shape in range(4) for place in range(4)]


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x 12 pitch classes of a sound at RATE, each frame scaled to length one (silence stays zero)."""
    n = 1 + (len(pcm) - FRAME) // HOP
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[:: HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= LOW) & (hz <= HIGH)
    pitch = np.round(12 * np.log2(hz[use] / A4)).astype(int) % 12
    out = power[:, use] @ np.eye(12)[pitch]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-2, out / np.maximum(norm, 1e-12), 0.0)


def codes(image: np.ndarray) -> np.ndarray:
    """A packed integer for every frame that has WIDTH frames from it on, of one image or of each of many of one length."""
    many, frames = image.shape[:-2], image.shape[-2]
    n = frames - WIDTH + 1
    if n <= 0:
        return np.zeros((*many, 0), np.int64)
    wide = np.concatenate([image, image], -1)  # pitch classes go round
    sums = np.zeros((25, *many, frames + 1))
    sums[1:, ..., 1:] = np.moveaxis(wide.cumsum(-2).cumsum(-1), -1, 0)
    box = lambda t0, t1, p0, p1: sums[p1][..., t1 : t1 + n] - sums[p1][..., t0 : t0 + n] - sums[p0][..., t1 : t1 + n] + sums[p0][..., t0 : t0 + n]
    out = np.zeros((*many, n), np.int64)
    for shape, p, h, w in filters():
        whole = box(0, w, p, p + h)
        if shape == 0:
            part = box(0, w, p, p + h // 2)
        elif shape == 1:
            part = box(0, w // 2, p, p + h)
        elif shape == 2:
            part = box(0, w // 2, p, p + h // 2) + box(w // 2, w, p + h // 2, p + h)
        else:
            part = box(w // 4, w - w // 4, p, p + h)
        value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        level = (value >= -0.25).astype(np.int64) + (value >= 0) + (value >= 0.25)
        out = out << 2 | level ^ level >> 1  # Gray code: neighbouring levels differ in one bit
    return out


def synthesize(notes: np.ndarray) -> np.ndarray:
    """Sound of a row of pitch classes (-1 is silence), HOP samples a note."""
    hz = np.where(notes < 0, 0.0, A4 * 2 ** (notes / 12))
    step = np.repeat(2 * np.pi * hz / RATE, HOP)
    return np.where(np.repeat(notes >= 0, HOP), np.sin(np.cumsum(step)), 0.0)


@functools.cache
def note_pairs() -> np.ndarray:
    """13 x 13 x 3 x 12: of a frame of two notes (12 is silence), the parts of the pitch classes' power by 1, cos 2f and sin 2f, f the phase at its start."""
    pace = 2 * np.pi * A4 * 2 ** (np.arange(12) / 12) / RATE
    wave = np.zeros((13, HOP), complex)
    wave[:12] = np.exp(1j * pace[:, None] * np.arange(1, HOP + 1))
    turned = np.exp(1j * HOP * np.append(pace, 0))  # the second note begins where the first has ended
    frames = np.concatenate([np.broadcast_to(wave[:, None], (13, 13, HOP)), turned[:, None, None] * wave], 2) * np.hanning(FRAME)
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= LOW) & (hz <= HIGH)
    fold = np.eye(12)[np.round(12 * np.log2(hz[use] / A4)).astype(int) % 12]
    sine, cosine = np.fft.rfft(frames.real)[..., use], np.fft.rfft(frames.imag)[..., use]  # weights sin f and cos f in the spectrum
    a, b, both = np.abs(sine) ** 2 @ fold, np.abs(cosine) ** 2 @ fold, (sine * cosine.conj()).real @ fold
    return np.stack([(a + b) / 2, (b - a) / 2, both], 2)


def chroma_of_notes(notes: np.ndarray) -> np.ndarray:
    """``chroma(synthesize(...))`` of every row of notes."""
    notes = np.where(notes < 0, 12, notes).astype(np.int64)
    pace = np.append(2 * np.pi * A4 * 2 ** (np.arange(12) / 12) / RATE, 0) * HOP
    twice = 2 * (np.cumsum(pace[notes], 1) - pace[notes])[:, :-1, None]
    parts = note_pairs()[notes[:, :-1], notes[:, 1:]]
    out = parts[:, :, 0] + np.cos(twice) * parts[:, :, 1] + np.sin(twice) * parts[:, :, 2]
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    return np.where(norm > 1e-2, out / np.maximum(norm, 1e-12), 0.0)


def print_rows(ids, found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "codes": [x.astype("<u4").tobytes() for x in found], "digest": [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in found]})


def pcm_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield print_rows(batch["id"], [codes(chroma(np.frombuffer(x, "<i2") / 32768)) if x is not None else np.zeros(0, np.int64) for x in batch["pcm"]])


def vector_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        vectors = [np.array([] if v is None else v, np.float64) for v in batch["v"]]
        size, found = np.array([len(v) for v in vectors]), [np.zeros(0, np.int64)] * len(vectors)
        for n in np.unique(size[size > WIDTH]):  # fewer notes make no code
            at = np.flatnonzero(size == n)
            for some in np.array_split(at, -(-len(at) * n // CELLS)):
                v = np.stack([vectors[i] for i in some])
                share = 1 / (1 + np.exp(np.clip(-1.702 * np.nan_to_num(v) * n**0.5, -500, 500)))  # of a normal distribution
                for i, x in zip(some, codes(chroma_of_notes(np.where(np.isnan(v), -1, np.clip(np.floor(12 * share), 0, 11)))), strict=True):
                    found[i] = x
        yield print_rows(batch["id"], found)


def fingerprints(recordings: DataFrame, make: Callable = pcm_batches) -> DataFrame:
    """(id, codes, digest) of rows (id, pcm): mono little-endian 16-bit sound at RATE; codes are four bytes each, the lowest first."""
    kind = recordings.schema["id"].dataType.simpleString()
    return recordings.mapInPandas(make, f"id {kind}, codes binary, digest binary")


def block_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (class, codes) packed into blocks of about BLOCK codes."""
    for batch in batches:
        size = batch["codes"].str.len().to_numpy(np.int64) // 4
        for _, part in batch.groupby((np.cumsum(size) - size) // BLOCK):
            yield pd.DataFrame({"ids": [part["class"].to_list()], "sizes": [size[part.index - batch.index[0]].tolist()], "codes": [b"".join(part["codes"])]})


def alignments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least share of differing bits over all offsets of code x, or of each column of x, with the column of y, and the (nearest, then greatest) offset."""
    x = x.reshape(len(x), -1)
    m, size = len(x), len(y)
    least, error, offset = MIN_OVERLAP * min(m, size), np.full(y.shape[1], np.inf), np.zeros(y.shape[1], np.int64)
    for off in sorted(range(1 - size, m), key=lambda d: (abs(d), -d)):
        at, start = max(off, 0), max(-off, 0)
        n = min(m - at, size - start)
        if n >= least:
            e = np.bitwise_count(x[at : at + n] ^ y[start : start + n]).sum(0, np.int32) / (32 * n)
            better = e < error
            error[better], offset[better] = e[better], off
    return error, offset


@functools.lru_cache(64)
def plan(m: int, n: int) -> tuple[np.ndarray, ...]:
    """For the offsets of m codes with n: transforms of both into frequencies, and those back to sums and differences of
    the offsets as far to the right as to the left of the middle one, of which the overlaps are equal; the overlaps."""
    least = math.ceil(MIN_OVERLAP * min(m, n))
    period, middle = m + n - least, (m - n) / 2  # offsets a period apart have no overlap
    f = np.arange(period // 2 + 1)
    turn = lambda t: np.exp(-2j * np.pi / period * f[:, None] * t)
    into = lambda t: np.concatenate([turn(t).real, turn(t).imag]).astype(np.float32)
    aside = np.arange((m + n) % 2 / 2, (m + n) / 2 - least + 0.25)
    back = (turn(aside) * np.where((f == 0) | (2 * f == period), 1, 2)[:, None] / period).T
    overlap = np.minimum(m, middle + aside + n) - np.maximum(middle + aside, 0)
    return into(np.arange(m)), into(np.arange(n) + middle), back.real.astype(np.float32), back.imag.astype(np.float32), overlap


def signs(x: np.ndarray) -> np.ndarray:
    """32 bits x codes x columns, as 1 and -1."""
    return (x >> np.arange(32, dtype="<u4")[:, None, None] & 1).astype(np.float32) * 2 - 1


def main_axes(x: np.ndarray) -> np.ndarray:
    """Axes in the space of 32 bits, as many as hold SHARE of the squares of these codes; any would do for a true bound."""
    bits = signs(x).reshape(32, -1)
    square, axes = np.linalg.eigh((bits @ bits.T).astype(np.float64) / x.size)
    return axes[:, ::-1].T[: np.searchsorted(np.cumsum(square[::-1]), 32 * SHARE) + 1].astype(np.float32)


def spectra(x: np.ndarray, axes: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Frequencies x (real, imaginary) parts of the bits along the axes, and of the length of the rest, x columns of x."""
    along = np.tensordot(axes, signs(x), 1)
    rest = np.sqrt(np.maximum(32 - np.square(along).sum(0, keepdims=True), 0) + 1e-3)
    bins = len(into) // 2
    return np.matmul(into, np.concatenate([along, rest])).reshape(len(axes) + 1, 2, bins, -1).transpose(2, 1, 0, 3).reshape(bins, 2 * len(axes) + 2, -1)


def near_pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of x and of y that may match: no pair is missing that ``alignments`` puts at MAX_BIT_ERROR or less.

    Equal less differing bits of an overlap are the product of its bits as signs. That is at most the product along some
    axes and of the lengths of the rest, and one correlation of sequences for all offsets; float32 is off by less than 1.
    """
    into_x, into_y, even, odd, overlap = plan(len(x), len(y))
    axes, (far, bins) = main_axes(y), even.shape
    enough, step = (32 * overlap * (1 - 2 * MAX_BIT_ERROR) - 1).astype(np.float32)[:, None], max(1, CELLS // bins)
    most = min(step, y.shape[1]) * min(QUERIES, x.shape[1])
    room = [np.empty(rows * most, np.float32) for rows in (2 * bins, far, far)]  # new memory for each product would take as long as it
    for start in range(0, y.shape[1], step):
        of_y = spectra(y[:, start : start + step], axes, into_y)
        for first in range(0, x.shape[1], QUERIES):
            re = spectra(x[:, first : first + QUERIES], axes, into_x).transpose(0, 2, 1)
            im = np.concatenate([re[..., len(axes) + 1 :], -re[..., : len(axes) + 1]], 2)
            k, n = re.shape[1], of_y.shape[2]
            products, sums, differences = (a[: rows * k * n].reshape(rows, -1) for a, rows in zip(room, (2 * bins, far, far), strict=True))
            products = np.matmul(np.concatenate([re, im], 1), of_y, out=products.reshape(bins, 2 * k, n))
            np.matmul(even, products[:, :k].reshape(bins, -1), out=sums)
            np.matmul(odd, products[:, k:].reshape(bins, -1), out=differences)
            np.add(sums, np.abs(differences, out=differences), out=sums)
            near = np.flatnonzero((sums >= enough).any(0))
            yield first + near // n, start + near % n


def compared(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of x and of y, with the error and the offset of ``alignments``: all that match, and some others."""
    if len(x) + len(y) <= LONG:
        for i, j in near_pairs(x, y):
            yield i, j, *alignments(x[:, i], y[:, j])
    else:
        for q in range(x.shape[1]):
            yield np.full(y.shape[1], q), np.arange(y.shape[1]), *alignments(x[:, q], y)


def votes(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Frames of the overlap whose leading bits are equal, of columns i of x and j of y at their offset."""
    at, start, t = np.maximum(offset, 0), np.maximum(-offset, 0), np.arange(min(len(x), len(y)))[:, None]
    differ = x[np.minimum(at + t, len(x) - 1), i] ^ y[np.minimum(start + t, len(y) - 1), j]
    return ((t < np.minimum(len(x) - at, len(y) - start)) & (differ >> (32 - KEY_BITS) == 0)).sum(0)


def by_size(sizes: np.ndarray, codes: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the recordings of each size, and their codes, a column each."""
    found = np.split(np.frombuffer(codes, "<u4"), np.cumsum(sizes)[:-1])
    return [(at := np.flatnonzero(sizes == n), np.stack([found[i] for i in at], 1)) for n in np.unique(sizes)]


def match_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches of the query classes of a block with the classes of another."""
    for batch in batches:
        for block, rows in batch.groupby("codes", sort=False):  # one block of classes with all that is asked in the batch
            ids, q_ids = np.array(rows["ids"].iloc[0]), np.concatenate(rows["q_ids"].to_list())
            asked = by_size(np.concatenate(rows["q_sizes"].to_list()), b"".join(rows["q_codes"]))
            for at, y in by_size(np.array(rows["sizes"].iloc[0]), block):
                for of, x in asked:
                    for found in compared(x, y):
                        i, j, error, offset = (v[(found[2] <= MAX_BIT_ERROR) & (q_ids[of[found[0]]] != ids[at[found[1]]])] for v in found)
                        if len(i):
                            yield pd.DataFrame({"id_a": q_ids[of[i]], "id_b": ids[at[j]], "offset": offset, "votes": votes(x, y, i, j, offset), "bit_error": error})


def search(prints: DataFrame, is_query) -> DataFrame:
    """Membership of every recording and matches of query classes with all classes."""
    prints = through_table(prints, "prints")
    kind = prints.schema["id"].dataType.simpleString()
    heard, least = prints.where("digest IS NOT NULL"), F.min("id").alias("class")
    names = heard.groupBy("digest").agg(least)
    member = prints.join(names, "digest", "left").select(F.col("id").alias("id_a"), F.coalesce("class", "id").alias("id_b"))
    blocks = lambda rows: rows.select("class", "codes").mapInPandas(block_batches, f"ids array<{kind}>, sizes array<int>, codes binary")
    asked = heard.where(is_query).groupBy("digest").agg(F.first("codes").alias("codes")).join(names, "digest")
    asked = through_table(blocks(asked).select(F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("codes").alias("q_codes")), "asked")
    pairs = blocks(heard.groupBy("digest").agg(least, F.first("codes").alias("codes"))).crossJoin(asked)  # blocks, not rows
    match = pairs.mapInPandas(match_batches, f"id_a {kind}, id_b {kind}, offset int, votes long, bit_error double")
    return member.select(F.lit("member").alias("kind"), "id_a", "id_b", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("long").alias("votes"), F.lit(None).cast("double").alias("bit_error")).unionByName(
        match.select(F.lit("match").alias("kind"), "id_a", "id_b", "offset", "votes", "bit_error")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(fingerprints(rows, vector_batches), F.col("id") % 50 == 0)
