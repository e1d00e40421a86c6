"""Vectorised 64-bit hashes of words and word windows, equal in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
STEP = U(0x9E3779B97F4A7C15)
STEP_BACK = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
CHUNK_BYTES = 1 << 20

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, way: str = "up") -> np.ndarray:
    """The first n powers of STEP, or of its inverse."""
    have = _powers[way]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), STEP if way == "up" else STEP_BACK, np.uint64)
        base[0] = 1
        have = _powers[way] = np.multiply.accumulate(base)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(first text, texts, their bytes joined by line feeds) of about ``most`` bytes; a longer text is a chunk of its own."""
    at, first, held = 0, [], 0
    for k, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if first and held + len(data) > most:
            yield at, len(first), b"\n".join(first)
            at, first, held = k, [], 0
        first.append(data)
        held += len(data) + 1
    if first:
        yield at, len(first), b"\n".join(first)


def word_hashes(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of n texts joined by line feeds, with the number of the text that each stands in."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    gap = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * powers(len(raw)), dtype=np.uint64)])
    h = mixed((sums[end] - sums[start]) * powers(len(raw) + 1, "down")[start])
    return h, start


def text_of(data: bytes, lengths: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The number of the text in which each byte position lies."""
    ends = np.cumsum(lengths + 1)
    return np.searchsorted(ends, start, "right")


def hashed_words(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, word hashes, words of each text) by chunks."""
    for at, n, data in chunks(texts, most):
        lengths = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts[at : at + n]], np.int64)
        h, start = word_hashes(data, n)
        count = np.bincount(text_of(data, lengths, start), minlength=n) if len(h) else np.zeros(n, np.int64)
        yield at, n, h, count


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of so many words; windows may cross texts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * STEP + h[j : j + n]
    return mixed(out)
