"""Vector code compression by product quantisation in exact integers (operator 11).

A component x becomes floor(4096 * x); a vector is cut into ``PARTS`` equal parts, and every part position has a codebook
of ``ENTRIES`` entries. Squared distances to all entries come from dot products: integers are split into limbs of
``LIMB`` bits, the products of limbs go through one float64 matrix product (every sum of them stays below 2^53, so it is
exact), and the limbs are put together in 64-bit integers. The first least distance names the entry.

A round is one pass over the vectors: a task returns one row a part and entry with its count and sums, Spark adds them,
and only the new codebooks (parts x entries rows, a parameter) reach the driver. Nothing is cached, so a lost executor
costs its tasks only; copies of a vector never meet.

Defined cases: rows whose vector is null or has a null or non-finite component are left out, and so are, as their
distances would not fit a long, vectors with a component of 2^15 or more in size, and vectors of another length than the
usual one (the most frequent, which must be a multiple of the parts; else nothing is kept). Repeated ids are rows of
their own, and tie by their vectors; null ids count as the greatest. With fewer vectors than entries the codebooks are
shorter; an empty table gives an empty result. A null label is a label; a label's error beyond a long is null. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table
from .vectors import finite, integers, sums_by, totals, usual_length

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 2.0**15  # integers below 2^27: two limbs, distances below 2^62
LIMB = 14
HEX = np.array([f"{i:02x}" for i in range(256)], "S2")


def limbs(a: np.ndarray) -> np.ndarray:
    """Low and high limbs stacked, as doubles; the high one carries the sign."""
    return np.concatenate([a & ((1 << LIMB) - 1), a >> LIMB]).astype(np.float64)


def exact_dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T in int64 for integers below 2^27 in size and at most 2^24 columns."""
    n, m = len(x), len(c)
    both = (limbs(x) @ limbs(c).T).astype(np.int64)  # all four products of limbs at once
    low, cross, high = both[:n, :m], both[:n, m:] + both[n:, :m], both[n:, m:]
    return low + (cross << LIMB) + (high << (2 * LIMB))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the first nearest entry to every row."""
    d = (x * x).sum(1)[:, None] - 2 * exact_dot(x, c) + (c * c).sum(1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def sum_batches(codebooks: np.ndarray, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim, SCALE).reshape(-1, parts, width)
            for p in range(parts):
                n, s = sums_by(nearest(x[:, p], codebooks[p])[0], x[:, p], entries)
                count[p] += n
                sums[p] += s
        used = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": count.ravel()[used], "sums": pa.array(list(sums.reshape(-1, width)[used]), pa.list_(pa.int64()))})

    return run


def code_batches(codebooks: np.ndarray, dim: int, vector: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = codebooks.shape
        for batch in batches:
            x = integers(batch.column(vector), dim, SCALE).reshape(-1, parts, width)
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest(x[:, p], codebooks[p])
                error += d
            text = HEX[codes].view(f"S{2 * parts}").ravel().astype(str) if len(x) else []
            kept = [c for c in batch.schema.names if c != vector]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(text, pa.string()), pa.array(error)], [*kept, "code", "error"])

    return run


def train(rows: DataFrame, vector: str, dim: int, first: list, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after so many rounds, from the given vectors as first entries."""
    x = np.floor(np.array(first, np.float64) * SCALE).astype(np.int64)
    codebooks = x.reshape(len(x), PARTS, dim // PARTS).swapaxes(0, 1).copy()
    for _ in range(rounds):
        found = totals(rows.select(vector).mapInArrow(sum_batches(codebooks, dim), "slot int, n long, sums array<long>"), dim // PARTS)
        for slot, (n, sums) in found.items():
            codebooks[divmod(slot, len(x))] = [s // n for s in sums]
    return codebooks


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error, label_error) of every whole vector, and the codebooks (part, entry, place)."""
    whole = vectors.where(finite(vector, LIMIT))
    dim = usual_length(whole, vector)
    kind = lambda c: vectors.schema[c].dataType.simpleString()
    schema = f"{key} {kind(key)}, {label} {kind(label)}, code string, error long"
    if dim == 0 or dim % PARTS:
        none = vectors.sparkSession.createDataFrame([], f"{schema}, label_error long")
        return none, np.zeros((PARTS, 0, 0), np.int64)
    whole = whole.where(F.size(vector) == dim)
    first = [r[0] for r in whole.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(ENTRIES).collect()]  # the first entries
    codebooks = train(whole, vector, dim, first, rounds)
    coded = whole.select(key, label, vector).mapInArrow(code_batches(codebooks, dim, vector), schema)
    by_label = coded.groupBy(F.col(label).alias("_l")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(by_label, F.col(label).eqNullSafe(F.col("_l")))  # summed before; by its measured size broadcast, or merged with hot labels split
    return out.select(key, label, "code", "error", "label_error"), codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rows by unrolled rounds over parts."""
    square = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    floor = "(((s - ((s % n) + n) % n)) // n)::BIGINT"
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= {LIMIT})) = 0)""",
        f"p AS MATERIALIZED (SELECT rid, j AS part, v[j * (len(v) // {PARTS}) + 1 : (j + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) AS g(j))",
        f"c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p.part, min({{'d': {square}, 'entry': c.entry}}) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY ALL)")
        if r < ROUNDS:
            sums = f"SELECT a.part, a.best.entry AS entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN p ON p.rid = a.rid AND p.part = a.part, range(1, 9) AS g(i) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT part, entry, list({floor} ORDER BY i) AS x FROM ({sums}) GROUP BY ALL) m ON m.part = c.part AND m.entry = c.entry)")
    last = f"(SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)"
    book = f"(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {book} AS codebooks_sha256 FROM {last} JOIN k USING (rid)"
