"""Vectors as exact integers, for the operators that compress and cluster them.

Only rows whose vector has the asked length and finite components of a bounded size are whole: beyond the bound, squared
integer distances would not fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str, limit: float) -> Column:
    """Whether a vector is there and all its components are and lie below the limit in size (which NaN never does)."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < limit)), F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The length most vectors have, the greater of equally frequent ones; 0 without vectors."""
    sizes = df.groupBy(F.size(vector).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    return sizes["k"] if sizes else 0


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector; exact, as a power of two scales doubles exactly."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)


def sums_by(slot: np.ndarray, rows: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and componentwise sums, of the rows of every slot."""
    order = np.argsort(slot, kind="stable")
    count = np.bincount(slot, minlength=slots)
    sums = np.zeros((slots, rows.shape[1]), np.int64)
    full = np.flatnonzero(count)
    if len(full):
        sums[full] = np.add.reduceat(rows[order], (np.cumsum(count) - count)[full], axis=0)
    return count, sums


def totals(partial: DataFrame, width: int, extra: tuple[str, ...] = ()) -> dict[int, tuple]:
    """slot -> (n, *extra, sums) over all tasks as Python integers; rows are (slot, n, *extra, sums), one a slot and task."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    out = partial.groupBy("slot").agg(*[wide(F.col(c)).alias(c) for c in ("n", *extra)], *[wide(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    return {r["slot"]: (*(int(r[c]) for c in ("n", *extra)), [int(r[f"s{i}"]) for i in range(width)]) for r in out.collect()}
