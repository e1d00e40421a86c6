"""Centroid clustering with a vantage-point tree over the centroids (operator 12).

A component x becomes floor(64 * x). In each round the driver builds a tree over the centroids (their number is a
parameter) and broadcasts it. A node holds a vantage centroid and two children with the least and greatest distance of
their centroids from it; a leaf holds a few centroids. Every vector searches best-first: it opens the node with the
least lower bound until that bound lies beyond its radius, the distance of the best centroid so far. A bound equal to
the radius is still opened (and the radius is widened by a hair more than doubles err), so that a centroid as near
with a smaller number is never missed; distances to centroids are exact integers. Vectors of a batch search at the same
time, each with its own bounds.

A task returns one row a cluster with count, inertia and sums, Spark adds them, and only those rows reach the driver.
Nothing is cached; copies of a vector never meet.

Defined cases: rows whose vector is null, has another length, or a null or non-finite component are left out, and so are,
as their distances would not fit a long, vectors with a component of 2^21 or more in size. Repeated ids are rows of
their own, and tie by their vectors; null ids start last. With fewer vectors than centroids all start as centroids; an
empty table gives an empty result. An inertia beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table
from .vectors import finite, integers, sums_by, totals

DIM = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LIMIT = 2.0**21  # integers below 2^27: distances over 64 components below 2^62
LEAF = 2
SLACK = 1e-9  # relative; square roots and differences of doubles err by less
CELLS = 1 << 22  # bounds held at once


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Tree:
    """Nodes in lists; a leaf has members, an inner node a vantage centroid and (child, least, greatest distance) twice."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[tuple] = field(default_factory=list)
    members: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self._add(list(range(len(self.centroids))))

    def _add(self, ids: list[int]) -> int:
        node = len(self.vantage)
        self.vantage.append(ids[0])
        self.children.append(())
        self.members.append(ids if len(ids) <= LEAF else ids[:1])
        if len(ids) > LEAF:
            rest = ids[1:]
            d = squares(self.centroids[rest], self.centroids[ids[0]])
            order = np.argsort(d, kind="stable")
            half = (len(rest) + 1) // 2
            kids = []
            for part in (order[:half], order[half:]):
                if len(part):
                    far = np.sqrt(d[part].astype(np.float64))
                    kids.append((self._add([rest[i] for i in part]), far.min(), far.max()))
            self.children[node] = tuple(kids)
        return node

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) nearest to every row, the smaller number of equals."""
        step = max(1, CELLS // len(self.vantage))
        found = [self._search(x[i : i + step]) for i in range(0, len(x), step)]
        return tuple(np.concatenate(p) if found else np.zeros(0, np.int64) for p in (zip(*found, strict=True) if found else ((), ())))

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.full((len(x), len(self.vantage)), np.inf)
        bounds[:, 0] = 0.0
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.centroids), np.int64)
        radius = np.full(len(x), np.inf)
        rows = np.arange(len(x))
        while len(rows):
            node = bounds[rows].argmin(1)
            bound = bounds[rows, node]
            going = (bound <= radius[rows]) & np.isfinite(bound)
            rows, node, bound = rows[going], node[going], bound[going]
            bounds[rows, node] = np.inf
            for j in np.unique(node):
                at = rows[node == j]
                self._open(j, x, at, bound[node == j], bounds, best, number)
            radius[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK) + SLACK
        return number, best

    def _open(self, j: int, x, at, bound, bounds, best, number) -> None:
        for c in self.members[j]:
            d = squares(x[at], self.centroids[c])
            if c == self.vantage[j]:
                far = np.sqrt(d.astype(np.float64))
            better = (d < best[at]) | (d == best[at]) & (c < number[at])
            best[at[better]], number[at[better]] = d[better], c
        for child, near_edge, far_edge in self.children[j]:
            low = np.maximum(near_edge - far, far - far_edge) - SLACK * (far + far_edge)
            bounds[at, child] = np.maximum(bound, np.maximum(low, 0.0))


def sum_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        k, dim = tree.centroids.shape
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim, SCALE)
            number, d = tree.search(x)
            n, s = sums_by(number, x, k)
            count += n
            sums += s
            for c in np.flatnonzero(n):
                inertia[c] += sum(map(int, d[number == c])) if len(d) and int(d.max()) * len(d) >= 2**62 else int(d[number == c].sum())
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int32()), "n": count[used], "inertia": pa.array([str(v) for v in inertia[used]], pa.string()), "sums": pa.array(list(sums[used]), pa.list_(pa.int64()))})

    return run


def number_batches(shared, inertia: dict[int, int], vector: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in tree.centroids.tolist()]
        for batch in batches:
            number, d = tree.search(integers(batch.column(vector), tree.centroids.shape[1], SCALE))
            own = number.tolist()
            kept = [c for c in batch.schema.names if c != vector]
            columns = [pa.array(number, pa.int32()), pa.array(d, pa.int64()), pa.array([inertia[c] for c in own], pa.int64()), pa.array([digests[c] for c in own], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, "cluster", "distance", "cluster_inertia", "centroid_sha256"])

    return run


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector, and the final centroids."""
    spark = vectors.sparkSession
    whole = vectors.where(finite(vector, LIMIT) & (F.size(vector) == dim)).select(key, vector)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    first = [r[0] for r in whole.orderBy(order.asc_nulls_last(), vector).select(vector).limit(centroids).collect()]  # the first centroids
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, centroid_sha256 string"
    place = np.floor(np.array(first, np.float64).reshape(-1, dim) * SCALE).astype(np.int64)
    if not first:
        return spark.createDataFrame([], f"{schema}, inertia long"), place
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Tree(place.copy()))
        sums = totals(whole.select(vector).mapInArrow(sum_batches(shared), "slot int, n long, inertia string, sums array<long>"), dim, ("inertia",))
        if r < rounds:
            for c, (n, _, s) in sums.items():
                place[c] = [v // n for v in s]
            shared.unpersist()
    fits = lambda v: v if v < 2**63 else None
    inertia = {c: fits(v) for c, (_, v, _) in sums.items()}
    rows = whole.mapInArrow(number_batches(shared, inertia, vector), schema)
    return rows.withColumn("inertia", F.lit(fits(sum(v for _, v, _ in sums.values()))).cast("long")), place


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = cluster(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same rows by unrolled rounds that compare every vector with every centroid."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= {LIMIT})) = 0)""",
        f"c0 AS MATERIALIZED (SELECT rid - 1 AS c, v FROM k WHERE rid <= {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min({{'d': {square}, 'c': c.c}}) AS best FROM k, c{r} c GROUP BY rid)")
        if r < ROUNDS:
            sums = f"SELECT a.best.c AS c, i, sum(k.v[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN k USING (rid), range(1, {DIM} + 1) AS g(i) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM ({sums}) GROUP BY c) m ON m.c = c.c)")
    return f"""WITH {", ".join(steps)} SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN k USING (rid) JOIN c{ROUNDS} c ON c.c = a.best.c"""
