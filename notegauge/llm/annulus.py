"""k-means in whole numbers, with the nearest centroid found by annulus search.

By the triangle inequality a centroid at most as far from a vector as d has a norm
within d of the vector's norm. The centroids are sorted by norm; the one whose norm is
nearest gives a first bound, a binary search the others in the annulus of that bound,
and those are compared exactly, the bound falling with every better one. Norms are
rounded to whole numbers and the annulus is widened by what rounding can hide, so ties
on its boundary are compared too.

Every round is one pass over the vectors. A task adds up its vectors per centroid and
returns a few numbers per centroid and component; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegauge.llm.common import checkpointed
from notegauge.runtime import ship

DIM, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Components below this, by absolute value, are summed and squared in 64 bits; larger ones as Python's whole numbers.
SMALL = 1 << 27
#: Norms and distances are rounded down, each by less than 1 and, from doubles, by one more; the annulus is wider by this.
SLACK = 4
#: Sums travel in digits of this base, which add up in 64 bits over some millions of tasks.
BASE = 40


def whole(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows of a column of lists that have exactly ``dim`` numbers, none null or non-finite."""
    start, length = column.offsets.to_numpy()[:-1], np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((length == dim) & ~np.asarray(column.is_null()))
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)  # a null is NaN
    values = flat[start[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def integers(values: np.ndarray, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(places, floor(scale * values))]: rows of small numbers in 64 bits, and the others exactly in Python's whole numbers."""
    small = (np.abs(values) < SMALL / scale - 1).all(axis=1)
    found = [(np.flatnonzero(small), np.floor(values[small] * scale).astype(np.int64))]
    if not small.all():
        exact = [[math.floor(scale * x) if abs(x) < 2.0**900 else int(x) * scale for x in row] for row in values[~small].tolist()]
        found.append((np.flatnonzero(~small), np.array(exact, object)))
    return [(at, x) for at, x in found if len(at)]


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded down but for an error of one."""
    return np.array([math.isqrt(s) for s in squares.tolist()], object) if squares.dtype == object else np.sqrt(squares.astype(float)).astype(np.int64)


class Centroids:
    """Centroids in order of their norms."""

    def __init__(self, rows: list[list[int]]):
        large = max((abs(x) for r in rows for x in r), default=0) >= SMALL
        self.rows = np.array(rows, object if large else np.int64)
        norms = _root((self.rows * self.rows).sum(axis=1))
        self.order = np.array(sorted(range(len(rows)), key=lambda j: (norms[j], j)))
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of ``x``; of equally near ones the smallest number."""
        if self.rows.dtype == object:
            x = x.astype(object)
        squared = lambda rows, j: (lambda d: (d * d).sum(axis=1))(x[rows] - self.rows[j])
        norm, k = _root((x * x).sum(axis=1)), len(self.order)
        right = np.clip(np.searchsorted(self.norms, norm), 1, k - 1) if k > 1 else np.zeros(len(x), np.int64)
        first = np.where(norm - self.norms[right - 1] <= self.norms[right] - norm, right - 1, right) if k > 1 else right
        best, number = np.zeros(len(x), x.dtype), self.order[first]
        for j in np.unique(first):
            at = np.flatnonzero(first == j)
            best[at] = squared(at, self.order[j])
        reach = _root(best) + SLACK
        low, high = np.searchsorted(self.norms, norm - reach), np.searchsorted(self.norms, norm + reach, "right")
        for j in range(int(low.min(initial=k)), int(high.max(initial=0))):
            # the bound has fallen since the binary search where a nearer centroid was found
            at = np.flatnonzero((low <= j) & (j < high) & (first != j) & (np.abs(norm - self.norms[j]) <= reach))
            if not len(at):
                continue
            d, c = squared(at, self.order[j]), self.order[j]
            nearer = (d < best[at]) | ((d == best[at]) & (c < number[at]))
            at, d = at[nearer], d[nearer]
            best[at], number[at], reach[at] = d, c, _root(d) + SLACK
        return number, best


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if rest & ((1 << BASE) - 1):
            yield place, sign * (rest & ((1 << BASE) - 1))
        rest, place = rest >> BASE, place + 1


def _mapped(vectors: DataFrame, each: Callable[[Iterator[tuple[pa.Array, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``each`` gets, per task, (vec_ids, whole-number vectors) of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for b in batches:
                rows, values = whole(b.column(1))
                for at, x in integers(values):
                    yield b.column(0).take(pa.array(rows[at])), x

        yield from each(kept())

    return vectors.mapInArrow(run, schema)


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors whose vec_id has the smallest hash; of rows with one vec_id the smaller vector first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, list[float]]] = []
        for b in batches:
            rows, values = whole(b.column(1))
            ids = b.column(0).take(pa.array(rows)).to_pylist()
            found += [(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in zip(ids, values.tolist())]
            found = sorted(found)[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["hash", "vector"])

    drawn = vectors.mapInArrow(run, "hash string, vector array<double>").orderBy("hash", "vector").limit(k).collect()
    return [[int(x) for x in integers(np.array([r["vector"]]))[0][1][0]] for r in drawn]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of each one's vectors; those without vectors stay."""
    index, dim = Centroids(centroids), len(centroids[0])

    def each(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dim + 1), object)  # the last column counts
        for _, x in kept:
            number, _ = index.nearest(x)
            for c in np.unique(number):
                own = x[number == c]
                sums[c] += np.array([*own.sum(axis=0).tolist(), len(own)], object)
        rows = [(c, i, place, digit) for c in range(len(centroids)) for i in range(dim + 1) for place, digit in _digits(int(sums[c, i]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "place", "digit"])

    parts = _mapped(vectors, each, "cluster int, component int, place int, digit long").groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit"))
    total: dict[tuple[int, int], int] = {}
    for c, i, place, digit in parts.collect():  # centroids times components times digits, whatever the input
        total[c, i] = total.get((c, i), 0) + (digit << (BASE * place))
    count = [total.get((c, dim), 0) for c in range(len(centroids))]
    return [[total.get((c, i), 0) // count[c] for i in range(dim)] if count[c] else centroids[c] for c in range(len(centroids))]


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid; a squared distance beyond 64 bits is null."""
    index, most = Centroids(centroids), 2**63 - 1

    def each(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, x in kept:
            number, square = index.nearest(x)
            told = pa.array([s if s <= most else None for s in square.tolist()], pa.int64()) if square.dtype == object else pa.array(square)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), told], ["vec_id", "cluster", "distance"])

    return _mapped(vectors, each, "vec_id long, cluster int, distance long")


def by_cluster(values: list, kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors (vec_id, embedding) with DIM finite components.

    Other rows, null embeddings among them, are left out. Rows that repeat count each; a
    null vec_id counts as an empty one in the draw of the first centroids. With fewer
    vectors than ``k`` each is a centroid; without any the result is empty. Equal
    centroids are allowed, the first gets the vectors. A sum of distances beyond 64
    bits, or with such a distance, is null. Columns besides vec_id and embedding are
    not read.
    """
    ship(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("embedding"))
    centroids = starts(vectors, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = reduce(lambda c, _: moved(vectors, c), range(rounds), centroids)
    found = checkpointed(assigned(vectors, centroids))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("distance").isNull()).alias("lost"))
    told = {r["cluster"]: None if r["lost"] else int(r["sum"]) for r in sums.collect()}  # a row per centroid
    own = [told.get(c, 0) for c in range(len(centroids))]
    within = lambda v: v if v is not None and v < 2**63 else None
    inertia = None if None in own else within(sum(own))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select("vec_id", "cluster", "distance", by_cluster([within(v) for v in own], "long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), by_cluster(shas, "string").alias("centroid_sha256"))
