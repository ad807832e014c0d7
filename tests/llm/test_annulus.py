import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegauge.llm import annulus

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k=annulus.K, rounds=annulus.ROUNDS):
    """The contract with Python's whole numbers and all centroids compared."""
    kept = [(i, tuple(int(x) * 1024 if abs(x) > 2.0**900 else math.floor(1024 * x) for x in e)) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, x in kept:
            own[near(x)[1]].append(x)
        centroids = [tuple(sum(v) // len(xs) for v in zip(*xs)) if xs else c for xs, c in zip(own, centroids)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    sums = {c: sum(d for _, j, d in found if j == c) for c in range(k)}
    fits = lambda v: v if v < 2**63 else None
    lost = {c for _, c, d in found if d >= 2**63}
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, fits(d), None if c in lost else fits(sums[c]), None if lost else fits(sum(sums.values())), sha(c)) for i, c, d in found), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(3)
    got = annulus.clusters(df, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(rng, n, spread=1.0):
    return [(i, [rng.gauss(0, 1) * spread * (1 + i % 4) for _ in range(64)]) for i in range(n)]


def test_by_definition(spark):
    rows = vectors(random.Random(1), 200)
    assert run(spark, rows) == brute(rows)


def test_ties_repeats_and_rows_left_out(spark):
    rng = random.Random(2)
    corner = [[float(rng.randrange(2)) for _ in range(3)] + [0.0] * 61 for _ in range(120)]  # many equal distances and norms
    rows = [(i, e) for i, e in enumerate(corner)] + [(3, corner[3]), (3, corner[4]), (None, corner[5]), (None, corner[6])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] + [1.0] * 63), (907, [-math.inf] * 64)]
    assert run(spark, rows) == brute(rows)


def test_few_and_equal_vectors(spark):
    rows = [(i, [0.25] * 64) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert run(spark, [(1, None)]) == []
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [1e4, 1e6, 1e12, 1e30, 1e300])
def test_large_components_stay_exact(spark, size):
    rng = random.Random(3)
    rows = vectors(rng, 20) + [(100 + i, [x * size for x in e]) for i, e in vectors(rng, 20)]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.sampled_from([1, 3, 1000, 2**26]))
def test_annulus_against_all_centroids(seed, k, size):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-size, size + 1, (k, 5)).tolist()
    x = rng.integers(-size, size + 1, (40, 5))
    number, square = annulus.Centroids(centroids).nearest(x)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for v in x.tolist()]
    assert list(zip(square.tolist(), number.tolist())) == want


def test_far_centroids_are_not_compared():
    """Norms far from a vector's are ruled out by the binary search."""
    centroids = annulus.Centroids([[1000 * j, 0, 0] for j in range(50)])
    x = np.array([[1000 * j + 3, 1, 0] for j in range(50)])
    compared = []
    rows = centroids.rows

    class Counted:
        dtype = rows.dtype

        def __getitem__(self, j):
            compared.append(int(j))
            return rows[j]

    centroids.rows = Counted()
    number, _ = centroids.nearest(x)
    assert number.tolist() == list(range(50))
    assert len(compared) == 50  # each is the first guess of one vector and in no other's annulus


def test_slices_of_a_column():
    column = pa.array([[1.0, 2.0], None, [3.0], [4.0, None], [5.0, 6.0]], pa.list_(pa.float64())).slice(1)
    rows, values = annulus.whole(column, 2)
    assert rows.tolist() == [3] and values.tolist() == [[5.0, 6.0]]


def test_sums_over_many_tasks(spark):
    rows = [(i, [float(i % 7) - 3] * 64) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, annulus.clusters(df.repartition(40)).collect())) == sorted(map(tuple, annulus.clusters(df.coalesce(1)).collect()))
    assert annulus.clusters(df).agg(F.count_distinct("cluster")).first()[0] == 7
