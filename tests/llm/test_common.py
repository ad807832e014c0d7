import numpy as np
import pytest

from notegauge.llm import common


def test_lookup_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rng = np.random.default_rng(0)
    keys = [0] * 500 + [1] * 300 + rng.integers(2, 60, 400).tolist()
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long")
    known = sorted(set(keys))[::2]
    counts = {k: keys.count(k) for k in known}
    right = spark.createDataFrame([(k, f"v{k}", counts[k]) for k in known], "k long, v string, n long")
    got = {r["id"]: r["v"] for r in common.lookup_join(left, right, ["k"], "n").collect()}
    assert got == {i: f"v{k}" if k in counts else None for i, k in enumerate(keys)}


def test_prefix_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), g, int(rng.integers(8)), int(rng.integers(100)), int(rng.integers(0, 9))) for i, g in enumerate(["a"] * 300 + ["b"] * 20 + [None] * 5)]
    df = spark.createDataFrame(rows, "id long, g string, bucket long, o long, x long")
    got = {r["id"]: r["at"] for r in common.prefix_sums(df, ["g"], "bucket", ["o", "id"], "x", "at").collect()}
    want = {}
    for g in ("a", "b", None):
        at = 0
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[3], r[0])):
            want[r[0]] = at
            at += r[4]
    assert got == want


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(3, 2), (2, 1), (9, 8), (8, 3)], [(i, 0) for i in range(1, 200)], [(i, i + 7) for i in range(100)]])
def test_components(spark, pairs):
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_checkpoints_go_to_the_named_folder(spark):
    assert common.shared_dir(spark).startswith(("file:", "/")) and "checkpoints" in common.shared_dir(spark)
