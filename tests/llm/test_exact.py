import hashlib
import os

import pytest
from pyspark.sql import functions as F

from notegauge.llm import exact

SCHEMA = "doc_id long, text string, digest string, n long, file string"
ROWS = [
    (1, "one two", "d", 1, "f"), (2, "one  two\n", "d", 1, "f"), (3, "onetwo", "d", 1, "f"), (4, "one  two\t", "d", 1, "f"),
    (5, None, None, None, None), (6, "", "", 0, ""), (7, " \t\n\x0b\x0c\r ", "d", 1, "f"),
    (8, "One two", "d", 1, "f"), (9, "one two", "d", 1, "f"), (10, "one\x1ctwo", "d", 1, "f"),
    (None, "one        two", "d", 1, "f"), (None, "only here", "d", 1, "f"), (11, "naïve 漢字 😀", "d", 1, "f"), (12, "naïve漢字😀", "d", 1, "f"),
    (13, "same", "d", 1, "f"), (13, "same", "d", 1, "f"), (14, "same", "d", 1, "f"), (15, "long " * 30000, "d", 1, "f"), (16, "long" * 30000, "d", 1, "f"),
]


def brute(rows):
    """{doc_id and text: (keep_id, group_size, sha)} and the number kept per group."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in exact.WHITE), []).append((doc_id, text or ""))
    out = []
    for content, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(d, keep, len(own), hashlib.sha256(content.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=repr)


def told(found):
    got = found.result().collect()
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=repr), len(kept)


def want(rows):
    found = brute(rows)
    return sorted([r[:3] for r in found], key=repr), len({r[3] for r in found})


def test_by_definition(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(ROWS, SCHEMA).repartition(5).write.parquet(path)
    found = exact.Deduplicator(spark, path, str(tmp_path / "state")).advance()
    assert told(found) == want([r[:2] for r in ROWS])
    got = found.result().select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest"))).collect()
    assert sorted(map(tuple, got), key=repr) == brute([r[:2] for r in ROWS])


@pytest.mark.parametrize("files", [1, 100])
def test_a_growing_folder(spark, tmp_path, files):
    """State goes on over files and calls; a call without new files changes nothing."""
    path, rows = str(tmp_path / "docs"), [r[:2] for r in ROWS]
    found = exact.Deduplicator(spark, path, str(tmp_path / "state"), files=files)
    for i in range(0, len(ROWS), 5):
        spark.createDataFrame(ROWS[i : i + 5], SCHEMA).repartition(2).write.mode("append").parquet(path)
        found.advance()
        assert told(found) == want(rows[: i + 5])
    compared = found._compared().count()
    found.advance()
    assert told(found) == want(rows) and found._compared().count() == compared


def test_texts_are_compared_whole_when_digests_meet(spark, tmp_path):
    """With a digest of a few bits nearly all texts clash, now and across calls, and results are the same."""
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    path, rows = str(tmp_path / "docs"), [r[:2] for r in ROWS]
    found = exact.Deduplicator(spark, path, str(tmp_path / "state"), digest=weak)
    for i in range(0, len(ROWS), 7):
        spark.createDataFrame(ROWS[i : i + 7], SCHEMA).write.mode("append").parquet(path)
        found.advance()
        assert told(found) == want(rows[: i + 7])
    assert found.clashes().count() > 0
    assert exact.Deduplicator(spark, path, str(tmp_path / "other")).advance().clashes().count() == 0


def test_state_is_kept_on_disk(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    exact.Deduplicator(spark, path, state).advance()
    kept = [f for _, _, names in os.walk(f"{state}/checkpoints/state/state") for f in names]
    assert any(f.endswith((".changelog", ".zip")) for f in kept)  # RocksDB's, not the maps of the default store
    provider = "spark.sql.streaming.stateStore.providerClass"
    assert "RocksDB" not in (spark.conf.get(provider, "") or "")  # the session is left as it was


def test_dedup_keeps_columns_and_one_row_a_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact.dedup(df)
    assert got.columns == df.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr)
    assert len(kept) == len({g[3] for g in brute([r[:2] for r in ROWS])})
    assert {k[0] for k in kept} == {g[1] for g in brute([r[:2] for r in ROWS])}
    assert exact.dedup(df.limit(0)).collect() == []


def test_many_copies(spark, tmp_path):
    rows = [(i, "a copy" if i % 3 else f"text {i}") for i in range(3000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    assert told(exact.Deduplicator(spark, path, str(tmp_path / "state")).advance()) == want(rows)
