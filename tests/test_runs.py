"""Run snapshots, incremental audits and the maintained parent set."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notegauge.operators import audit, judgments, parents, reuse, scoring
from notegauge.schemas import JUDGMENT
from notegauge.sources import runs

NOTES = "note_path string, stem string, content string, modified_time timestamp"


def notes_of(spark, texts):
    return spark.createDataFrame([(f"n/{k}.md", k, v, None) for k, v in texts.items()], NOTES)


def targets_of(spark, *stems):
    return spark.createDataFrame([(s,) for s in stems], "target string")


def told(rows):
    return {r["note_path"]: r for r in rows.collect()}


def codes(row):
    return [f["code"] for f in row["findings"]]


# --- snapshots


def test_runs_are_committed_whole(spark, tmp_path):
    store = runs.Runs(spark, str(tmp_path / "runs"))
    first = audit.audit(notes_of(spark, {"a": "# x\n", "b": "text"}), targets_of(spark, "a"), "r1", {"k": "v"}, True)
    assert store.committed() == []
    with pytest.raises(ValueError, match="no committed run"):
        store.rows()
    assert store.write(first, "r1") == 1
    assert sorted(map(str, store.rows("r1").collect())) == sorted(map(str, first.collect()))
    assert store.write(first.limit(1), "r2") == 2
    assert store.rows().count() == 1 and store.rows(version=1).count() == 2 and store.rows("r1").count() == 2
    entry = store.committed()[0]
    assert (entry["run_id"], entry["rows"], entry["row_status_counts"]["complete"], sum(entry["priority_counts"].values())) == ("r1", 2, 2, 2)
    with pytest.raises(ValueError, match="committed already"):
        store.write(first, "r1")


def test_a_failed_write_leaves_no_rows_visible(spark, tmp_path):
    store = runs.Runs(spark, str(tmp_path / "runs"))
    rows = audit.audit(notes_of(spark, {"a": "# x\n", "b": "y"}), targets_of(spark), "r", {}, True)
    store.write(rows, "good")
    failing = rows.withColumn("score", F.when(F.col("note_path") == "n/b.md", F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stop"):
        store.write(failing, "bad")
    with pytest.raises(ValueError, match="without note_path"):
        store.write(rows.withColumn("note_path", F.lit(None).cast("string")), "unnamed")
    assert [e["run_id"] for e in store.committed()] == ["good"]
    assert store.rows().count() == 2
    assert store.sweep() == []  # young files may belong to a writer at work
    left = store.sweep(older_than=-1)
    assert len(left) >= 1 and store.sweep(older_than=-1) == []
    assert store.rows().count() == 2  # what is committed stays


def test_of_two_writers_one_takes_the_number(spark, tmp_path):
    log = runs.CommitLog(spark, str(tmp_path / "log"))
    assert log.commit({"run_id": "a", "path": "x"}, 0) == 1
    assert log.commit({"run_id": "b", "path": "y"}, 0) is None
    assert log.commit({"run_id": "b", "path": "y"}, 1) == 2
    assert [(e["version"], e["run_id"]) for e in log.entries()] == [(1, "a"), (2, "b")]
    store = runs.Runs(spark, str(tmp_path / "runs"))
    rows = audit.audit(notes_of(spark, {"a": "# x\n"}), targets_of(spark), "r", {}, True)
    plain = store.log.commit
    calls = []

    def late(entry, against):  # another writer commits first
        if not calls:
            calls.append(plain({**entry, "run_id": "other"}, against))
        return plain(entry, against)

    object.__setattr__(store.log, "commit", late)
    assert store.write(rows, "mine") == 2
    assert [e["run_id"] for e in store.committed()] == ["other", "mine"]


def test_difference(spark):
    before = audit.audit(notes_of(spark, {"a": "# x\n", "b": "same", "c": "gone", "d": "old"}), targets_of(spark, "a", "b"), "r1", {}, True)
    after = audit.audit(notes_of(spark, {"a": "# x\n", "b": "same", "d": "new words", "e": "fresh"}), targets_of(spark, "b"), "r2", {}, True)
    got = {r["note_path"]: r for r in runs.difference(before, after).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"n/a.md": "changed", "n/b.md": "same", "n/c.md": "removed", "n/d.md": "changed", "n/e.md": "added"}
    assert got["n/a.md"]["gained"] == ["missing_parent"] and got["n/a.md"]["lost"] == [] and not got["n/a.md"]["content_changed"]
    assert got["n/d.md"]["content_changed"] and got["n/d.md"]["gained"] == []
    assert got["n/c.md"]["score_after"] is None and got["n/c.md"]["score_before"] is not None
    assert got["n/a.md"]["score_after"] < got["n/a.md"]["score_before"]
    assert {r["change"]: (r["notes"], r["worse"]) for r in runs.summary(runs.difference(before, after)).collect()} == {"changed": (2, 1), "same": (1, 0), "removed": (1, 0), "added": (1, 0)}


# --- reuse


TEXTS = {
    "plain": "just words", "front": "---\nsource:\n---\n# T\n\nwords here\n", "two": "# A\n\nx\n\n# B\n\ny\n", "cards": "START\nBasic\nq\n", "overlap": "It may overlap with another.",
    "dae": "# T\n\n" + "word " * 20 + "\n\nIt is like a map of town.\n\nFor example, a city map in hand.\n", "empty": "",
}
SAME = ("note_path", "content_hash", "score", "priority", "clean", "pending_model", "findings", "recommendations", "dimensions", "factual_risk", "fact_check_required", "factual_risk_reason", "modified_time", "run_id", "config_snapshot")


def test_reuse_equals_a_full_audit(spark):
    rng = random.Random(1)
    texts, linked = dict(TEXTS), {"plain", "two"}
    previous = None
    for step in range(4):
        notes, targets = notes_of(spark, texts), targets_of(spark, *linked)
        got, want = told(reuse.audit_reusing(notes, targets, previous, f"r{step}", {"a": str(step)}, True)), told(audit.audit(notes, targets, f"r{step}", {"a": str(step)}, True))
        assert {k: [str(r[c]) for c in SAME] for k, r in got.items()} == {k: [str(r[c]) for c in SAME] for k, r in want.items()}
        previous = spark.createDataFrame([tuple(r) for r in got.values()], reuse.audit(notes, targets, "r", {}, True).schema)
        texts = {k: v + (" more" if rng.random() < 0.3 else "") for k, v in texts.items() if rng.random() > 0.1} | {f"new{step}": "fresh"}
        linked = {k for k in texts if rng.random() < 0.5}


def test_unchanged_notes_are_not_audited_again(spark):
    """A mark in the earlier run, which no audit would make, comes through where the text is the same."""
    notes = notes_of(spark, TEXTS)
    first = audit.audit(notes, targets_of(spark, "plain", "two"), "r1", {}, True)
    mark = F.array(F.struct(F.lit("weak_example").alias("code"), F.lit("marked").alias("message")))
    marked = first.withColumn("findings", F.concat("findings", mark))
    changed = notes.withColumn("content", F.when(F.col("stem") == "front", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    got = told(reuse.audit_reusing(changed, targets_of(spark, "plain", "cards"), marked, "r2", {}, True))
    assert {k.split("/")[1][:-3]: r["cache_status"] for k, r in got.items()} == {"plain": "hit", "two": "partial", "cards": "partial", "front": "miss", "overlap": "hit", "dae": "hit", "empty": "hit"}
    assert {k.split("/")[1][:-3]: r["row_status"] for k, r in got.items() if r["row_status"] != "reused_cache"} == {"front": "complete"}
    assert all(("weak_example" in codes(r)) == (k != "n/front.md") for k, r in got.items())
    two, cards = codes(got["n/two.md"]), codes(got["n/cards.md"])
    assert "missing_parent" in two and two.index("missing_parent") == two.index("invalid_dae") + 1
    assert "missing_parent" not in cards


@pytest.mark.parametrize("column", ["schema_version", "doctrine_version", "rubric_version", "row_status"])
def test_rows_of_other_versions_do_not_stand(spark, column):
    notes = notes_of(spark, {"a": "x", "b": "y"})
    old = audit.audit(notes, targets_of(spark), "r1", {}, True)
    old = old.withColumn(column, F.when(F.col("note_path") == "n/a.md", "error" if column == "row_status" else "0.0.1").otherwise(F.col(column)))
    got = told(reuse.audit_reusing(notes, targets_of(spark), old, "r2", {}, True))
    assert {k: r["cache_status"] for k, r in got.items()} == {"n/a.md": "miss", "n/b.md": "hit"}
    assert told(reuse.audit_reusing(notes, targets_of(spark), None, "r2", {}, True))["n/a.md"]["cache_status"] == "none"


def test_judgments_are_reused_with_their_notes(spark):
    notes = notes_of(spark, {"a": "words", "b": "words", "c": "words", "d": "words"})
    first = audit.audit(notes, targets_of(spark, "a", "b", "d"), "r1", {}, True)
    answer = lambda p: ("2.0.0", "1.0.2", p, {"clarity": -5}, [("unclear", "say it", [])], False, None, False, [])
    found = spark.createDataFrame([answer(f"n/{k}.md") for k in "ab"], JUDGMENT)
    merged = judgments.merge(first, found)
    targets = targets_of(spark, "a", "c", "d")  # b loses its parent, c gains one
    got, fresh = told(reuse.audit_reusing(notes, targets, merged, "r2", {}, True)), audit.audit(notes, targets, "r2", {}, True)
    want = told(judgments.merge(fresh, found))
    for k in "ab":
        assert [str(got[f"n/{k}.md"][c]) for c in (*SAME, "model_judgment")] == [str(want[f"n/{k}.md"][c]) for c in (*SAME, "model_judgment")]
    assert {k[2]: (r["cache_status"], r["row_status"], r["pending_model"]) for k, r in got.items()} == {
        "a": ("hit", "reused_cache", False), "b": ("partial", "complete", False), "c": ("partial", "reused_cache", True), "d": ("hit", "reused_cache", True),
    }


# --- parents


def structure(spark, links):
    return spark.createDataFrame([(p, " ".join(f"[[folder/{t}.md#h|alias]]" for t in ts)) for p, ts in links.items()], "note_path string, content string")


def test_parent_counts_under_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parents, "PILED", 3)
    rng, now = random.Random(4), {}
    held = parents.ParentSet(spark, str(tmp_path / "parents"))
    assert held.targets().collect() == []
    for _ in range(8):
        changed = {f"s{rng.randrange(8)}": [f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 4))}
        removed = {f"s{rng.randrange(8)}" for _ in range(rng.randrange(3))}
        before = Counter(t for ts in now.values() for t in set(ts))
        flips = held.apply(structure(spark, changed), spark.createDataFrame([(p,) for p in removed] * 2, "note_path string"))
        now = {p: ts for p, ts in now.items() if p not in removed} | changed
        after = Counter(t for ts in now.values() for t in set(ts))
        assert {r["target"]: r["refs"] for r in held.references().collect()} == dict(after)
        assert {tuple(r) for r in flips.collect()} == {(t, before[t], after[t]) for t in before | after if (before[t] == 0) != (after[t] == 0)}
        assert {r["note_path"]: set(r["targets"]) for r in held.postings().collect()} == {p: set(ts) for p, ts in now.items() if ts}
    assert len([e for e in held.log.entries() if e["whole"]]) > 1  # the logs were put together on the way


def test_flips_name_the_notes(spark, tmp_path):
    held = parents.ParentSet(spark, str(tmp_path / "parents"))
    notes = notes_of(spark, {"a": "", "b": "", "c": ""})
    first = held.apply(structure(spark, {"s": ["a", "b"], "t": ["b"]}))
    assert {tuple(r) for r in parents.flipped(notes, first).collect()} == {("n/a.md", False), ("n/b.md", False)}
    second = held.apply(structure(spark, {"s": ["c"]}))
    assert {tuple(r) for r in parents.flipped(notes, second).collect()} == {("n/a.md", True), ("n/c.md", False)}
    full = audit.audit(notes, held.targets(), "r", {}, True)
    assert {r["note_path"] for r in full.filter(scoring.has(F.col("findings"), "missing_parent")).collect()} == {"n/a.md"}


def test_an_update_that_comes_second_is_refused(spark, tmp_path, monkeypatch):
    held = parents.ParentSet(spark, str(tmp_path / "parents"))
    held.apply(structure(spark, {"s": ["a"]}))
    monkeypatch.setattr(runs.CommitLog, "commit", lambda self, entry, against: None)
    with pytest.raises(ValueError, match="came first"):
        held.apply(structure(spark, {"s": ["b"]}))
    assert [r["target"] for r in held.targets().collect()] == ["a"]
