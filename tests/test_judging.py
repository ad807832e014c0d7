"""Asking a judge from the tasks: halves, rounds, resumed runs and committed answers."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from notegauge.__main__ import main
from notegauge.operators import batching, judging, runner

#: A judge that answers for every note it is shown, logs what it was asked, and misbehaves for notes with certain words.
JUDGE = '''
import json, os, re, sys, time, uuid
text, log = sys.stdin.read(), sys.argv[1]
began = time.time()
parts = re.split(r"^## ", text, flags=re.M)[1:]
names = [p.split("\\n")[0] for p in parts]
time.sleep(float(sys.argv[2]))
if "die" in text and not os.path.exists(os.path.join(log, "healed")):
    sys.exit("dead")
if "garble" in text and len(parts) > 1:
    print("no json")
else:
    for name, p in zip(names, parts):
        risky = "vague" in p and (len(parts) > 1 or "always" in p)
        print(json.dumps({"note_path": name, "dimension_adjustments": {}, "findings": [], "factual_risk": risky, "factual_risk_reason": None, "fact_check_required": False, "evidence": []}))
with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
    json.dump({"names": names, "began": began, "ended": time.time()}, f)
'''


class Desk:
    def __init__(self, tmp_path, sleep=0.0):
        self.tmp = tmp_path
        self.log = tmp_path / "log"
        self.log.mkdir()
        (tmp_path / "judge.py").write_text(JUDGE)
        self.judge = runner.CommandRunner(f"{sys.executable} {tmp_path / 'judge.py'} {self.log} {sleep}", str(tmp_path), 60)
        self.out = str(tmp_path / "out")

    def run(self, spark, batches, askers=2):
        rows = [(i + 1, pos, name, text) for i, batch in enumerate(batches) for pos, (name, text) in enumerate(batch.items())]
        df = spark.createDataFrame(rows, "batch long, pos int, note_path string, content string")
        return judging.judge_all(df, self.judge, "Judge.", str(self.tmp / "work"), self.out, askers)

    def calls(self):
        return [json.loads(f.read_text()) for f in self.log.iterdir() if f.name != "healed"]

    def asked(self):
        return sorted(c["names"] for c in self.calls())

    def judged(self, spark):
        return sorted(r["note_path"] for r in spark.read.json(self.out).select("note_path").collect()) if os.path.isdir(self.out) and any(n.endswith(".jsonl") for n in os.listdir(self.out)) else []


def test_two_batches_are_asked_at_once(spark, tmp_path):
    desk = Desk(tmp_path, 3.0)
    assert desk.run(spark, [{"a": "x", "b": "x"}, {"c": "x"}, {"d": "x"}, {"e": "x"}], 4) == 5
    assert desk.judged(spark) == ["a", "b", "c", "d", "e"]
    calls = desk.calls()
    assert len(calls) == 4 and any(x is not y and x["began"] < y["ended"] and y["began"] < x["ended"] for x in calls for y in calls)
    stamped = spark.read.json(desk.out).select("schema_version", "prompt_version").distinct().collect()
    assert [tuple(r) for r in stamped] == [("2.0.0", "1.0.2")]


def test_what_does_not_parse_is_halved_in_the_task(spark, tmp_path):
    desk = Desk(tmp_path)
    assert desk.run(spark, [{"a": "x", "b": "garble", "c": "x"}, {"d": "x"}]) == 4
    assert desk.judged(spark) == ["a", "b", "c", "d"]
    assert desk.asked() == [["a"], ["a", "b", "c"], ["b"], ["b", "c"], ["c"], ["d"]]


def test_what_breaks_the_contract_is_asked_in_another_round(spark, tmp_path):
    desk = Desk(tmp_path)
    assert desk.run(spark, [{"a": "x", "b": "vague", "c": "x"}, {"d": "x"}]) == 4
    assert desk.judged(spark) == ["a", "b", "c", "d"]
    assert desk.asked() == [["a"], ["a", "b", "c"], ["b"], ["b", "c"], ["c"], ["d"]]


def test_a_note_that_is_never_answered_well_is_an_error(spark, tmp_path):
    desk = Desk(tmp_path)
    with pytest.raises(batching.RetryableError, match="must explain factual_risk"):
        desk.run(spark, [{"a": "x", "b": "vague always"}, {"c": "x"}])
    assert desk.judged(spark) == ["a", "c"]  # what was good has been kept


def test_a_task_that_dies_repeats_no_answer(spark, tmp_path):
    """One task asks three batches and dies at the third; nothing is visible, and the next run asks for the third alone."""
    desk = Desk(tmp_path)
    batches = [{"a": "x", "b": "garble"}, {"c": "x"}, {"d": "die"}]
    with pytest.raises(Exception, match="dead"):
        desk.run(spark, batches, 1)
    assert desk.judged(spark) == []
    before = desk.asked()
    assert before == [["a"], ["a", "b"], ["b"], ["c"]]
    (desk.log / "healed").write_text("")
    assert desk.run(spark, batches, 1) == 4
    assert desk.judged(spark) == ["a", "b", "c", "d"] and desk.asked() == sorted([*before, ["d"]])


def test_lines_appear_when_they_are_committed(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = spark.range(100).repartition(5).select(F.col("id").cast("string").alias("value"))
    judging.append_lines(lines, out)
    assert sorted(int(r[0]) for r in spark.read.text(out).collect()) == list(range(100)) and not [n for n in os.listdir(out) if n.startswith("_")]
    failing = lines.select(F.when(F.col("value") == "77", F.raise_error(F.lit("stop"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        judging.append_lines(failing, out)
    assert spark.read.text(out).count() == 100
    judging.append_lines(lines.limit(0), out)
    judging.append_lines(lines.limit(3), out)
    assert spark.read.text(out).count() == 103


def test_runs_and_their_difference_by_command(spark, tmp_path, capsys):
    vault, folder = tmp_path / "v", "Atomic Notes"
    (vault / folder).mkdir(parents=True)
    (vault / folder / "a.md").write_text("# a\n\nwords\n")
    (vault / folder / "b.md").write_text("# b\n\nwords\n")
    audit = lambda run: main(["audit", str(vault), str(tmp_path / run), str(tmp_path / f"{run}.json"), "--run-id", run, "--runs", str(tmp_path / "runs"), "--fixed"])
    assert audit("r1") == 0
    (vault / folder / "b.md").write_text("---\nk: v\n---\n# b\n\nother words\n")
    (vault / folder / "c.md").write_text("# c\n")
    assert audit("r2") == 0 and audit("r2") == 1  # a run is written once
    rows = {r["note_path"]: r for r in (json.loads(x[0]) for x in spark.read.text(str(tmp_path / "r2")).collect())}
    assert {k[-4:]: r["cache_status"] for k, r in rows.items()} == {"a.md": "hit", "b.md": "miss", "c.md": "miss"}
    assert json.loads((tmp_path / "r2.json").read_text())["row_status_counts"] == {"complete": 2, "reused_cache": 1, "error": 0, "skipped": 0}
    capsys.readouterr()
    assert main(["difference", str(tmp_path / "runs"), "r1", "r2", str(tmp_path / "d")]) == 0
    assert capsys.readouterr().out.strip() == "added=1 changed=1"
    told = {r["note_path"][-4:]: r for r in (json.loads(x[0]) for x in spark.read.text(str(tmp_path / "d")).collect())}
    assert told["b.md"]["lost"] == ["missing_frontmatter"] and told["b.md"]["content_changed"] and told["c.md"]["change"] == "added"
    assert main(["difference", str(tmp_path / "runs"), "r1", "r9", str(tmp_path / "e")]) == 1 and "no committed run: r9" in capsys.readouterr().err
