import json
import random

import pytest
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.operators import anki, audit, batching, judgments, remediation, scoring, tasks, validate, views
from notegauge.schemas import JUDGMENT
from notegauge.sources import jsonl
from notegauge.streaming import audit_stream
from notegauge.vocab import CODES, LOSSES, MODES, vocabulary


def eval1(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return df.select(column.alias("x")).first()["x"]


CODE_LIST = "array<string>"


@pytest.mark.parametrize(
    ("codes", "canon", "loss"),
    [
        ([], [], 0),
        (["weak_dae", "weak_dae"], ["weak_dae"], 15),
        (["weak_definition", "weak_analogy", "weak_example"], ["weak_definition", "weak_analogy", "weak_example"], 35),
        (["multi_note", "not_atomic"], ["multi_note"], 45),
        (["weak_dae", "invalid_dae", "definition_too_long"], ["invalid_dae"], 35),
        (["multi_note", "misfiled_reference", "invalid_dae"], ["multi_note", "misfiled_reference", "invalid_dae"], 115),
    ],
)
def test_canonical_and_loss(spark, codes, canon, loss):
    assert eval1(spark, scoring.canonical(F.col("c")), c=(codes, CODE_LIST)) == canon
    assert eval1(spark, scoring.loss(F.col("c")), c=(canon, CODE_LIST)) == loss
    assert eval1(spark, scoring.score(scoring.loss(F.col("c"))), c=(canon, CODE_LIST)) == max(1, 100 - loss)


def test_unknown_code_is_an_error(spark):
    with pytest.raises(Exception, match="unknown finding code"):
        eval1(spark, scoring.canonical(F.col("c")), c=(["nonsense"], CODE_LIST))


@pytest.mark.parametrize(("score", "bucket"), [(49, "P0"), (50, "P1"), (69, "P1"), (70, "P2"), (84, "P2"), (85, "P3"), (99, "P3"), (100, None)])
def test_buckets(spark, score, bucket):
    assert eval1(spark, scoring.bucket(F.col("s")), s=(score, "int")) == bucket


def test_vocabulary(spark):
    assert vocabulary(spark).count() == 17 == len(CODES) and set(LOSSES) == set(MODES)


def audit_rows(spark, findings):
    rows = [(f"n{i}", f"n{i}", "h", None, [(c, "m") for c in f]) for i, f in enumerate(findings)]
    return audit.rows(spark.createDataFrame(rows, "note_path string, stem string, content_hash string, modified_time timestamp, findings array<struct<code:string,message:string>>"), "r", {}, True)


def judged(spark, rows):
    base = {"schema_version": "2.0.0", "prompt_version": "1.0.2", "dimension_adjustments": {}, "findings": [], "factual_risk": False, "factual_risk_reason": None, "fact_check_required": False, "evidence": []}
    return spark.createDataFrame([json.dumps(base | r) for r in rows], "string").select(F.from_json("value", JUDGMENT).alias("j")).select("j.*")


def test_merge(spark):
    rows = audit_rows(spark, [["missing_parent", "weak_dae"], ["weak_dae"], []])
    found = judged(spark, [
        {"note_path": "n0", "findings": [{"code": "unclear", "message": "u"}, {"code": "missing_parent", "message": "late"}], "dimension_adjustments": {"clarity": -200}},
        {"note_path": "n1", "factual_risk": True, "factual_risk_reason": "why"},
    ])
    got = {r["note_path"]: r for r in judgments.merge(rows, found).collect()}
    assert [(f["code"], f["message"]) for f in got["n0"]["findings"]] == [("missing_parent", "m"), ("unclear", "u")]
    assert got["n0"]["score"] == 77 and got["n0"]["dimensions"]["clarity"] == 0 and got["n0"]["cache_status"] == "miss"
    assert [f["code"] for f in got["n1"]["findings"]] == ["factual_risk"] and got["n1"]["factual_risk_reason"] == "why" and not got["n1"]["clean"]
    assert got["n2"]["pending_model"] and not got["n2"]["clean"] and got["n2"]["score"] == 100


@pytest.mark.parametrize(
    ("found", "error"),
    [
        ([{"note_path": "n0"}], "missing model judgment: n1"),
        ([{"note_path": "n0"}, {"note_path": "n0"}], "duplicate"),
        ([{"note_path": "zz"}], "not audited: zz"),
        ([{"note_path": "n0", "prompt_version": "0"}], "prompt_version mismatch: n0"),
    ],
)
def test_provenance(spark, found, error):
    with pytest.raises(ValueError, match=error):
        judgments.check(audit_rows(spark, [[], []]), judged(spark, found))
    judgments.check(audit_rows(spark, [[], []]), judged(spark, [{"note_path": "n0"}]), allow_missing=True)


def test_a_null_key_is_a_violation(spark):
    nulls = spark.createDataFrame([(None,)], "note_path string")
    with pytest.raises(ValueError, match="odd: None"):
        judgments.require(nulls, "odd")
    judgments.require(nulls.limit(0), "odd")


def test_row_and_judgment_violations(spark):
    rows = audit_rows(spark, [[]])
    bad = rows.withColumn("score", F.lit(101)).withColumn("note_link", F.lit("[[ |x]]")).withColumn("priority", F.lit("P9"))
    assert rows.select(F.size(validate.row_violations(rows)).alias("n")).first()["n"] == 0
    assert bad.select(validate.row_violations(bad).alias("v")).first()["v"] == ["Invalid priority: P9", "score must be an integer from 1 to 100 or null", "note_link must be an Obsidian wikilink"]
    js = judged(spark, [{"note_path": "a"}, {"note_path": "b", "schema_version": "1"}, {"note_path": "c", "factual_risk": True}, {"note_path": "d", "evidence": [{"excerpt": "w " * 41, "reason": "r"}]}, {"note_path": "e", "findings": [{"code": "x", "message": "m"}]}])
    got = {r["note_path"]: len(r["v"]) for r in js.select("note_path", validate.judgment_violations().alias("v")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 1}
    line = spark.createDataFrame([('{"a": 1, "z": 2}',), ("[1]",)], "value string")
    assert [r["v"] for r in line.select(validate.json_violations(F.col("value"), ("a", "b")).alias("v")).collect()] == [["Missing required keys: b", "Unknown keys: z"], ["row must be an object"]]


def test_manifest(spark):
    rows = audit_rows(spark, [[], ["multi_note"]])
    m = audit.manifest(rows, "r", {}, "a", "b", {"manifest": "m"})
    assert validate.manifest_violations(m) == [] and validate.pair_consistency(rows, m) == []
    assert validate.pair_consistency(rows, m | {"total_notes": 3, "run_id": "x"}) == ["run_id differs", "total_notes differs"]
    assert validate.manifest_violations(m | {"total_notes": True, "outputs": {"odd": "x"}}) == ["total_notes must be a non-negative integer", "outputs must map known names to strings"]
    assert validate.manifest_violations({}) != []


def test_views_and_queue(spark):
    rows = audit_rows(spark, [[], ["multi_note"], ["factual_risk", "duplicate_overlap"]])
    got = {(r["view"], r["note_path"]) for r in views.saved_views(rows).collect()}
    assert ("Factual Risk", "n2") in got and ("No Changes", "n0") in got and ("Multi-Note Split Candidates", "n1") in got and len([g for g in got if g[0] == "All Audited Notes"]) == 3
    with pytest.raises(ValueError, match="unknown bucket"):
        views.queue(rows, "P7")
    assert '__no_matching_audit_rows__' in views.view_file(rows.limit(0), "it's")


def plan_text(*operations, **more):
    return json.dumps({"plan_version": "1", "audit_run_id": "r", "mode": "m", "operations": list(operations)} | more)


def plan_messages(spark, text, destructive=True):
    got = remediation.plan_violations(spark.createDataFrame([(1, text)], "plan_id int, plan string"), destructive).first()
    return got["violations"] if got else []


def test_plans(spark):
    split = {"operation": "split", "approved": True, "delete_original": True, "proposed_outputs": [{"note_path": "a", "content": "b"}]}
    ops = [{"operation": "edit"}, {"operation": "delete"}, {"operation": "fly"}, {}, split | {"proposed_outputs": [{"note_path": "a", "content": ""}]}, {"operation": "edit", "operation_type": "x"}]
    want = ["Operation 1 requires approval", "Operation 2 has unsupported operation", "Operation 3 must state operation", "Split operation 4 output 0 requires content", "Operation 5 uses unsupported operation_type"]
    assert plan_messages(spark, plan_text(*ops)) == want
    assert plan_messages(spark, plan_text(*ops), False)[:2] == ["Operation 1 is destructive", "Operation 1 requires approval"]
    assert plan_messages(spark, plan_text(split)) == []
    assert plan_messages(spark, plan_text(split), False) == ["Operation 0 is destructive"]
    assert plan_messages(spark, plan_text()) == []


@pytest.mark.parametrize(
    ("operation", "said"),
    [
        ("x", ["Operation 1 must be an object"]),
        (None, ["Operation 1 must be an object"]),
        ([{"operation": "delete"}], ["Operation 1 must be an object"]),
        ({"operation": 5}, ["Operation 1 must state operation"]),
        ({"operation": None}, ["Operation 1 must state operation"]),
        ({"operation": "edit", "operation_type": None}, ["Operation 1 uses unsupported operation_type"]),
        ({"operation": "delete", "approved": "true"}, ["Operation 1 requires approval"]),
        ({"operation": "move", "approved": 1}, ["Operation 1 requires approval"]),
        ({"operation": "rename", "approved": None}, ["Operation 1 requires approval"]),
        ({"operation": "split", "approved": True, "delete_original": "yes", "proposed_outputs": "n"}, ["Split operation 1 must state delete_original=true", "Split operation 1 requires proposed_outputs"]),
        ({"operation": "split", "approved": True, "delete_original": True, "proposed_outputs": [{"note_path": "n", "content": 5}]}, ["Split operation 1 output 0 requires content"]),
        ({"operation": "split", "approved": True, "delete_original": True, "proposed_outputs": [{"note_path": "n", "content": "c"}, 7, {"content": "c"}]}, ["Split operation 1 output 1 must be an object", "Split operation 1 output 2 requires note_path"]),
    ],
)
def test_one_odd_operation_hides_no_other(spark, operation, said):
    got = plan_messages(spark, plan_text({"operation": "delete"}, operation, {"operation": "fly"}))
    assert got == ["Operation 0 requires approval", *said, "Operation 2 has unsupported operation"]


def test_plans_that_are_none(spark):
    assert plan_messages(spark, "[]") == ["plan must be an object"]
    assert plan_messages(spark, "{") == ["not valid JSON"]
    assert plan_messages(spark, '{"mode": "m"}') == ["Missing plan key: plan_version", "Missing plan key: audit_run_id", "Missing plan key: operations"]
    assert plan_messages(spark, plan_text(operations={"operation": "edit"})) == ["operations must be a list"]
    assert plan_messages(spark, plan_text(operations=None)) == ["operations must be a list"]


def test_verify_plan_command(spark, tmp_path, capsys):
    from notegauge.__main__ import main

    path, out = tmp_path / "plan.json", str(tmp_path / "out.json")
    path.write_text(plan_text({"operation": "delete"}, "x"))
    assert main(["verify-plan", str(path), out]) == 1 and "Operation 0 is destructive" in capsys.readouterr().err
    path.write_text('{"plan_version":"1","audit_run_id":"r","mode":"m","operations":[{"operation":"delete","operation":"edit"}]}')
    assert main(["verify-plan", str(path), out]) == 0 and json.loads(open(out).read())["operations"] == [{"operation": "edit"}]


def test_split(spark):
    notes = spark.createDataFrame([("n", "---\na: b\n---\nintro\n# A/B\none\n```\n# no\n```\n# C\ntwo\n")], "note_path string, content string")
    assert [(r["note_path"], r["content"]) for r in remediation.split_proposals(notes).orderBy("pos").collect()] == [("Atomic Notes/A-B.md", "# A/B\none\n```\n# no\n```\n"), ("Atomic Notes/C.md", "# C\ntwo\n")]


def test_batches(spark):
    sizes = [10, 30, 60, 200, 5, 5, 90, 1]
    notes = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(sizes)], "note_path string, size long")
    got = [r["batch_id"] for r in batching.greedy_batches(notes, 3, 100).orderBy("note_path").collect()]
    assert got == [0, 0, 0, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("spans", [1, 2, 7, 40])
def test_batches_are_those_of_one_pass(spark, spans, monkeypatch):
    """However the notes are cut into spans: null sizes, notes larger than a batch, groups and notes without one."""
    import random

    monkeypatch.setattr(batching, "SAMPLED", 3)
    rng = random.Random(spans)
    for grouped in (False, True):
        rows = [(rng.choice([None, "a", "b", "c"]) if grouped else "x", f"n{i:04d}", rng.choice([None, 1, 5, 30, 60, 200])) for i in range(260)]
        want, now = {}, object()
        for g, p, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
            if g != now:
                now, batch, count, chars = g, -1, 5, 0
            if count >= 5 or (count and chars + (size or 0) > 100):
                batch, count, chars = batch + 1, 0, 0
            count, chars = count + 1, chars + (size or 0)
            want[p] = batch
        df = spark.createDataFrame(rows, "g string, note_path string, size long")
        got = batching.greedy_batches(df, 5, 100, "g" if grouped else None, spans=spans).collect()
        assert {r["note_path"]: r["batch_id"] for r in got} == want and len(got) == 260
    assert batching.greedy_batches(df.limit(0)).count() == 0


def test_responses():
    for text in ("", "  \n", "```json\n\n```"):
        with pytest.raises(ValueError, match="empty"):
            batching.parse_response(text)
    assert batching.parse_response('```json\n[{"a": 1}]\n```') == [{"a": 1}]
    assert batching.parse_response('{"a": 1}') == [{"a": 1}]
    assert batching.parse_response('{"a": 1}\n\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError, match="line 2"):
        batching.parse_response('{"a": 1}\nnope')


def test_collect_halves_failing_batches():
    asked = []

    def ask(rows):
        asked.append(len(rows))
        if len(rows) > 1:
            raise batching.RetryableError("too long")
        return [{"note_path": rows[0]["note_path"]}]

    got = list(batching.collect([{"note_path": str(i)} for i in range(3)], ask))
    assert [i for i, _ in got] == [1001, 1002001, 1002002] and asked == [3, 1, 2, 1, 1]
    with pytest.raises(batching.RetryableError):
        list(batching.collect([{"note_path": "a"}], lambda rows: []))


def test_tasks(spark):
    fields = "path string, status string, priority string, execution_shape string, task_type string, human_energy string, source_type string, goal string, project string, people string, due date, not_before date, waiting_on string, follow_up_on date, blocked_on string, blocked_since date, date_closed date"
    row = lambda path, status, **k: tuple({"path": path, "status": status, "priority": "P2", "execution_shape": "human", "task_type": "create", "human_energy": "low", "source_type": "import", "goal": "g"}.get(c) if c not in k else k[c] for c in [f.split()[0] for f in fields.split(", ")])
    df = spark.createDataFrame([row("Tasks/a.md", "todo"), row("Tasks/b.md", "blocked"), row("Tasks/c.md", "todo", priority="unknown"), row("x/d.md", "todo"), row("Tasks/e.md", "done", waiting_on="x")], fields)
    assert [r["name"] for r in tasks.view(df, "Todo").collect()] == ["a", "c"]
    assert "Task" in tasks.view(df, "Todo", display=True).columns
    got = {r["path"]: r["v"] for r in df.select("path", tasks.contract_violations().alias("v")).collect()}
    assert got["Tasks/a.md"] == [] and got["Tasks/b.md"] == ["blocked requires blocked_on", "blocked requires blocked_since"]
    assert got["Tasks/c.md"] == ["a task with an unknown property stays in triage"] and got["Tasks/e.md"] == ["done requires date_closed", "waiting_on is stale for this status"]


def test_anki(spark):
    spec = spark.createDataFrame([(0, "a", None, None, None, None, ["front"]), (1, "b", None, None, None, None, ["x"]), (2, "c", False, None, None, None, None), (3, "d", None, None, None, None, ["x"]), (4, "../e", None, None, None, None, ["x"])], "entry int, note_path string, anki boolean, expected_model string, expected_deck string, expected_card_count int, representative_text array<string>")
    card = "TARGET DECK: General\nSTART\nBasic\nfront\nBack: b\n<!--ID: {}-->\nEND\n"
    notes = spark.createDataFrame([("a", card.format(7)), ("b", card.format(7)), ("c", "plain"), ("d", card.format(8).replace("General", "Odd"))], "note_path string, content string")
    service = spark.createDataFrame([(7, "Basic", [70], {"Front": ("front&nbsp;x",), "Back": ("<b></b>",)})], "noteId long, modelName string, cards array<long>, fields map<string,struct<value:string>>")
    cards = spark.createDataFrame([(70, "General")], "cardId long, deckName string")
    got = {r["entry"]: r["violations"] for r in anki.verify(spec, notes, service, cards).collect()}
    assert got[0] == ["Basic Back field is empty"] and got[1] == ["duplicate ID 7 also appears in a"] and got[2] == []
    assert got[3] == ["source deck=Odd, expected=General"] and "note_path must stay inside vault" in got[4]


def test_jsonl_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f'{{"i": {i}}}\n' if i % 3 else "\n" for i in range(1, 5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got = {r["line"]: json.loads(r["value"])["i"] for r in jsonl.numbered(spark, str(tmp_path / "x.jsonl")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: i for i in range(1, 5000) if i % 3}
    (tmp_path / "y.jsonl").write_text("{}\n\n[]")
    several = jsonl.numbered(spark, f"{tmp_path}/*.jsonl")
    assert {r["line"] for r in several.filter(F.col("file").endswith("y.jsonl")).collect()} == {1, 3} and several.count() == len(got) + 2
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Sort [" not in plan


def test_lines_of_other_splits_are_refused(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{}\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    lines = jsonl.numbered(spark, str(tmp_path / "x.jsonl"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        with pytest.raises(Exception, match="splits of a file have changed"):
            lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert jsonl.errors(spark.createDataFrame([("f", 1, "[1]"), ("f", 2, "{}"), ("f", 3, "{x")], "file string, line long, value string")).count() == 2


def test_stream_is_idempotent(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "a", "# x\n", None), ("b.md", "b", "# y\n", None)], "note_path string, stem string, content string, modified_time timestamp")
    notes.write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([("a",)], "target string")
    for run in ("c1", "c2"):
        source = spark.readStream.schema(notes.schema).parquet(str(tmp_path / "in"))
        audit_stream.stream(source, targets, str(tmp_path / "out"), str(tmp_path / run), "r", {}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_takes_the_latest_version(spark, tmp_path):
    from datetime import datetime

    when = [datetime(2024, 1, d) for d in (1, 3, 2)]
    notes = spark.createDataFrame([("a.md", "a", f"# v{i}\n", t) for i, t in enumerate(when)] + [("b.md", "b", "x", None)], "note_path string, stem string, content string, modified_time timestamp")
    targets = spark.createDataFrame([("a",)], "target string")
    for batch in (notes, notes, notes.limit(1)):
        audit_stream.audit_batch(batch, targets, str(tmp_path / "out"), "r", {})
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("note_path").agg(F.collect_list("modified_time").alias("t")).collect()
    assert {r["note_path"]: sorted(r["t"]) for r in got} == {"a.md": ["2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z"], "b.md": []}


def test_cache_keys_are_the_hash_of_ascii_json(spark):
    import hashlib

    versions = {"audit_mode": "full", "doctrine_version": "1.0.4", "prompt_version": "1.0.2", "rubric_version": "1.0.1"}
    for path in ("a.md", "é/漢😀.md", 'q"\\.md'):
        want = hashlib.sha256(json.dumps(versions | {"note_path": path, "content_hash": "h"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        got = eval1(spark, batching.cache_key(F.col("p"), F.lit("h"), versions), p=(path, "string"))
        assert got == f"model-judgment:v1:{want}"


def test_prompt_and_single(spark):
    from notegauge.operators import prompt

    text = prompt.judgment_prompt(spark)
    assert all(f"| `{c}` | {LOSSES[c]} |" in text for c in CODES)
    notes = spark.createDataFrame([("a.md", "x"), ("b.md", "y"), ("b.md", "z")], "note_path string, content string")
    assert prompt.request(spark, notes, "a.md").endswith("\nx\n")
    for path, error in (("b.md", "duplicate"), ("c.md", "not found")):
        with pytest.raises(ValueError, match=error):
            prompt.single(notes, path)
    bad = {p: eval1(spark, prompt.unsafe_path(F.col("p")), p=(p, "string")) for p in ("a/b.md", "/a.md", "a/../b.md", "a.txt")}
    assert list(bad.values()) == [False, True, True, True]


def test_command_runner(tmp_path):
    from notegauge.operators.runner import CommandRunner, RunnerError, asker

    rows = [{"note_path": "a"}]
    (tmp_path / "said.json").write_text('{"note_path": "a", "prompt_version": "0"}')
    ask = asker(CommandRunner("cat {vault}/said.json", str(tmp_path)), lambda r: "prompt", str(tmp_path))
    assert list(batching.collect(rows, ask)) == [(1, [{"note_path": "a", "prompt_version": "1.0.2", "schema_version": "2.0.0"}])]
    to_file = CommandRunner("sh -c 'cat > {output_path}'", str(tmp_path))
    assert to_file("hello", str(tmp_path)) == "hello"
    for template, error in (("sh -c 'exit 3'", "exit 3"), ("/no/such/command", "did not start"), ("{nothing}", "template"), ("", "empty")):
        with pytest.raises(RunnerError, match=error):
            CommandRunner(template, str(tmp_path))("x", str(tmp_path))
    with pytest.raises(batching.RetryableError, match="no answer"):
        CommandRunner("sleep 5", str(tmp_path), timeout=1)("x", str(tmp_path))


def test_card_service(spark):
    from notegauge.sources import card_service

    asked = []

    def send(url, body):
        asked.append(url)
        if "127" in url:
            raise OSError("down")
        action = json.loads(body)["action"]
        return json.dumps({"result": [{"noteId": 1, "modelName": "Basic", "cards": [5], "fields": {"Front": {"value": "f"}}}] if action == "notesInfo" else [{"cardId": 5, "deckName": "D"}], "error": None}).encode()

    notes, cards = card_service.tables(spark, iter([1]), send)
    assert notes.first()["fields"]["Front"]["value"] == "f" and cards.first()["deckName"] == "D" and len(asked) == 4
    with pytest.raises(RuntimeError, match="bad"):
        card_service.invoke("x", {}, lambda u, b: b'{"error": "bad"}')


def test_naming(spark):
    from notegauge.operators import naming

    notes = [
        ("Interleaving strengthens discrimination.", "# I\n\nSTART\nCloze\nInterleaving {{c1::strengthens discrimination}}.\nExtra: x\nEND\n", True),
        ("Caching keeps results", "---\ntitle: Cache\n---\n# Cache\n\nCaching **keeps** results. It helps.\n", True),
        ("Caching", "# Cache\n\nCaching keeps results.\n", False),
        ("Under a heading", "# X\n\nIntro here.\n\n## Definition\nUnder a heading. More.\n", True),
    ]
    rows = [(str(i), "202401010101 " + s.removesuffix("."), c) for i, (s, c, _) in enumerate(notes)]
    got = {r["note_path"]: r for r in naming.alignment(spark.createDataFrame(rows, "note_path string, stem string, content string")).collect()}
    assert [got[str(i)]["filename_aligned"] for i in range(4)] == [n[2] for n in notes]
    assert got["1"]["title_aligned"] is True and got["2"]["title_aligned"] is None
    assert eval1(spark, naming.cloze_cards(F.col("t")), t=("{{c1::a}} {{c2::b}} {{c1::c}}", "string")) == 2


def test_references_without_a_semicolon(spark):
    from notegauge.functions.html import visible

    text = ("<b>a&amp</b> &amp; &ampx; &copy &#60;i&#62; &#60 &nope; &notin;&nbsp;&eacute;", "string")
    assert eval1(spark, visible(F.col("t"), closed=True), t=text) == "a&amp & &ampx; &copy  &#60 &nope; ∉ é"
    assert eval1(spark, visible(F.col("t")), t=text) == "a& & &x; ©  < &nope; ∉ é"  # as html.unescape has it


def test_what_markers_are_judged_by_is_made_once(spark):
    """Expressions that repeat their input are evaluated as often: the lines of a note had been made dozens of times."""
    assert str(anki.marker_violations(F.col("of_note"), F.lit("Basic"), F.lit("General"))).count("of_note") == 1


@pytest.mark.parametrize("name", ["card_markers", "task_bodies"])
def test_one_file_of_parts_is_dealt_to_all_cores(spark, tmp_path, name):
    from notegauge.plans import catalog

    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and df.count() == 40


def test_markers_of_a_note_are_judged_once(spark):
    """The rows that state an ID and the rows that are told of it were two plans, each with all texts and patterns in it."""
    spec = spark.createDataFrame([(0, "a", None, None, None, None, ["q"]), (1, "b", None, None, None, None, ["q"])], "entry int, note_path string, anki boolean, expected_model string, expected_deck string, expected_card_count int, representative_text array<string>")
    notes = spark.createDataFrame([(p, "TARGET DECK: General\nSTART\nBasic\nq\n<!--ID: 7-->\nEND\n") for p in "ab"], "note_path string, content string")
    df = anki.source_checks(spec, notes)
    assert "TARGET DECK" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["entry"]: r["violations"] for r in df.collect()} == {0: [], 1: ["duplicate ID 7 also appears in a"]}


def test_stripped_lines_are_lines_stripped(spark):
    """Every line break and blank, alone and mixed, in texts that are ASCII and that are not."""
    odd = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    draw = random.Random(3)
    texts = ["".join(draw.choices([*"aé​", "START", "\r\n", "  ", *some], k=draw.randrange(9))) for some in (odd[:10], odd) for _ in range(4000)] + [a + "x" + b + a for a in odd for b in odd] + odd + ["", None]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.stripped_lines(t).alias("got"), F.transform(X.lines(t), X.strip).alias("want"))
    assert df.filter("not (got <=> want)").limit(5).collect() == []
