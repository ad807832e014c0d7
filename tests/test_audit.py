import json

import pytest
from pyspark.sql import functions as F

from notegauge import __main__ as cli
from notegauge.functions import text as X
from notegauge.operators import audit, rules
from notegauge.sources import jsonl, vault
from tests import vault_fixture


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = vault_fixture.write(tmp_path_factory.mktemp("vault"))
    notes = vault.notes(spark, str(root), "Atomic Notes")
    targets = audit.parent_targets(vault.notes(spark, str(root), "Structure Notes"))
    return audit.audit(notes, targets, "run", {"a": "b"}, fixed=True).cache()


def test_findings_in_order(rows):
    got = {r["note_link"][2:-2]: [f["code"] for f in r["findings"]] for r in rows.collect()}
    assert got == {k: v[2] for k, v in vault_fixture.NOTES.items()}


def test_scores(rows):
    from notegauge.vocab import COMPONENT_CODES, LOSSES

    for r in rows.collect():
        codes = [f["code"] for f in r["findings"]]
        if "invalid_dae" in codes:
            codes = [c for c in codes if c not in COMPONENT_CODES]
        assert r["score"] == max(1, 100 - sum(LOSSES[c] for c in codes))
        assert r["clean"] == (r["score"] == 100)
        assert (r["factual_risk_reason"] is not None) == ("factual_risk" in codes)


def test_dimensions_keep_every_penalty(rows):
    bundle = rows.filter(F.col("note_link").contains("bundle")).first()
    assert bundle["dimensions"].asDict() == {"structure": 35, "atomicity": 30, "dae_quality": 15, "clarity": 45, "connections": 40, "metadata_card_safety": 100}


def test_hidden_and_empty_files_count(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for name in ("a.md", "_u.md", ".d.md", "x.txt"):
        (tmp_path / "n" / name).write_text("" if name == "a.md" else "x\r\ny")
    got = vault.notes(spark, str(tmp_path), "n").collect()
    assert sorted(r["note_path"] for r in got) == ["n/.d.md", "n/_u.md", "n/a.md"]
    assert vault.notes(spark, str(tmp_path), "missing").count() == 0
    assert {r["content"] for r in got} == {"", "x\ny"}


def test_folders_of_any_depth_are_read(spark, tmp_path):
    paths = ["a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "x/y/z/w/v/e.md", "p/q/r/f.md", "p/q/r.md/g.md"]
    for p in paths:
        (tmp_path / "n" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "n" / p).write_text(p)
    got = vault.notes(spark, str(tmp_path), "n").collect()
    assert sorted(r["note_path"] for r in got) == sorted(f"n/{p}" for p in paths) and all(r["note_path"] == f"n/{r['content']}" for r in got)


def risk(spark, text):
    df = rules.parsed(spark.createDataFrame([(text,)], "content string"))
    return df.select(rules.risky().alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("All learners always forget.", True),
        ("Is it true that all users never err?", False),
        ("Every user account is always active.", False),
        ("Each sampled person everyone receives an equal chance of selection.", False),
        ("A study found that it helps and reduces stress.", True),
        ("Let n be a set; it is given that x = 2.", False),
        ("For example, a cat sits on a mat.", False),
        ("For example, 45% of cats sit.", True),
        ("The value was currently low.", True),
        ("The Acme Corp database requires a license.", True),
        ("Plain words without claims.", False),
        ("Text.\n\nSources:\n1. In 2020 it was 99%.\n", False),
        ("```\nIn 2020 it was 99%.\n```\n", False),
    ],
)
def test_factual_risk(spark, text, expected):
    assert risk(spark, text) is expected


@pytest.mark.parametrize(("n", "present", "long"), [(9, False, False), (10, True, False), (50, True, False), (51, False, True)])
def test_definition_band(spark, n, present, long):
    text = " ".join(["word"] * n) + ".\n\nIt is like a map.\n\nFor example, a city map.\n"
    best = rules.parsed(spark.createDataFrame([(text,)], "content string")).select("best.*").first()
    assert (best["present"], best["too_long"]) == (present, long)


def test_example_follows_analogy_in_prose(spark):
    text = "One two three four five six seven eight nine ten.\n\nFor example, think of a map.\n\nIt is like a map.\n"
    best = rules.parsed(spark.createDataFrame([(text,)], "content string")).select("best.*").first()
    assert best["present"] is False and best["analogy"] == 5 and best["example"] is None


@pytest.mark.parametrize(
    ("text", "n"),
    [("[[a/202401010101 Big Idea.md#x]] is", 3), ("[[a|two words]]", 2), ("![[img.png]] x", 1), ("{{c1::one two::hint}} x", 3), ("<!-- gone --> it's well-known", 2), ("café naïve x²", 3)],
)
def test_rendered_words(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(X.rendered_words(F.col("t")).alias("n")).first()["n"] == n


def test_command_line(spark, tmp_path, capsys):
    root = vault_fixture.write(tmp_path / "v")
    path = lambda n: str(tmp_path / n)
    assert cli.main(["audit", str(root), path("rows"), path("manifest.json"), "--fixed"]) == 0
    assert cli.main(["validate", path("rows")]) == 0
    assert cli.main(["report", path("rows"), path("manifest.json"), path("report.md")]) == 0
    assert cli.main(["views", path("rows"), path("views.yaml")]) == 0
    report = (tmp_path / "report.md").read_text()
    assert "- Total notes: 10" in report and "## Factual-Risk Notes" in report and "Average score" in report
    assert (tmp_path / "views.yaml").read_text().count("  - type: table") == 10
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert manifest["total_notes"] == 10 and sum(manifest["priority_counts"].values()) == 10
    first = jsonl.numbered(spark, path("rows")).orderBy("line").first()
    row = json.loads(first["value"])
    assert "factual_risk_reason" not in row and row["model_judgment"] is None and list(row) == sorted(row)


def test_validate_reports_line(spark, tmp_path, capsys):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.txt").write_text('\n[1]\n{"a": 1}\n')
    assert cli.main(["validate", str(tmp_path / "bad")]) == 1
    assert "part-0.txt:2: row must be an object" in capsys.readouterr().err


def lines_of(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines() if x.strip()]


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("commands")
    vault_fixture.write(root / "v")
    assert cli.main(["audit", str(root / "v"), str(root / "rows"), str(root / "manifest.json"), "--fixed"]) == 0
    return root


JUDGED = {"schema_version": "2.0.0", "prompt_version": "1.0.2", "dimension_adjustments": {}, "findings": [], "factual_risk": False, "factual_risk_reason": None, "fact_check_required": False, "evidence": []}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"score": "high"}, "score must be an integer from 1 to 100 or null"),
        ({"score": 90.5}, "score must be an integer from 1 to 100 or null"),
        ({"score": True}, "score must be an integer from 1 to 100 or null"),
        ({"run_id": 5}, "run_id must be a non-empty string"),
        ({"model_judgment": JUDGED | {"note_path": "x", "schema_version": "9"}}, "model_judgment.schema_version must be 2.0.0"),
        ({"findings": [{"code": "unclear", "message": "m", "odd": 1}]}, "findings[0] has unsupported keys: odd"),
        ({"findings": {}}, "findings must be an array"),
        ({"recommendations": [{"mode": "fly", "message": "m"}]}, "Invalid recommendations[0].mode: fly"),
        ({"dimensions": {"structure": 1}}, "Missing required keys: atomicity"),
        ({"factual_risk_reason": None}, "factual_risk_reason must be a non-empty string"),
        ({"config_snapshot": []}, "config_snapshot must be an object"),
        ({"odd": 1}, "row has unsupported keys: odd"),
        (None, "not valid JSON"),
        ([1, 2], "row must be an object"),
    ],
)
def test_every_command_rejects_bad_lines(spark, audited, tmp_path, capsys, change, error):
    rows = lines_of(audited / "rows")
    bad = "not json at all" if change is None else json.dumps(rows[2] | change if isinstance(change, dict) else change)
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(rows[0]), "", json.dumps(rows[1]), bad, *map(json.dumps, rows[3:])]) + "\n")
    commands = [["validate", str(path)]]
    if change in ({"score": "high"}, None):
        found = tmp_path / "j.jsonl"
        found.write_text("")
        commands += [["merge", str(path), str(audited / "manifest.json"), str(found), str(tmp_path / "o"), str(tmp_path / "m")], ["report", str(path), str(audited / "manifest.json"), str(tmp_path / "r")], ["views", str(path), str(tmp_path / "v")]]
    for command in commands:
        assert cli.main(command) == 1
        assert f"{path}:4: {error}" in capsys.readouterr().err


def test_collect_merge_and_report(spark, audited, tmp_path, capsys):
    """Judgments by a command that answers batches of at most three notes, in two runs; then merged."""
    script = tmp_path / "judge.py"
    script.write_text("import json, re, sys\nfor p in re.findall(r'^## (Atomic Notes/.*)$', sys.stdin.read(), re.M):\n    print(json.dumps(" + repr(JUDGED).replace("None", "None") + " | {'note_path': p}))\n")
    run = ["collect", str(audited / "v"), str(audited / "rows"), str(tmp_path / "j"), str(tmp_path / "work"), "--command", f"python {script}", "--max-notes", "3"]
    assert cli.main([*run, "--limit", "4"]) == 0 and "judged=4" in capsys.readouterr().out
    assert cli.main(run) == 0 and "judged=6" in capsys.readouterr().out
    assert cli.main(["merge", str(audited / "rows"), str(audited / "manifest.json"), str(tmp_path / "j"), str(tmp_path / "merged"), str(tmp_path / "m.json")]) == 0
    merged = lines_of(tmp_path / "merged")
    assert len(merged) == 10 and all(r["model_judgment"]["note_path"] == r["note_path"] for r in merged)
    assert cli.main(["report", str(tmp_path / "merged"), str(tmp_path / "m.json"), str(tmp_path / "r.md")]) == 0
    assert "10 / 10 reviewed" in (tmp_path / "r.md").read_text()
    assert cli.main([*run[:5], "--command", "false"]) == 0  # nothing is left to ask


def test_prepare(spark, audited, tmp_path, capsys):
    note = "Atomic Notes/202401010101 clean.md"
    assert cli.main(["prepare", str(audited / "v"), note, str(tmp_path / "p.txt")]) == 0
    assert "Caching is the practice" in (tmp_path / "p.txt").read_text()
    assert cli.main(["prepare", str(audited / "v"), note, str(tmp_path / "one"), "--collector-input", str(audited / "rows")]) == 0
    assert [r["note_path"] for r in lines_of(tmp_path / "one")] == [note]
    for path, error in (("../x.md", "inside vault"), ("/x.md", "inside vault"), ("x.txt", "Markdown"), ("none.md", "does not exist")):
        assert cli.main(["prepare", str(audited / "v"), path, str(tmp_path / "q")]) == 1 and error in capsys.readouterr().err


def test_verify_cards(spark, audited, tmp_path, capsys, monkeypatch):
    from notegauge.sources import card_service

    def send(url, body):
        action = json.loads(body)["action"]
        return json.dumps({"result": [{"noteId": 17, "modelName": "Basic", "cards": [5], "fields": {"Front": {"value": "What is caching?"}, "Back": {"value": "keeping &eacute;"}}}] if action == "notesInfo" else [{"cardId": 5, "deckName": "General"}], "error": None}).encode()

    asked = card_service.tables
    monkeypatch.setattr(card_service, "tables", lambda spark, ids: asked(spark, ids, send))
    spec = tmp_path / "spec.json"
    card, plain = "Atomic Notes/202401010107 card.md", "Atomic Notes/202401010101 clean.md"
    spec.write_text(json.dumps([{"note_path": card, "representative_text": "caching"}, {"note_path": plain, "anki": False}]))
    assert cli.main(["verify-cards", str(spec), str(audited / "v")]) == 0 and "anki_notes=1 non_anki_notes=1" in capsys.readouterr().out
    spec.write_text(json.dumps([{"note_path": card, "representative_text": "elephants"}]))
    assert cli.main(["verify-cards", str(spec), str(audited / "v")]) == 1 and "representative text missing: elephants" in capsys.readouterr().err
