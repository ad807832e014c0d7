"""Command line: python -m notegauge audit|difference|validate|merge|report|views|prepare|collect|verify-cards|split|verify-plan.

Every command that reads JSON Lines checks each line against its contract first; the
first line that breaks it is named path:line on the error stream, and the exit code is 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from notegauge import config
from notegauge.operators import anki, audit, batching, contracts, judging, judgments, prompt, remediation, report, reuse, runner, validate, views
from notegauge.runtime import scratch
from notegauge.schemas import JUDGMENT
from notegauge.sources import card_service, jsonl, vault
from notegauge.sources.runs import Runs
from notegauge.vocab import PROMPT_VERSION


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def save(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def load(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} must contain a JSON object")
    return value


def rows_of(spark, path: str, default_scan: bool = True):
    """Audit rows of a file that holds to their contract."""
    return jsonl.strict(spark, path, lambda v: contracts.audit_row(v, default_scan))


def judgments_of(spark, path: str):
    return jsonl.strict(spark, path, contracts.judgment, JUDGMENT)


def run_audit(spark, a) -> str:
    settings, started = config.resolve(a.vault), now()
    notes = vault.notes(spark, a.vault, settings["atomic_notes_folder"])
    targets = audit.parent_targets(vault.notes(spark, a.vault, settings["structure_notes_folder"]))
    shown = {k: str(v) for k, v in settings.items()}
    if a.runs:  # rows of the last run are reused, and this run is committed beside it
        store = Runs(spark, a.runs)
        store.write(reuse.audit_reusing(notes, targets, store.rows() if store.committed() else None, a.run_id, shown, a.fixed), a.run_id)
        rows = store.rows(a.run_id)
    else:
        rows = audit.audit(notes, targets, a.run_id, shown, a.fixed)
    jsonl.write(rows, a.rows)
    rows = rows_of(spark, a.rows)
    save(a.manifest, audit.manifest(rows, a.run_id, settings, audit.FIXED_TIME if a.fixed else started, audit.FIXED_TIME if a.fixed else now(), {"audit_rows": a.rows, "manifest": a.manifest}))
    return f"rows={rows.count()}"


def run_difference(spark, a) -> str:
    """What changed between two committed runs, as JSON Lines by path; unchanged notes are left out."""
    found = Runs(spark, a.runs).difference(a.before, a.after).filter("change <> 'same'")
    found.orderBy("note_path").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(a.out)
    return " ".join(f"{r['change']}={r['count']}" for r in found.groupBy("change").count().orderBy("change").collect()) or "no change"


def run_validate(spark, a) -> str:
    return f"valid_rows={rows_of(spark, a.rows, not a.non_default_scan).count()}"


def run_merge(spark, a) -> str:
    rows, found = rows_of(spark, a.rows), judgments_of(spark, a.judgments)
    judgments.check(rows, found, a.allow_missing)
    jsonl.write(judgments.merge(rows, found), a.out)
    counted = audit.manifest(rows_of(spark, a.out), "", {}, "", "", {})
    save(a.out_manifest, load(a.manifest) | {k: counted[k] for k in ("row_status_counts", "priority_counts")} | {"validation_status": "passed", "errors": [], "outputs": {"audit_rows": a.out, "model_judgments": a.judgments, "manifest": a.out_manifest}})
    return f"rows={counted['total_notes']}"


def run_report(spark, a) -> str:
    rows, manifest = rows_of(spark, a.rows).cache(), load(a.manifest)
    wrong = validate.manifest_violations(manifest) or validate.pair_consistency(rows, manifest)
    if wrong:
        raise ValueError("; ".join(wrong))
    report.write(a.out, rows, manifest)
    return a.out


def run_views(spark, a) -> str:
    views.write(a.out, rows_of(spark, a.rows), a.rows)
    return a.out


def run_prepare(spark, a) -> str:
    """The prompt for one note, or with --collector-input the one audit row of a note."""
    vault.resolved(a.vault, a.note_path)
    if a.collector_input:
        jsonl.write(prompt.single(rows_of(spark, a.collector_input), a.note_path), a.out)
    else:
        folder = a.note_path.rpartition("/")[0]
        Path(a.out).write_text(prompt.request(spark, vault.notes(spark, a.vault, folder), a.note_path), encoding="utf-8")
    return a.out


def run_collect(spark, a) -> str:
    """Judgments of what has none yet: a batch is appended once all its answers hold to the contract."""
    rows = jsonl.typed_lines(jsonl.strict_lines(spark, a.rows, contracts.audit_row))
    limit = int(a.limit) if a.limit else None
    chosen = rows.orderBy("file", "line").limit(limit) if limit else rows
    judgments.require(prompt.stale(chosen), "audit row of another prompt version")
    done = judgments_of(spark, a.judgments) if Path(a.judgments).exists() else spark.createDataFrame([], JUDGMENT)
    judgments.require(judgments.duplicates(done), "duplicate model judgment note_path")
    judgments.require(done.filter(~F.col("prompt_version").eqNullSafe(F.lit(PROMPT_VERSION))), "existing judgment of another prompt version")
    notes = vault.notes(spark, a.vault).withColumn("size", F.octet_length("content"))
    batches = batching.pending_batches(chosen.join(notes.select("note_path", "size"), "note_path", "left"), done, max_notes=int(a.max_notes), max_chars=int(a.max_chars))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("note_path")) - 1
    asked = batches.select((F.col("batch_id") + 1).alias("batch"), "note_path", place.cast("int").alias("pos")).join(notes.select("note_path", "content"), "note_path")
    # a note that is gone has nothing to ask about; it is missed at the end
    path = scratch(spark)
    asked.write.parquet(path)
    judge = runner.CommandRunner(a.command, a.vault, int(a.timeout))
    count = judging.judge_all(spark.read.schema(asked.schema).parquet(path), judge, prompt.judgment_prompt(spark), a.work, a.judgments, int(a.askers))
    judgments.require(judgments.missing(chosen, judgments_of(spark, a.judgments)) if Path(a.judgments).exists() else chosen, "missing model judgment")
    return f"judged={count}"


def run_cards(spark, a) -> str:
    """The entries of a card specification against the notes of a vault and the card service."""
    spec = json.loads(Path(a.spec).read_text(encoding="utf-8"))
    if not isinstance(spec, list) or not all(isinstance(e, dict) for e in spec):
        raise ValueError(f"{a.spec} must contain a JSON array of objects")
    texts = lambda t: [t] if isinstance(t, str) else t
    rows = [(i, e.get("note_path"), e.get("anki"), e.get("expected_model"), e.get("expected_deck"), e.get("expected_card_count"), texts(e.get("representative_text"))) for i, e in enumerate(spec)]
    entries = spark.createDataFrame(rows, "entry int, note_path string, anki boolean, expected_model string, expected_deck string, expected_card_count int, representative_text array<string>")
    notes = vault.notes(spark, a.vault)
    ids = (r["note_id"] for r in anki.source_checks(entries, notes).filter("anki and note_id is not null and size(violations) = 0").select("note_id").distinct().collect())
    told = anki.verify(entries, notes, *card_service.tables(spark, ids)).orderBy("entry").collect()  # a specification written by hand
    wrong = [f"{r['note_path']}: {v}" for r in told for v in r["violations"]]
    if wrong:
        raise ValueError("\n".join(wrong))
    cards = sum(r[2] is not False for r in rows)
    return f"anki_verification=ok anki_notes={cards} non_anki_notes={len(rows) - cards}"


def run_split(spark, a) -> str:
    return "\n".join(remediation.split_proposals(vault.notes(spark, a.vault, a.folder)).toJSON().collect())


def run_plan(spark, a) -> str:
    plan = spark.createDataFrame([(a.plan, Path(a.plan).read_text(encoding="utf-8"))], "plan_id string, plan string")
    bad = remediation.plan_violations(plan, a.allow_destructive).first()
    if bad:
        raise ValueError(bad["violations"][0])
    save(a.out, remediation.dry_run(load(a.plan)))
    return a.out


COMMANDS = {
    "audit": (run_audit, ["vault", "rows", "manifest", "--run-id=run", "--fixed", "--runs="]),
    "difference": (run_difference, ["runs", "before", "after", "out"]),
    "validate": (run_validate, ["rows", "--non-default-scan"]),
    "merge": (run_merge, ["rows", "manifest", "judgments", "out", "out_manifest", "--allow-missing"]),
    "report": (run_report, ["rows", "manifest", "out"]),
    "views": (run_views, ["rows", "out"]),
    "prepare": (run_prepare, ["vault", "note_path", "out", "--collector-input="]),
    "collect": (run_collect, ["vault", "rows", "judgments", "work", "--command=", "--limit=", f"--max-notes={batching.MAX_NOTES}", f"--max-chars={batching.MAX_CHARS}", "--timeout=900", f"--askers={judging.ASKERS}"]),
    "verify-cards": (run_cards, ["spec", "vault"]),
    "split": (run_split, ["vault", "folder"]),
    "verify-plan": (run_plan, ["plan", "out", "--allow-destructive"]),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="notegauge")
    sub = parser.add_subparsers(required=True)
    for name, (f, args) in COMMANDS.items():
        p = sub.add_parser(name)
        for x in args:
            name, given, default = x.partition("=")
            p.add_argument(name, **({"default": default} if given else {"action": "store_true"} if x.startswith("--") else {}))
        p.set_defaults(run=f)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("notegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of a repeated key the last value counts
    try:
        print(a.run(spark, a))
    except (ValueError, TypeError, OSError, RuntimeError, runner.RunnerError, batching.RetryableError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
