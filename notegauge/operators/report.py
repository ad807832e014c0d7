"""The Markdown report: figures from one aggregate, sections of ordered table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.functions.text import table_cell
from notegauge.operators import audit, scoring
from notegauge.operators.views import is_risky
from notegauge.sources import ordered
from notegauge.vocab import BUCKETS

# Titles and lines of the report.
SECTIONS = {"P0": "P0 Critical Remediation", "P1": "P1 High-Impact Remediation", "P2": "P2 Meaningful Improvements", "P3": "P3 Polish", "no_change": "No Changes"}
STEPS = (
    ("P0", "Resolve P0 critical remediation first"),
    ("P1", "Work P1 high-impact remediation next"),
    ("P2", "Review P2 improvements after blockers are clear"),
    ("P3", "Keep P3 polish as low-risk cleanup"),
    ("no_change", "Leave no-change notes alone unless a later audit finds new issues"),
    ("risky", "Fact-check factual-risk notes before relying on them"),
    ("duplicates", "Review duplicate or overlap candidates before rewriting related notes"),
)


TABLE = "| Note | Score | Clean | Findings | Recommendations |\n|---|---:|:---:|---|---|\n"
#: Sections by number: the buckets, then these two.
RISKY, DUPLICATE = len(BUCKETS), len(BUCKETS) + 1
#: Report order within a section.
ORDER = ["bucket", "score", "path"]


def table_rows(rows: DataFrame) -> DataFrame:
    """(section, bucket, score, path, line): each note's table row, once for every section that holds it."""
    listed = lambda a, k: F.when(F.size(a) == 0, "none").otherwise(F.array_join(F.transform(a, lambda x: F.when(x["message"] == "", x[k]).otherwise(F.concat(x[k], F.lit(": "), x["message"]))), "<br>"))
    cells = [F.coalesce("note_link", "note_path"), F.coalesce(F.col("score").cast("string"), F.lit("n/a")), F.when(F.col("clean"), "yes").otherwise("no"), listed(F.col("findings"), "code"), listed(F.col("recommendations"), "mode")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(table_cell, cells)), F.lit(" |"))
    bucket = (F.array_position(F.array(*map(F.lit, BUCKETS)), scoring.bucket_key(F.col("priority"))) - 1).cast("int")
    risky, duplicate = F.coalesce(is_risky(), F.lit(False)), F.coalesce(scoring.has(F.col("findings"), "duplicate_overlap"), F.lit(False))
    sections = F.array_compact(F.array(bucket, F.when(risky, RISKY), F.when(duplicate, DUPLICATE)))
    rank, score, path = audit.report_order()
    return rows.select(F.explode(sections).alias("section"), rank.alias("bucket"), score.alias("score"), path.alias("path"), line.alias("line"))


def blocks(rows: DataFrame, manifest: dict) -> ordered.Blocks:
    """The report's text between its tables, and the numbers of these."""
    k = audit.kpis(rows).first()
    total, per = manifest["total_notes"], manifest["priority_counts"]
    share = f"{100 * k['no_change'] / total:.1f}%" if total else "0.0%"
    mean = "n/a" if k["mean_score"] is None else f"{k['mean_score']:.1f} / 100"
    judged = f"- Model judgment coverage: {k['reviewed']} / {total} reviewed; {k['pending']} pending" if k["reviewed"] or k["pending"] else "- Model judgment: not run; deterministic audit complete"
    head = [
        "# Atomic Note Audit", "", "## Summary", "", f"- Run ID: {manifest['run_id']}", f"- Total notes: {total}", f"- Average score: {mean}",
        f"- No-change notes: {k['no_change']} / {total} ({share})", "- Bucket counts: " + ", ".join(f"{'No changes' if b == 'no_change' else b} {per[b]}" for b in BUCKETS), judged,
    ]
    counted = audit.counts(rows).first()
    out: ordered.Blocks = ["\n".join(head) + "\n"]
    named = [*((SECTIONS[b], counted[b]) for b in BUCKETS), ("Factual-Risk Notes", k["risky"]), ("Duplicate Or Overlap Candidates", k["duplicates"])]
    for number, (title, n) in enumerate(named):
        out += [f"\n## {title}\n\n" + (TABLE if n else "- None\n"), *([number] if n else [])]
    figures = {**per, "risky": k["risky"], "duplicates": k["duplicates"]}
    steps = [f"- {text}: {figures[key]} note{'' if figures[key] == 1 else 's'}." for key, text in STEPS]
    return [*out, "\n## Remediation Next Steps\n\n" + "\n".join(steps) + "\n"]


def write(path: str, rows: DataFrame, manifest: dict) -> None:
    ordered.write(path, blocks(rows, manifest), table_rows(rows), ORDER)


def report(rows: DataFrame, manifest: dict) -> str:
    """The whole report as one text, for few rows."""
    return ordered.text(blocks(rows, manifest), table_rows(rows), ORDER)
