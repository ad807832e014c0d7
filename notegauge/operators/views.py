"""Saved triage views: which rows each view holds, and the view file."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.operators import scoring
from notegauge.sources import ordered


def is_risky():
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flag("factual_risk") | flag("fact_check_required") | scoring.has(F.col("findings"), "factual_risk")


def queue(rows: DataFrame, bucket: str) -> DataFrame:
    if bucket not in scoring.BUCKETS:
        raise ValueError(f"unknown bucket: {bucket}")
    return rows.filter(scoring.bucket_key(F.col("priority")) == bucket)


def tests() -> dict:
    has = lambda code: scoring.has(F.col("findings"), code)
    return {
        "All Audited Notes": F.lit(True), "P0 Critical": F.col("priority") == "P0", "P1 High Impact": F.col("priority") == "P1", "P2 Improvements": F.col("priority") == "P2",
        "P3 Polish": F.col("priority") == "P3", "No Changes": F.col("priority").isNull(), "Factual Risk": is_risky(), "Multi-Note Split Candidates": has("multi_note"),
        "Missing Parent Candidates": has("missing_parent"), "Duplicate Or Overlap Candidates": has("duplicate_overlap"),
    }


def saved_views(rows: DataFrame) -> DataFrame:
    """(view, note_path): one pass over the rows, a row per view that holds a note."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(v)) for v, t in tests().items()]))
    return rows.select(F.explode(names).alias("view"), "note_path")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def yaml_quoted(text: Column) -> Column:
    """quoted() of a column."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


ORDER = ["line"]


def listed(rows: DataFrame) -> DataFrame:
    """(section, line): the paths of each view, by its number."""
    number = F.array_position(F.array(*map(F.lit, tests())), F.col("view")) - 1
    return saved_views(rows).select(number.cast("int").alias("section"), F.col("note_path").alias("line"))


def entry(note_path: str) -> str:
    return "        - " + quoted("file.path == " + json.dumps(note_path))


def blocks(rows: DataFrame, source: str) -> ordered.Blocks:
    """The text of the view file over the rows of ``source`` between its lists of paths, and the numbers of these."""
    head = [  # fixed values: the head of a view file
        "# Generated from validated audit JSONL. This Base is a derived triage view, not source of truth.", "formulas:",
        f"  source_jsonl: {quoted(json.dumps(source))}", "properties:", "  formula.source_jsonl:", '    displayName: "Source JSONL"', "  file.path:", '    displayName: "Note Path"', "views:",
    ]
    counts = {r["view"]: r["count"] for r in saved_views(rows).groupBy("view").count().collect()}  # at most as many rows as views
    out: ordered.Blocks = ["\n".join(head) + "\n"]
    for number, view in enumerate(tests()):
        n = counts.get(view, 0)
        out.append(f"  - type: table\n    name: {json.dumps(view)}\n    filters:\n      {'and' if n < 2 else 'or'}:\n")
        out += [number] if n else [entry("__no_matching_audit_rows__") + "\n"]
        out.append("    order:\n      - file.name\n      - file.path\n      - formula.source_jsonl\n")
    return out


def write(path: str, rows: DataFrame, source: str) -> None:
    ordered.write(path, blocks(rows, source), listed(rows), ORDER, entry)


def view_file(rows: DataFrame, source: str) -> str:
    """The whole view file as one text, for few rows."""
    return ordered.text(blocks(rows, source), listed(rows), ORDER, entry)
