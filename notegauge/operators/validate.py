"""Validation as data: each row gets the array of its violations, in the order in which they are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions.text import WHITE, strip
from notegauge.vocab import BUCKETS, CACHE_STATUSES, CODES, DIMENSIONS, JUDGMENT_VERSION, MODES, ROW_STATUSES, VALIDATION_STATUSES

# The closed key sets of rows, manifests and judgments, and the longest excerpt.
EVIDENCE_WORDS = 40
ROW_REQUIRED = (
    "schema_version", "run_id", "row_status", "note_path", "note_link", "content_hash", "modified_time", "score", "priority", "clean", "pending_model", "dimensions", "findings",
    "recommendations", "model_judgment", "cache_status", "factual_risk", "fact_check_required", "config_snapshot", "doctrine_version", "rubric_version", "prompt_version",
)
ROW_OPTIONAL = ("created_time", "factual_risk_reason")
MANIFEST_REQUIRED = ("schema_version", "run_id", "started_at", "ended_at", "config_snapshot", "total_notes", "row_status_counts", "priority_counts", "validation_status", "outputs", "errors")
OUTPUTS = ("audit_rows", "model_judgments", "remediation_plan", "manifest")
JUDGMENT_REQUIRED = ("schema_version", "prompt_version", "note_path", "dimension_adjustments", "findings", "factual_risk", "factual_risk_reason", "fact_check_required", "evidence")
PLAN_MODES = tuple(sorted(set(MODES.values())))


def violations(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the checks that are true."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(what) if isinstance(what, str) else what) for test, what in checks]))


def closed_keys(json: Column, required: tuple, optional: tuple = ()) -> tuple[Column, Column]:
    """(missing, unknown) keys of a JSON object, sorted."""
    keys = F.json_object_keys(json)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, (*required, *optional)))))
    return missing, unknown


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def row_violations(rows: DataFrame, default_scan: bool = True) -> Column:
    """Of typed audit rows: what JSON typing alone does not rule out."""
    c = F.col
    link = F.trim(F.substring_index(F.expr("substring(note_link, 3, length(note_link) - 4)"), "|", 1))
    return violations(
        *[(blank(c(k)), f"{k} must be a non-empty string") for k in ("schema_version", "run_id", "note_path", "content_hash", "modified_time", "doctrine_version", "rubric_version", "prompt_version")],
        (~F.coalesce(c("row_status").isin(*ROW_STATUSES), F.lit(False)), F.concat(F.lit("Invalid row_status: "), F.coalesce("row_status", F.lit("null")))),
        ((c("row_status") == "skipped") & F.lit(default_scan), "Default Atomic Notes scans cannot skip rows"),
        (c("priority").isNotNull() & ~c("priority").isin(*BUCKETS[:4]), F.concat(F.lit("Invalid priority: "), c("priority"))),
        (~F.coalesce(c("cache_status").isin(*CACHE_STATUSES), F.lit(False)), F.concat(F.lit("Invalid cache_status: "), F.coalesce("cache_status", F.lit("null")))),
        (c("score").isNotNull() & ~c("score").between(1, 100), "score must be an integer from 1 to 100 or null"),
        *[(c(k).isNull(), f"{k} must be a boolean") for k in ("clean", "pending_model", "factual_risk", "fact_check_required")],
        *[(c("dimensions")[d].isNull() | ~c("dimensions")[d].between(0, 100), f"dimension {d} must be an integer from 0 to 100") for d in DIMENSIONS],
        (F.exists("findings", lambda f: ~F.coalesce(f["code"].isin(*CODES), F.lit(False))), "unknown finding code"),
        (F.exists("findings", lambda f: blank(f["message"])), "finding message must be a non-empty string"),
        (F.exists("recommendations", lambda r: ~F.coalesce(r["mode"].isin(*MODES.values()), F.lit(False))), "unknown recommendation mode"),
        *[(c(f"model_judgment.{k}").isNotNull() & (c(f"model_judgment.{k}") != c(k)), f"model_judgment.{k} mismatch") for k in ("note_path", "prompt_version")],
        (c("config_snapshot").isNull(), "config_snapshot must be an object"),
        (c("note_link").isNull() | ~c("note_link").rlike(r"(?s)^\[\[.*\]\]\z") | (link == ""), "note_link must be an Obsidian wikilink"),
        *[(c(k) == "", f"{k} must be a non-empty string") for k in ROW_OPTIONAL],
    )


def judgment_violations(prompt_version: str | None = None) -> Column:
    c = F.col
    worded = lambda e: F.size(F.filter(F.split(strip(e["excerpt"]), f"{WHITE}+"), lambda w: w != ""))
    bad = lambda e: blank(e["excerpt"]) | blank(e["reason"]) | (worded(e) > EVIDENCE_WORDS)
    return violations(
        (~c("schema_version").eqNullSafe(F.lit(JUDGMENT_VERSION)), F.lit(f"schema_version must be {JUDGMENT_VERSION}")),
        (blank(c("prompt_version")), "prompt_version must be a non-empty string"),
        (c("prompt_version") != prompt_version if prompt_version else F.lit(False), "prompt_version mismatch"),
        (blank(c("note_path")), "note_path must be a non-empty string"),
        *[(c(f"dimension_adjustments.{d}").isNotNull() & ~c(f"dimension_adjustments.{d}").between(-100, 100), f"dimension adjustment {d} must be from -100 to 100") for d in DIMENSIONS],
        (c("findings").isNull(), "findings must be a list"),
        (F.exists("findings", lambda f: ~F.coalesce(f["code"].isin(*CODES), F.lit(False))), "unknown finding code"),
        (F.exists("findings", lambda f: blank(f["message"])), "finding message must be a non-empty string"),
        (F.exists("findings", lambda f: F.exists(F.coalesce(f["evidence"], F.array()), bad)), f"evidence needs an excerpt of at most {EVIDENCE_WORDS} words and a reason"),
        (c("factual_risk").isNull(), "factual_risk must be a boolean"),
        (c("factual_risk") & blank(c("factual_risk_reason")), "factual_risk_reason is required when factual_risk is true"),
        (c("fact_check_required").isNull(), "fact_check_required must be a boolean"),
        (c("evidence").isNull(), "evidence must be a list"),
        (F.exists("evidence", bad), f"evidence needs an excerpt of at most {EVIDENCE_WORDS} words and a reason"),
    )


def json_violations(json: Column, required: tuple, optional: tuple = ()) -> Column:
    """Closed-schema checks of JSON text lines."""
    missing, unknown = closed_keys(json, required, optional)
    no_object = F.json_object_keys(json).isNull()
    return violations(
        (no_object, "row must be an object"),
        (~no_object & (F.size(missing) > 0), F.concat(F.lit("Missing required keys: "), F.array_join(missing, ", "))),
        (~no_object & (F.size(unknown) > 0), F.concat(F.lit("Unknown keys: "), F.array_join(unknown, ", "))),
    )


def pair_consistency(rows: DataFrame, manifest: dict) -> list[str]:
    """What the rows and their manifest disagree on, from one aggregate."""
    from notegauge.operators.audit import counts

    c = counts(rows).first()
    runs = [r[0] for r in rows.select("run_id").distinct().limit(2).collect()]
    out = []
    if any(r != manifest["run_id"] for r in runs):
        out.append("run_id differs")
    if c["total_notes"] != manifest["total_notes"]:
        out.append("total_notes differs")
    out += [f"row_status_counts.{s} differs" for s in ROW_STATUSES if c[s] != manifest["row_status_counts"][s]]
    return out + [f"priority_counts.{b} differs" for b in BUCKETS if c[b] != manifest["priority_counts"][b]]


def manifest_violations(manifest: dict) -> list[str]:
    """Of one manifest object (a driver-side dict)."""
    out = [f"Missing required keys: {', '.join(missing)}"] if (missing := sorted(set(MANIFEST_REQUIRED) - set(manifest))) else []
    out += [f"Unknown keys: {', '.join(extra)}"] if (extra := sorted(set(manifest) - set(MANIFEST_REQUIRED))) else []
    if out:
        return out
    out += [f"{k} must be a non-empty string" for k in ("schema_version", "run_id", "started_at", "ended_at") if not isinstance(manifest[k], str) or not manifest[k]]
    if type(manifest["total_notes"]) is not int or manifest["total_notes"] < 0:
        out.append("total_notes must be a non-negative integer")
    for key, names in (("row_status_counts", ROW_STATUSES), ("priority_counts", BUCKETS)):
        value = manifest[key]
        if not isinstance(value, dict) or set(value) != set(names) or any(type(x) is not int or x < 0 for x in value.values()):
            out.append(f"{key} must count {', '.join(names)}")
    if manifest["validation_status"] not in VALIDATION_STATUSES:
        out.append(f"Invalid validation_status: {manifest['validation_status']}")
    if not isinstance(manifest["outputs"], dict) or set(manifest["outputs"]) - set(OUTPUTS) or not all(isinstance(x, str) for x in manifest["outputs"].values()):
        out.append("outputs must map known names to strings")
    if not isinstance(manifest["errors"], list) or not all(isinstance(x, str) for x in manifest["errors"]):
        out.append("errors must be a list of strings")
    return out
