"""Joining externally produced judgments to audit rows, with provenance checks as anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.operators import scoring
from notegauge.operators.audit import RISK_REASON
from notegauge.schemas import AUDIT_ROW, JUDGMENT
from notegauge.vocab import JUDGMENT_VERSION, PROMPT_VERSION


def missing(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    return rows.join(judgments.select("note_path"), "note_path", "left_anti")


def extra(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    return judgments.join(rows.select("note_path"), "note_path", "left_anti")


def prompt_mismatches(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """(note_path, expected, got) where a judgment answers another prompt version."""
    j = judgments.select("note_path", F.col("prompt_version").alias("got"))
    return rows.select("note_path", F.col("prompt_version").alias("expected")).join(j, "note_path").filter("expected <> got")


def duplicates(df: DataFrame, key: str = "note_path") -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def unfinished(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: the rows without a result yet; results of no row are an error."""
    require(done.join(rows.select("note_path"), "note_path", "left_anti"), "completed judgment without a selected row")
    return missing(rows, done)


def require(violations: DataFrame, what: str, key: str = "note_path") -> None:
    """Raise, naming the smallest key, if there is any violation; a null key is one as well."""
    first, count = violations.agg(F.min(key), F.count("*")).first()
    if count:
        raise ValueError(f"{what}: {first}")


def check(rows: DataFrame, judgments: DataFrame, allow_missing: bool = False) -> None:
    """Raise for the first kind of thing that is wrong, naming its smallest path; all kinds are found by one full join. A null path matches none."""
    told = judgments.groupBy("note_path").agg(F.count("*").alias("n"), F.collect_set(F.coalesce("prompt_version", F.lit(""))).alias("got"))
    asked = rows.select(F.col("note_path").alias("__path"), "prompt_version")
    both = asked.join(told, F.col("__path") == F.col("note_path"), "full")
    row, judged = F.col("prompt_version").isNotNull() | F.col("__path").isNotNull(), F.col("n").isNotNull()
    other = F.exists("got", lambda v: v != F.col("prompt_version"))
    kinds = [
        ("duplicate model judgment note_path", judged & (F.col("n") > 1), "note_path"), ("judgment for a note that was not audited", judged & ~row, "note_path"),
        ("prompt_version mismatch", row & judged & other, "note_path"), *([] if allow_missing else [("missing model judgment", row & ~judged, "__path")]),
    ]
    found = both.agg(*[f(F.when(F.coalesce(test, F.lit(False)), F.struct(F.col(path).alias("path")))) for _, test, path in kinds for f in (F.min, F.count)]).first()
    for (what, _, _), first, count in zip(kinds, found[::2], found[1::2]):
        if count:
            raise ValueError(f"{what}: {first['path']}")


def merge(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rows with their judgments applied; rows without one are pending."""
    j = judgments.select(F.col("note_path").alias("__path"), F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JUDGMENT]).alias("j"))
    df = rows.join(j, rows["note_path"] == F.col("__path"), "left")
    both = scoring.combined(F.col("findings"), F.col("j.findings"))
    df = df.withColumn("__new", F.when(F.col("j").isNotNull(), scoring.with_risk(both, F.col("j.factual_risk"))))
    judged, new = F.col("j").isNotNull(), F.col("__new")
    risk = scoring.has(new, "factual_risk")
    df = df.withColumn("__score", scoring.score(scoring.loss(scoring.codes(new)))).withColumn("__check", risk | F.col("j.fact_check_required"))
    pick = {
        "score": F.col("__score"), "priority": scoring.bucket(F.col("__score")), "clean": scoring.clean(F.col("__score"), F.lit(False), F.col("__check")), "pending_model": F.lit(False),
        "dimensions": scoring.adjusted(F.col("dimensions"), F.col("j.dimension_adjustments")), "findings": new, "recommendations": scoring.recommendations(new), "model_judgment": F.col("j"),
        "cache_status": F.lit("miss"), "factual_risk": risk, "fact_check_required": F.col("__check"),
        "factual_risk_reason": F.when(F.col("__check"), F.coalesce("j.factual_risk_reason", "factual_risk_reason", F.lit(RISK_REASON))),
    }
    kept = {"pending_model": F.lit(True), "clean": F.lit(False)}
    return df.select(*[F.when(judged, pick[f.name]).otherwise(kept.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name) if f.name in pick else F.col(f.name) for f in AUDIT_ROW])


def stamped(responses: DataFrame) -> DataFrame:
    """Provenance is ours to give: schema and prompt versions override what came back."""
    return responses.withColumns({"schema_version": F.lit(JUDGMENT_VERSION), "prompt_version": F.lit(PROMPT_VERSION)})


def positional(batch_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows and responses of each batch side by side by position (batch_id, pos, expected, got, ok); either may be short."""
    left = batch_rows.select("batch_id", "pos", F.col("note_path").alias("expected"))
    right = responses.select("batch_id", "pos", F.col("note_path").alias("got"))
    return left.join(right, ["batch_id", "pos"], "full").withColumn("ok", F.col("expected").eqNullSafe(F.col("got")))
