"""The deterministic audit: notes and parent links to audit rows, and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.functions.lexer import lexed
from notegauge.operators import rules, scoring
from notegauge.runtime import spread
from notegauge.schemas import AUDIT_ROW, JUDGMENT
from notegauge.vocab import BUCKETS, DOCTRINE_VERSION, FIXED_TIME, PROMPT_VERSION, ROW_STATUSES, RUBRIC_VERSION, SCHEMA_VERSION

RISK_REASON = "Contains factual claims that need verification."


def parent_targets(structure: DataFrame) -> DataFrame:
    """(target), distinct: the notes that structure notes (content) link to."""
    link = structure.select(F.explode(lexed("content", "links")["links"]).alias("link"))
    return link.select(X.link_target(F.col("link")).alias("target")).filter("target <> ''").distinct()


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def audit(notes: DataFrame, targets: DataFrame, run_id: str, config: dict[str, str], fixed: bool = False) -> DataFrame:
    """Audit rows of ``notes`` (note_path, stem, content, modified_time).

    The parent set is joined, not collected: Catalyst broadcasts it if it is small.
    Note text does not take part in the shuffle otherwise: findings are made first.
    """
    parsed = rules.parsed(spread(notes))
    found = parsed.select("note_path", "stem", "modified_time", X.content_hash(F.col("text")).alias("content_hash"), rules.findings(F.lit(True), F.col("stem")).alias("found"), F.col("frontmatter").isNull().alias("__no_front"), F.when(~F.col("best.present"), 1).otherwise(0).alias("__explained"))
    joined = found.join(targets.select(F.col("target").alias("stem"), F.lit(True).alias("has_parent")), "stem", "left")
    # missing_parent comes after frontmatter and explanation findings
    at = F.col("__no_front").cast("int") + F.col("__explained")
    orphan = F.array(F.struct(F.lit("missing_parent").alias("code"), F.lit(rules.MESSAGES["missing_parent"]).alias("message")))
    whole = F.when(F.col("has_parent"), F.col("found")).otherwise(F.concat(F.slice("found", F.lit(1), at), orphan, F.slice("found", at + 1, F.size("found"))))
    return rows(joined.withColumn("findings", whole), run_id, config, fixed)


def rows(df: DataFrame, run_id: str, config: dict[str, str], fixed: bool = False, pending: Column | None = None) -> DataFrame:
    """Audit rows of (note_path, stem, content_hash, modified_time, findings); ``pending`` says which still wait for a judgment, none if it is not given."""
    pending = F.lit(False) if pending is None else pending
    codes = scoring.codes(F.col("findings"))
    df = df.withColumn("score", scoring.score(scoring.loss(scoring.canonical(codes))))
    risk = scoring.has(F.col("findings"), "factual_risk")
    made = {
        "schema_version": F.lit(SCHEMA_VERSION), "run_id": F.lit(run_id), "row_status": F.lit("complete"), "note_link": F.concat(F.lit("[["), F.col("stem"), F.lit("]]")),
        "modified_time": F.lit(FIXED_TIME) if fixed else iso(F.col("modified_time")), "created_time": F.lit(None).cast("string"), "priority": scoring.bucket(F.col("score")),
        "clean": scoring.clean(F.col("score"), pending, risk), "pending_model": pending, "dimensions": scoring.dimensions(codes),
        "recommendations": scoring.recommendations(F.col("findings")), "model_judgment": F.lit(None).cast(JUDGMENT), "cache_status": F.lit("none"),
        "factual_risk": risk, "fact_check_required": risk, "factual_risk_reason": F.when(risk, RISK_REASON), "config_snapshot": scoring.literal_map(config) if config else F.create_map().cast("map<string,string>"),
        "doctrine_version": F.lit(DOCTRINE_VERSION), "rubric_version": F.lit(RUBRIC_VERSION), "prompt_version": F.lit(PROMPT_VERSION),
    }
    return df.select(*[(made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in AUDIT_ROW])


def counts(audit_rows: DataFrame) -> DataFrame:
    """One row: total, a count per status and per bucket (zeros included), and how many carry another value."""
    bucket = scoring.bucket_key(F.col("priority"))
    return audit_rows.agg(
        F.count("*").alias("total_notes"),
        *[F.count_if(F.col("row_status") == s).alias(s) for s in ROW_STATUSES],
        *[F.count_if(bucket == b).alias(b) for b in BUCKETS],
        F.count_if(~F.col("row_status").isin(*ROW_STATUSES)).alias("strange_status"),
        F.count_if(~bucket.isin(*BUCKETS)).alias("strange_bucket"),
    )


def manifest(audit_rows: DataFrame, run_id: str, config: dict[str, str], started_at: str, ended_at: str, outputs: dict[str, str], status: str = "not_run") -> dict:
    """The run manifest, from one aggregate."""
    c = counts(audit_rows).first().asDict()
    if c["strange_status"] or c["strange_bucket"]:
        raise ValueError(f"{c['strange_status']} rows with an unknown status, {c['strange_bucket']} with an unknown priority")
    return {
        "schema_version": SCHEMA_VERSION, "run_id": run_id, "started_at": started_at, "ended_at": ended_at, "config_snapshot": config, "total_notes": c["total_notes"],
        "row_status_counts": {s: c[s] for s in ROW_STATUSES}, "priority_counts": {b: c[b] for b in BUCKETS}, "validation_status": status, "outputs": outputs, "errors": [],
    }


def kpis(audit_rows: DataFrame) -> DataFrame:
    """One row of report figures: counts, mean score (null without scores) and the share that needs no change."""
    f = F.col("findings")
    risk = F.coalesce(F.col("factual_risk"), F.lit(False)) | F.coalesce(F.col("fact_check_required"), F.lit(False)) | scoring.has(f, "factual_risk")
    return audit_rows.agg(
        F.count("*").alias("total"), F.avg("score").alias("mean_score"), F.count_if(F.col("priority").isNull()).alias("no_change"),
        F.when(F.count("*") == 0, 0.0).otherwise(100.0 * F.count_if(F.col("priority").isNull()) / F.count("*")).alias("no_change_percent"),
        F.count_if(F.col("model_judgment").isNotNull()).alias("reviewed"), F.count_if("pending_model").alias("pending"),
        F.count_if(risk).alias("risky"), F.count_if(scoring.has(f, "duplicate_overlap")).alias("duplicates"),
    )


def report_order() -> list[Column]:
    """Bucket, score (unscored last), path."""
    return [scoring.bucket_rank(F.col("priority")), F.coalesce("score", F.lit(101)), F.coalesce(F.nullif("note_path", F.lit("")), "note_link")]


def ordered(audit_rows: DataFrame) -> DataFrame:
    """Rows in the order of the report."""
    return audit_rows.orderBy(*report_order())
