"""Incremental audits: notes that did not change keep what an earlier run found.

A row of the last run holds as long as its note's content hash and the versions of
doctrine, rubric and schema are the same, and for judged rows that of the prompt. Only
its parent finding depends on anything else, and that is known without lexing: it is
put in or taken out where the parent set has changed. So the lexer and the rules run
over new and changed notes alone.

cache_status says what came from the last run: ``hit`` the whole row, ``partial`` a part
of it (findings with another parent finding, or a judgment joined to a fresh audit),
``miss`` nothing. row_status is ``reused_cache`` where the text was not audited again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.operators import judgments, rules, scoring
from notegauge.operators.audit import audit, iso, rows
from notegauge.runtime import scratch
from notegauge.schemas import AUDIT_ROW
from notegauge.vocab import DOCTRINE_VERSION, FIXED_TIME, PROMPT_VERSION, RUBRIC_VERSION, SCHEMA_VERSION

#: Findings that come before missing_parent.
EARLIER = ("missing_frontmatter", "definition_too_long", "invalid_dae")


def standing(previous: DataFrame) -> DataFrame:
    """(note_path, old): the rows of a run whose findings still hold under the versions of today."""
    c = F.col
    same = (c("schema_version") == SCHEMA_VERSION) & (c("doctrine_version") == DOCTRINE_VERSION) & (c("rubric_version") == RUBRIC_VERSION)
    judged = c("model_judgment").isNull() | (c("prompt_version") == PROMPT_VERSION)
    whole = c("row_status").isin("complete", "reused_cache")
    return previous.filter(same & judged & whole).select("note_path", F.struct(*[f.name for f in AUDIT_ROW]).alias("old"))


def decided(notes: DataFrame, targets: DataFrame, previous: DataFrame) -> DataFrame:
    """(note_path, stem, modified_time, content_hash, orphan, old, reuse): per note what of the last run it can use.

    ``reuse`` is hit, findings (all but the parent finding), judgment or none. No text leaves the scan.
    """
    known = notes.select("note_path", "stem", "modified_time", X.content_hash(X.normalized(F.coalesce("content", F.lit("")))).alias("content_hash"))
    known = known.join(targets.select(F.col("target").alias("stem"), F.lit(True).alias("__parent")), "stem", "left").withColumn("orphan", F.col("__parent").isNull())
    both = known.join(standing(previous), "note_path", "left")
    had = scoring.has(F.col("old.findings"), "missing_parent")
    same = F.coalesce(F.col("old.content_hash") == F.col("content_hash"), F.lit(False))
    reuse = F.when(~same, "none").when(had == F.col("orphan"), "hit").when(F.col("old.model_judgment").isNull(), "findings").otherwise("judgment")
    return both.select("note_path", "stem", "modified_time", "content_hash", "orphan", F.when(same, F.col("old")).alias("old"), reuse.alias("reuse"))


def audit_reusing(notes: DataFrame, targets: DataFrame, previous: DataFrame | None, run_id: str, config: dict[str, str], fixed: bool = False) -> DataFrame:
    """Audit rows of ``notes`` as audit() makes them, reusing the rows of ``previous``, an earlier run over any notes.

    Paths are unique on both sides. Notes that are gone have no row. Without an earlier run this is audit().
    """
    if previous is None:
        return audit(notes, targets, run_id, config, fixed)
    spark = notes.sparkSession
    path = scratch(spark)
    plan = decided(notes, targets, previous)
    plan.write.parquet(path)  # four readings follow, and hashing is a pass over all texts
    plan = spark.read.schema(plan.schema).parquet(path)
    time = F.lit(FIXED_TIME) if fixed else iso(F.col("modified_time"))
    snapshot = scoring.literal_map(config) if config else F.create_map().cast("map<string,string>")

    now = {"run_id": F.lit(run_id), "modified_time": time, "config_snapshot": snapshot, "prompt_version": F.lit(PROMPT_VERSION), "row_status": F.lit("reused_cache"), "cache_status": F.lit("hit")}
    hit = plan.filter("reuse = 'hit'").select(*[(now[f.name] if f.name in now else F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name) for f in AUDIT_ROW])

    found = F.filter("old.findings", lambda f: f["code"] != "missing_parent")
    before = F.size(F.filter(found, lambda f: f["code"].isin(*EARLIER)))
    orphan = F.array(F.struct(F.lit("missing_parent").alias("code"), F.lit(rules.MESSAGES["missing_parent"]).alias("message")))
    adjusted = F.when(F.col("orphan"), F.concat(F.slice(found, F.lit(1), before), orphan, F.slice(found, before + 1, F.size(found)))).otherwise(found)
    moved = plan.filter("reuse = 'findings'").select("note_path", "stem", "content_hash", "modified_time", adjusted.alias("findings"), F.col("old.pending_model").alias("__pending"))
    partial = rows(moved, run_id, config, fixed, pending=F.col("__pending")).withColumns({"row_status": F.lit("reused_cache"), "cache_status": F.lit("partial")})

    again = plan.filter("reuse in ('none', 'judgment')").select("note_path")
    fresh = audit(notes.join(again, "note_path", "left_semi"), targets, run_id, config, fixed)
    judged = plan.filter("reuse = 'judgment'").select("old.model_judgment.*")
    merged = judgments.merge(fresh, judged)
    with_judgment = F.col("model_judgment").isNotNull()
    # rows without a judgment of old are new ones, and not pending until judgments are merged
    fresh = merged.withColumns({"cache_status": F.when(with_judgment, "partial").otherwise("miss"), "pending_model": F.lit(False), "clean": F.when(with_judgment, F.col("clean")).otherwise(scoring.clean(F.col("score"), F.lit(False), F.col("fact_check_required")))})
    return hit.unionByName(partial.select(*hit.columns)).unionByName(fresh.select(*hit.columns))
