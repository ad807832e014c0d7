"""Remediation plans: validation, dry-run manifests and split proposals."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.functions.lexer import lexed
from notegauge.operators import contracts as C

# What a plan may hold.
OPERATIONS = ("edit", "split", "delete", "rename", "move", "relink")
DESTRUCTIVE = ("split", "delete", "rename", "move")
PLAN_KEYS = ("plan_version", "audit_run_id", "mode", "operations")

OUTPUT_KEYS = ("note_path", "content")


def operation_violations(index: Column, operation: Column, destructive_allowed: bool) -> Column:
    """Messages of one operation of a plan (a variant), in the order in which they are checked.

    Of an operation that is no object, or that states no known operation, nothing more is asked.
    """
    at = lambda text: F.concat(F.lit("Operation "), index.cast("string"), F.lit(f" {text}"))
    split = lambda text: F.concat(F.lit("Split operation "), index.cast("string"), F.lit(f" {text}"))
    none = F.array().cast("array<string>")

    def output(o: Column, i: Column) -> Column:
        of = F.concat(F.lit("Split operation "), index.cast("string"), F.lit(" output "), i.cast("string"))
        lacking = lambda m: C.every(*[C.when((C.kind(m[k]) != "STRING") | (C.text(m[k]) == ""), F.concat(of, F.lit(f" requires {k}"))) for k in OUTPUT_KEYS])
        return C.members_of(o, F.array(F.concat(of, F.lit(" must be an object"))), lacking)

    def outputs(v: Column) -> Column:
        each = F.try_variant_get(v, "$", "array<variant>")
        listed = F.startswith(C.kind(v), F.lit("ARRAY")) & (F.size(each) > 0)
        return F.when(F.coalesce(listed, F.lit(False)), F.flatten(F.transform(each, output))).otherwise(F.array(split("requires proposed_outputs")))

    def checks(m: Column) -> Column:
        name = C.text(m["operation"])
        true = lambda k: F.coalesce((C.kind(m[k]) == "BOOLEAN") & F.try_variant_get(m[k], "$", "boolean"), F.lit(False))
        named = C.every(
            F.when(name.isin(*DESTRUCTIVE), C.every(C.when(F.lit(not destructive_allowed), at("is destructive")), C.when(~true("approved"), at("requires approval")))).otherwise(none),
            F.when(name == "split", C.every(C.when(~true("delete_original"), split("must state delete_original=true")), outputs(m["proposed_outputs"]))).otherwise(none),
        )
        stated = F.coalesce(C.kind(m["operation"]) == "STRING", F.lit(False))
        return C.every(
            C.when(F.map_contains_key(m, "operation_type"), at("uses unsupported operation_type")),
            F.when(~stated, F.array(at("must state operation"))).when(~name.isin(*OPERATIONS), F.array(at("has unsupported operation"))).otherwise(named),
        )

    return C.members_of(operation, F.array(at("must be an object")), checks)


def plan_messages(plan: Column, destructive_allowed: bool = False) -> Column:
    """Messages of a whole plan (a variant): its keys, its list of operations, and each operation by its index."""

    def checks(m: Column) -> Column:
        missing = F.filter(F.array(*map(F.lit, PLAN_KEYS)), lambda k: ~F.map_contains_key(m, k))
        operations = m["operations"]
        each = F.try_variant_get(operations, "$", "array<variant>")
        return (
            F.when(F.size(missing) > 0, F.transform(missing, lambda k: F.concat(F.lit("Missing plan key: "), k)))
            .when(~F.coalesce(F.startswith(C.kind(operations), F.lit("ARRAY")), F.lit(False)), F.array(F.lit("operations must be a list")))
            .otherwise(F.flatten(F.transform(each, lambda o, i: operation_violations(i, o, destructive_allowed))))
        )

    return C.members_of(plan, F.array(F.lit("plan must be an object")), checks)


def plan_violations(plans: DataFrame, destructive_allowed: bool = False) -> DataFrame:
    """(plan_id, violations) of the plans (plan_id, plan: JSON text) that break their contract; what is no JSON says so."""
    return plans.select("plan_id", C.line(F.col("plan"), lambda v: plan_messages(v, destructive_allowed)).alias("violations")).filter(F.size("violations") > 0)


def dry_run(plan: dict) -> dict:
    """What a plan would do; nothing is executed."""
    return {
        "schema_version": "1.0.0", "audit_run_id": plan["audit_run_id"], "mode": plan["mode"], "operation_count": len(plan["operations"]),
        "generated_at": datetime.now(timezone.utc).isoformat(), "operations": [dict(o) for o in plan["operations"]], "executed": False,
    }


def split_proposals(notes: DataFrame) -> DataFrame:
    """(source_note_path, pos, note_path, content): a note per level-1 heading, down to the next one."""
    body = X.body(F.col("content"))
    df = notes.select("note_path", body.alias("body"), F.filter(lexed("content", "headings")["headings"], lambda h: h["level"] == 1).alias("tops"))
    df = df.withColumn("rows", F.split("body", "\n"))
    one = df.select("note_path", "rows", "tops", F.posexplode("tops").alias("pos", "top"))
    stop = F.coalesce(F.get("tops", F.col("pos") + 1)["line"], F.size("rows"))
    text = F.array_join(F.slice("rows", F.col("top.line") + 1, stop - F.col("top.line")), "\n")
    name = F.concat(F.lit("Atomic Notes/"), F.replace(F.col("top.text"), F.lit("/"), F.lit("-")), F.lit(".md"))
    return one.select(F.col("note_path").alias("source_note_path"), "pos", name.alias("note_path"), F.concat(X.strip(text), F.lit("\n")).alias("content"))
