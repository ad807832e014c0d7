"""The closed contracts of audit rows and judgments, checked on JSON text before any typing.

Typed reading turns a wrong type into null or text, so it cannot tell what a line held.
Here a line is parsed to a variant and every check asks for the type that is there. A
check is an array of messages; where a key is missing or unknown, nothing below it is
checked, so the first message is the one that a reader of the line meets first. The
messages are fixed values: readers of the reports know them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegauge.functions.text import WHITE, let, strip
from notegauge.operators.validate import EVIDENCE_WORDS, JUDGMENT_REQUIRED, ROW_OPTIONAL, ROW_REQUIRED
from notegauge.vocab import BUCKETS, CACHE_STATUSES, CODES, DIMENSIONS, JUDGMENT_VERSION, MODES, ROW_STATUSES

Label = str | Column


def says(label: Label, what: str) -> Column:
    return F.concat(label if isinstance(label, Column) else F.lit(label), F.lit(what))


def below(label: Label, key: str) -> Label:
    return says(label, f".{key}") if isinstance(label, Column) else f"{label}.{key}" if label else key


def when(wrong: Column, message: Column) -> Column:
    """One message, or none."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(message)).otherwise(F.array().cast("array<string>"))


def every(*checks: Column) -> Column:
    return F.concat(*checks)


def kind(v: Column) -> Column:
    """The type of a variant; null for a null column."""
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number(v: Column) -> Column:
    """A whole number written as one (true, 1.0 and "1" are none); null otherwise."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def is_null(v: Column) -> Column:
    return kind(v) == "VOID"


def members_of(v: Column, otherwise: Column, inside: Callable[[Column], Column]) -> Column:
    """What ``inside`` says of the members of an object, or ``otherwise`` of anything else."""
    return F.when(F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False)), let(F.try_variant_get(v, "$", "map<string,variant>"), inside)).otherwise(otherwise)


def object_of(v: Column, label: Label, required: tuple, optional: tuple, inside: Callable[[Column], Column], at: str = "") -> Column:
    """Checks of an object with these keys; ``inside`` gets its members. ``at`` stands before the list of missing keys."""

    def members(m: Column) -> Column:
        keys = F.map_keys(m)
        missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), keys))
        unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, (*required, *optional))).cast("array<string>")))
        return (
            F.when(F.size(missing) > 0, F.array(F.concat(says(label, at) if at else F.lit("Missing required keys: "), F.array_join(missing, ", "))))
            .when(F.size(unknown) > 0, F.array(F.concat(says(label, " has unsupported keys: "), F.array_join(unknown, ", "))))
            .otherwise(inside(m))
        )

    return F.when(F.startswith(kind(v), F.lit("OBJECT")), let(F.try_variant_get(v, "$", "map<string,variant>"), members)).otherwise(F.array(says(label, " must be an object")))


def array_of(v: Column, label: Label, each: Callable[[Column, Column], Column]) -> Column:
    """Checks of a list; ``each`` gets an element and its label."""
    at = lambda i: F.concat(label if isinstance(label, Column) else F.lit(label), F.lit("["), i.cast("string"), F.lit("]"))
    elements = F.try_variant_get(v, "$", "array<variant>")
    return F.when(F.startswith(kind(v), F.lit("ARRAY")), F.flatten(F.transform(elements, lambda x, i: each(x, at(i))))).otherwise(F.array(says(label, " must be an array")))


def filled(v: Column, label: Label) -> Column:
    return when((kind(v) != "STRING") | (text(v) == ""), says(label, " must be a non-empty string"))


def boolean(v: Column, label: Label) -> Column:
    return when(kind(v) != "BOOLEAN", says(label, " must be a boolean"))


def shown(v: Column) -> Column:
    return F.when(is_null(v), F.lit("None")).otherwise(F.coalesce(text(v), F.to_json(v)))


def one_of(v: Column, values: tuple, label: Label, null: bool = False) -> Column:
    known = (kind(v) == "STRING") & text(v).isin(*values)
    return when(~F.coalesce(known | (is_null(v) & F.lit(null)), F.lit(False)), F.concat(says("Invalid ", ""), label if isinstance(label, Column) else F.lit(label), F.lit(": "), shown(v)))


def within(v: Column, low: int, high: int, label: Label, what: str, null: bool = False) -> Column:
    fits = F.coalesce(number(v).between(low, high), F.lit(False)) | (is_null(v) & F.lit(null))
    return when(~fits, says(label, what))


def finding_code(v: Column, label: Label) -> Column:
    return F.when(F.coalesce((kind(v) == "STRING") & (text(v) != ""), F.lit(False)), one_of(v, CODES, label)).otherwise(filled(v, label))


def evidence(v: Column, label: Label) -> Column:
    def item(x: Column, at: Column) -> Column:
        def members(m: Column) -> Column:
            words = F.size(F.filter(F.split(strip(text(m["excerpt"])), f"{WHITE}+"), lambda w: w != ""))
            return every(
                when(kind(m["excerpt"]) != "STRING", says(at, ".excerpt must be a string")),
                filled(m["reason"], says(at, ".reason")),
                F.when(kind(m["excerpt"]) == "STRING", when(words > EVIDENCE_WORDS, says(at, f".excerpt must be {EVIDENCE_WORDS} words or fewer"))).otherwise(F.array().cast("array<string>")),
            )

        return object_of(x, at, ("excerpt", "reason"), (), members, " missing required keys: ")

    return array_of(v, label, item)


def judgment(v: Column, label: str = "model_judgment") -> Column:
    """Messages of one judgment."""

    def members(m: Column) -> Column:
        def finding(x: Column, at: Column) -> Column:
            inside = lambda f: every(
                finding_code(f["code"], says(at, ".code")), filled(f["message"], says(at, ".message")),
                F.when(F.map_contains_key(f, "evidence"), evidence(f["evidence"], says(at, ".evidence"))).otherwise(F.array().cast("array<string>")),
            )
            return object_of(x, at, ("code", "message"), ("evidence",), inside, " missing required keys: ")

        def adjusted(a: Column) -> Column:
            return every(*[F.when(F.map_contains_key(a, d), within(a[d], -100, 100, f"{label}.dimension_adjustments.{d}", " must be an integer from -100 to 100")).otherwise(F.array().cast("array<string>")) for d in DIMENSIONS])

        reason, risk = m["factual_risk_reason"], m["factual_risk"]
        return every(
            when((kind(m["schema_version"]) != "STRING") | (text(m["schema_version"]) != JUDGMENT_VERSION), F.lit(f"{label}.schema_version must be {JUDGMENT_VERSION}")),
            filled(m["prompt_version"], f"{label}.prompt_version"),
            filled(m["note_path"], f"{label}.note_path"),
            object_of(m["dimension_adjustments"], f"{label}.dimension_adjustments", (), DIMENSIONS, adjusted),
            array_of(m["findings"], f"{label}.findings", finding),
            boolean(risk, f"{label}.factual_risk"),
            F.when(is_null(reason), when(F.coalesce(F.try_variant_get(risk, "$", "boolean"), F.lit(False)), F.lit(f"{label}.factual_risk_reason must explain factual_risk"))).otherwise(filled(reason, f"{label}.factual_risk_reason")),
            boolean(m["fact_check_required"], f"{label}.fact_check_required"),
            evidence(m["evidence"], f"{label}.evidence"),
        )

    return object_of(v, label, JUDGMENT_REQUIRED, (), members, " missing required keys: ")


def audit_row(v: Column, default_scan: bool = True) -> Column:
    """Messages of one audit row, in the order in which a reader checks it."""

    def members(m: Column) -> Column:
        finding = lambda x, at: object_of(x, at, ("code", "message"), (), lambda f: every(finding_code(f["code"], says(at, ".code")), filled(f["message"], says(at, ".message"))))
        advice = lambda x, at: object_of(x, at, ("mode", "message"), (), lambda f: every(one_of(f["mode"], tuple(sorted(set(MODES.values()))), says(at, ".mode")), filled(f["message"], says(at, ".message"))))
        scores = lambda d: every(*[within(d[k], 0, 100, f"dimensions.{k}", " must be an integer from 0 to 100") for k in sorted(DIMENSIONS)])

        def embedded(j: Column) -> Column:
            inner = F.try_variant_get(j, "$", "map<string,variant>")
            same = lambda k: when(text(inner[k]) != text(m[k]), F.concat(F.lit(f"model_judgment.{k} mismatch: expected '"), text(m[k]), F.lit("', got '"), text(inner[k]), F.lit("'")))
            return let(judgment(j), lambda found: F.when(F.size(found) > 0, found).otherwise(every(same("note_path"), same("prompt_version"))))

        link = text(m["note_link"])
        target = F.trim(F.substring_index(F.substring(link, F.lit(3), F.greatest(F.lit(0), F.length(link) - 4)), "|", 1))
        linked = (kind(m["note_link"]) == "STRING") & link.startswith("[[") & link.endswith("]]") & (target != "")
        none = F.array().cast("array<string>")
        return every(
            *[filled(m[k], k) for k in ("schema_version", "run_id", "note_path", "content_hash", "modified_time", "doctrine_version", "rubric_version", "prompt_version")],
            one_of(m["row_status"], ROW_STATUSES, "row_status"),
            when((text(m["row_status"]) == "skipped") & F.lit(default_scan), F.lit("Default Atomic Notes scans cannot skip rows")),
            one_of(m["priority"], BUCKETS[:4], "priority", null=True),
            one_of(m["cache_status"], CACHE_STATUSES, "cache_status"),
            within(m["score"], 1, 100, "score", " must be an integer from 1 to 100 or null", null=True),
            boolean(m["clean"], "clean"),
            boolean(m["pending_model"], "pending_model"),
            object_of(m["dimensions"], "dimensions", DIMENSIONS, (), scores),
            array_of(m["findings"], "findings", finding),
            array_of(m["recommendations"], "recommendations", advice),
            F.when(is_null(m["model_judgment"]), none).otherwise(let(m["model_judgment"], embedded)),
            boolean(m["factual_risk"], "factual_risk"),
            boolean(m["fact_check_required"], "fact_check_required"),
            when(~F.startswith(kind(m["config_snapshot"]), F.lit("OBJECT")), F.lit("config_snapshot must be an object")),
            when(~F.coalesce(linked, F.lit(False)), F.lit("note_link must be an Obsidian wikilink")),
            *[F.when(F.map_contains_key(m, k), filled(m[k], k)).otherwise(none) for k in ROW_OPTIONAL],
        )

    return object_of(v, "row", ROW_REQUIRED, ROW_OPTIONAL, members)


def line(value: Column, contract: Callable[[Column], Column]) -> Column:
    """Messages of a line of JSON Lines: what is no JSON is said so, else what the contract says."""
    return let(F.try_parse_json(value), lambda v: F.when(v.isNull(), F.array(F.lit("not valid JSON"))).otherwise(contract(v)))
