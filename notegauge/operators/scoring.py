"""Scores, buckets, dimensions and recommendations from findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegauge.functions.text import let, ordered_distinct
from notegauge.vocab import BUCKETS, CODES, COMPONENT_CAP, COMPONENT_CODES, DIMENSIONS, LOSSES, MESSAGES, MODES, PENALTIES, RETAINED_CODES


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def canonical(codes: Column) -> Column:
    """Distinct codes in order; a code that includes others drops them; unknown codes are an error."""

    def checked(known: Column) -> Column:
        strange = F.array_except(known, literals(CODES))
        return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown finding code: "), F.array_join(strange, ", "))).cast("array<string>")).otherwise(F.array_distinct(known))

    def pruned(known: Column) -> Column:
        covered = F.when(F.array_contains(known, "invalid_dae"), literals(COMPONENT_CODES)).otherwise(F.array().cast("array<string>"))
        single = F.array_contains(known, "multi_note")
        return F.filter(known, lambda c: ~F.array_contains(covered, c) & ~(single & (c == "not_atomic")))

    return let(let(F.filter(codes, lambda c: c.isNotNull() & (c != "")), checked), pruned)


def total(codes: Column, values: Column) -> Column:
    return F.aggregate(codes, F.lit(0), lambda s, c: s + F.coalesce(values[c], F.lit(0)))


def loss(codes: Column) -> Column:
    """Loss of canonical codes; the explanation's components together lose at most the cap."""
    part = lambda c: c.isin(*COMPONENT_CODES)
    return let(codes, lambda v: total(F.filter(v, lambda c: ~part(c)), literal_map(LOSSES)) + F.least(total(F.filter(v, part), literal_map(LOSSES)), F.lit(COMPONENT_CAP)))


def score(loss: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), 100 - loss))


def bucket(score: Column) -> Column:
    """Priority of a score, null if nothing needs to change."""
    return F.when(score < 50, "P0").when(score < 70, "P1").when(score < 85, "P2").when(score < 100, "P3")


def bucket_key(priority: Column) -> Column:
    return F.coalesce(priority, F.lit("no_change"))


def bucket_rank(priority: Column) -> Column:
    return F.array_position(literals(BUCKETS), bucket_key(priority))


def clean(score: Column, pending: Column, check: Column) -> Column:
    return (score == 100) & ~pending & ~check


def dimensions(codes: Column) -> Column:
    """All penalties count, repeats too; no dimension falls below zero."""
    return F.struct(*[F.greatest(F.lit(0), 100 - total(codes, literal_map({c: p.get(d, 0) for c, p in PENALTIES.items()}))).alias(d) for d in DIMENSIONS])


def adjusted(dims: Column, changes: Column) -> Column:
    return F.struct(*[F.greatest(F.lit(0), F.least(F.lit(100), dims[d] + F.coalesce(changes[d], F.lit(0)))).alias(d) for d in DIMENSIONS])


def recommendations(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.struct(literal_map(MODES)[f["code"]].alias("mode"), f["message"].alias("message")))


def codes(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["code"])


def has(findings: Column, code: str) -> Column:
    return F.exists(findings, lambda f: f["code"] == code)


def canonical_findings(findings: Column) -> Column:
    return let(findings, lambda v: let(canonical(codes(v)), lambda kept: F.filter(v, lambda f: F.array_contains(kept, f["code"]))))


def combined(base: Column, judged: Column) -> Column:
    """Retained findings, then the judged ones; the first message of a code wins; evidence is dropped."""
    plain = lambda a: F.transform(a, lambda f: F.struct(f["code"].alias("code"), f["message"].alias("message")))
    retained = F.filter(plain(base), lambda f: f["code"].isin(*RETAINED_CODES))
    every = F.filter(F.concat(retained, plain(judged)), lambda f: f["code"].isNotNull() & f["message"].isNotNull())
    return canonical_findings(ordered_distinct(every, lambda f: f["code"]))


def with_risk(findings: Column, flagged: Column) -> Column:
    """A flag without a finding adds the finding."""
    extra = F.array(F.struct(F.lit("factual_risk").alias("code"), F.lit(MESSAGES["factual_risk"]).alias("message")))
    return let(findings, lambda v: F.when(flagged & ~has(v, "factual_risk"), canonical_findings(F.concat(v, extra))).otherwise(v))
