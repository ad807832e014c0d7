"""Closest tasks by words, and histories that only grow."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notegauge.operators import tasks

TASK = "path string, goal string, title string, project string, people string, source string"


def brute_closest(rows, near, shown):
    words = {r[0]: frozenset(w for w in re.split(r"[\W_]+", f"{r[1] or ''} {r[2] or ''}".lower()) if w) for r in rows}
    facets = {r[0]: [(x or "").strip().lower() for x in r[3:]] for r in rows}
    out = set()
    for p in words:
        found = []
        for o in words:
            if o != p and words[p] and words[o]:
                similarity = len(words[p] & words[o]) / len(words[p] | words[o])
                if similarity >= near:
                    found.append((-similarity, -sum(x == y != "" for x, y in zip(facets[p], facets[o])), o))
        out |= {(p, o, round(-s, 9), -n, i + 1) for i, (s, n, o) in enumerate(sorted(found)[:shown])}
    return out


def closest(spark, rows, near=tasks.NEAR, shown=tasks.SHOWN):
    got = tasks.closest_by_words(spark.createDataFrame(rows, TASK), near, shown).collect()
    return {(r["path"], r["other"], round(r["similarity"], 9), r["same"], r["rank"]) for r in got}


@pytest.mark.parametrize(("seed", "near"), [(1, 0.5), (2, 0.8), (3, 0.3), (4, 1.0)])
def test_closest_by_definition(spark, seed, near):
    rng = random.Random(seed)
    word = lambda: rng.choice(["call", "write", "plan", "the", "the", "the", "bank", "Report", "tax", "über"] + [f"w{i}" for i in range(8)])
    pick = lambda *x: rng.choice(x)
    rows = [(f"t{i:03d}", " ".join(word() for _ in range(rng.randrange(6))), pick(None, "", word(), f"{word()}, {word()}!"), pick(None, "", "p", "P ", "q"), pick(None, "ann", "bob"), pick("mail", None)) for i in range(70)]
    assert closest(spark, rows, near) == brute_closest(rows, near, tasks.SHOWN)


def test_a_goal_that_all_share(spark):
    """Every task has the same words; each has its own people and one of two projects."""
    rows = [(f"t{i:04d}", "Deliver", "it", f"p{i % 2}", f"person {i}", None) for i in range(1500)]
    got = closest(spark, rows)
    assert len(got) == 1500 * tasks.SHOWN
    assert {o for p, o, _, n, _ in got if p == "t1001"} == {"t0001", "t0003", "t0005"} and {n for *_, n, _ in got} == {1}
    assert {o for p, o, *_ in got if p == "t0002"} == {"t0000", "t0004", "t0006"}


def test_common_words_are_joined_on_rare_ones(spark):
    """A word that all tasks have, beside one of their own, brings none of them together."""
    sets = spark.createDataFrame([(f"a{i} common", [f"a{i}", "common"]) for i in range(400)], "id string, words array<string>")
    joined = tasks.near_sets(sets, 0.5)
    assert joined.collect() == []
    assert closest(spark, [(f"t{i}", f"common own{i}", None, None, None, None) for i in range(50)]) == set()


def note(*entries, section="Work log", after=""):
    return f"---\na: b\n---\n# T\n\n## Context\n\n- none\n\n## {section}\n\n" + "".join(f"- {e}\n" for e in entries) + after


def rewrites(spark, *versions, path="t"):
    rows = [(path, datetime(2024, 1, i + 1), v) for i, v in enumerate(versions)]
    got = tasks.history_rewrites(spark.createDataFrame(rows, "path string, ts timestamp, content string")).orderBy("ts").collect()
    return [(r["ts"].day, r["kind"], r["kept"], r["was"], r["now"], r["first_lost"]) for r in got]


@pytest.mark.parametrize(
    ("before", "now", "said"),
    [
        ([], ["a"], []),
        (["a"], ["a"], []),
        (["a"], ["a", "b", "c"], []),
        (["a", "b"], ["a"], [("removed", 1, "- b")]),
        (["a", "b"], ["b"], [("removed", 0, "- a")]),
        (["a", "b"], [], [("removed", 0, "- a")]),
        (["a", "a"], ["a"], [("removed", 1, "- a")]),
        (["a", "a", "b"], ["a", "b"], [("removed", 1, "- a")]),
        (["a", "b"], ["a", "B"], [("rewritten", 1, "- b")]),
        (["a", "b", "c"], ["a", "x", "c", "d"], [("rewritten", 1, "- b")]),
        (["a", "b"], ["b", "a"], [("reordered", 0, "- a")]),
        (["a", "b"], ["x", "a", "b"], [("inserted", 0, "- a")]),
        (["a", "b"], ["a", "x", "b"], [("inserted", 1, "- b")]),
    ],
)
def test_histories(spark, before, now, said):
    got = rewrites(spark, note(*before), note(*now))
    assert got == [(2, kind, kept, len(before), len(now), lost) for kind, kept, lost in said]


def test_histories_of_several_versions_and_notes(spark):
    got = rewrites(spark, note("a"), note("a", "b"), note("a", "c"), note("a", "c", "d"), note("d"))
    assert [(day, kind) for day, kind, *_ in got] == [(3, "rewritten"), (5, "removed")]
    # lines that go on belong to their entry; fences and other sections are no entries
    assert rewrites(spark, note("a\n  more", after="\n## Other\n\n- x\n"), note("a\n  more", "b")) == []
    assert [k for _, k, *_ in rewrites(spark, note("a\n  more"), note("a\n  less"))] == ["rewritten"]
    assert rewrites(spark, note("a"), None) == [(2, "removed", 0, 1, 0, "- a")]
    assert rewrites(spark, None, "", note("a")) == []
    rows = [("x", datetime(2024, 1, 1), note("a")), ("y", datetime(2024, 1, 2), note("b")), ("x", datetime(2024, 1, 3), note("a", "c"))]
    assert tasks.history_rewrites(spark.createDataFrame(rows, "path string, ts timestamp, content string")).collect() == []


def test_what_a_body_is_judged_by_is_made_once(spark):
    """Expressions that repeat their input are evaluated as often: what a note costs had grown with the number of rules."""
    judged = str(tasks.body_violations(F.col("of_note"), F.col("status")))
    assert judged.count("of_note") == 1 + len(tasks.BODY_SECTIONS) + len(tasks.STATUS_SECTIONS)
    assert str(tasks.body_sections(F.col("of_note"))).count("of_note") == 2  # for the lines and for the headings
