import random
import re
from collections import Counter

import pytest

from notegauge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"


def brute(rows, least, top=10):
    """The contract, term by term and pair by pair."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        count = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for _, s, ts in (d for d in docs if d[0] == lang):
            count[s].update(t for t in ts if t in kept)
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "x", i) for i, r in enumerate(rows)], SCHEMA)
    got = divergence.audit(df.repartition(3), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(n=150, seed=1, sources=5):
    rng = random.Random(seed)
    words = ["the", "The", "café", "Ünit", "漢字", "😀x", "a", "b-c", "x1y", "it's", "rare", "zeta", "ʼn"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(" \n,.0@[`{\x7f").join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "en", "en", "de"]), f"s{rng.randrange(sources)}") for _ in range(n)]
    return rows + [(None, "en", "s0"), ("", "en", "empty"), ("the the", None, None), ("!!!", None, "other"), rows[0], rows[0]]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_by_definition(spark, least):
    rows = corpus()
    assert run(spark, rows, least=least) == brute(rows, least)


def test_many_blocks_and_shards(spark, monkeypatch):
    rows = corpus(80, 2, 23)
    monkeypatch.setattr(divergence, "SHARE", 3)
    assert run(spark, rows, least=2) == brute(rows, 2)


def test_blocks_of_sources():
    """Comparing by small blocks gives the pairs that one block gives."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sources = [f"s{i}" for i in range(9)]
    counts = {s: rng.integers(0, 5, 7) for s in sources}
    numbers = divergence.packed(np.arange(7))
    every = sum(counts.values())
    rows = pa.Table.from_pylist([{"shard": 3, "lang": "en", "source": s, "numbers": numbers, "counts": divergence.packed(c)} for s, c in [*counts.items(), (None, every)]])
    data, size = divergence.blob("\n".join("abcdefg"))
    info = [{"shard": 3, "lang": "en", "source": s, "data": None, "size": None, "total": int(c.sum()), "terms": 7} for s, c in [*counts.items(), (None, every)]]
    info = pa.Table.from_pylist([*info, {"shard": 3, "lang": "en", "source": None, "data": data, "size": size, "total": None, "terms": None}])
    whole = divergence._compare(3)(rows, info).to_pylist()
    old, divergence.BLOCK = divergence.BLOCK, 2
    try:
        parts = divergence._compare(3)(rows, info).to_pylist()
    finally:
        divergence.BLOCK = old
    key = lambda r: (r["part"], *sorted((r["source"], r["item"])), r["value"])
    assert sorted(map(key, whole)) == sorted(map(key, parts)) and len([r for r in whole if r["part"] == "pair"]) == 36


@pytest.mark.parametrize("total", [3, 10**6, 2**52, 2**60, 10**25])
def test_shares_are_exact(total):
    import numpy as np

    counts = np.array([0, 1, 2, min(total, 2**62) // 3, min(total, 2**62)], np.int64)
    assert divergence.shares(counts, total, 5).tolist() == [1 + 10**9 * (c + 2) // (total + 10) for c in counts.tolist()]


def test_small_chunks_and_pieces(monkeypatch):
    rows = corpus(80, 2, 23)
    chunks = run_chunks(rows, monkeypatch)
    held = Counter()
    for r in chunks:
        if r["shard"] is not None:
            names = divergence.unblob(r["data"], r["size"]).split("\n")
            assert all(divergence.shard_of(t, 4) == r["shard"] for t in names)
            held.update({(r["lang"], t): n for t, n in zip(names, divergence.unpacked(r["held"]).tolist())})
    assert len({r["chunk"] for r in chunks}) > 20
    assert held == Counter((lang or "", t) for text, lang, _ in rows for t in set(divergence.terms(text or "")))
    assert {(r["lang"], r["source"]) for r in chunks if r["shard"] is None} == {(lang or "", s or "") for _, lang, s in rows}


def run_chunks(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "CHUNK", 200)
    monkeypatch.setattr(divergence.pieces, "__defaults__", (30,))
    monkeypatch.setattr(divergence, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "" for _, lang, _ in rows]), pa.array([s or "" for _, _, s in rows]), pa.array([t or "" for t, _, _ in rows])], ["lang", "source", "text"])
    return [r for b in divergence._chunks(4)(iter([batch])) for r in b.to_pylist()]


def test_pieces_cut_no_term():
    text = ("ab " * 50 + "c" * 500 + ". ") * 3
    for size in (1, 7, 100):
        found = list(divergence.pieces(text, size))
        assert "".join(found) == text
        assert [t for p in found for t in divergence.terms(p)] == divergence.terms(text)


def test_languages_without_terms_and_empty_tables(spark):
    rows = [("alpha beta", "en", "a"), ("", "en", "b"), (None, "en", "c")]
    assert run(spark, rows) == brute(rows, 10)
    assert {r[4] for r in run(spark, rows)} == {0}
    assert run(spark, []) == []
    assert run(spark, rows[:1]) == []  # one source has no other, and no term is kept


def test_one_source_holds_nearly_all(spark):
    rows = [("common words here " * 3, "en", "big")] * 400 + [(f"common other{'x' * (i % 3)}", "en", f"s{i % 4}") for i in range(60)]
    assert run(spark, rows) == brute(rows, 10)
