import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from notegauge.llm import simhash
from notegauge.llm.common import components


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBcÉ .\n\t\x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)


def test_long_text_counts_every_shingle():
    text = " ".join(str(i % 997) for i in range(70000))
    assert simhash.fingerprint(text) == brute(text)


def groups_of(fps, radius=2):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for c in centres:
        x = int(c)
        for _ in range(30):  # chains: each step flips up to three bits
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
    fps = np.array(sorted(fps), np.uint64)
    want = groups_of(fps)
    rows = spark.createDataFrame([(int(f.astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    for tile_rows in (8192, 3):  # tiles whole, and split into many parts
        got = {r["node"]: r["label"] for r in components(simhash.links(rows, 2, tile_rows)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want.tolist()


def test_dense_group_emits_no_pairs(spark):
    base = 0x0F0F0F0F0F0F0F0F
    fps = [base, *[base ^ (1 << i) for i in range(64)]]
    rows = spark.createDataFrame([(f if f < 2**63 else f - 2**64, i) for i, f in enumerate(fps)], "fp long, rep long")
    edges = simhash.links(rows, 2).count()
    assert edges < 64 * 21  # all 65 are within two bits of one another: 2080 pairs


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["label"] for r in components(edges).collect()} == {0}


def test_dedup_keeps_the_smallest(spark):
    docs = spark.createDataFrame([(9, "a b c d"), (4, "a b c d"), (7, "other words are here now"), (4, "a b c d")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup(docs).collect()) == [4, 4, 7]


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    base = [words[i] for i in rng.integers(0, 2000, 400)]
    for edits in (0, 5, 20, 60):
        other = list(base)
        for i in rng.integers(0, 400, edits):
            other[i] = "new"
        (_, a), (_, b) = simhash.sketch(" ".join(base)), simhash.sketch(" ".join(other))
        same = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
        assert abs((same - 1 / 256) / (255 / 256) - jaccard(" ".join(base), " ".join(other))) < 0.14
    assert all(len(n) == 0 and x == bytes(128) for n, x in map(simhash.sketch, (None, " ")))


def test_near_copies_are_found_and_others_kept(spark):
    rng = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in ("na", "lo", "mi", "ka", "tu")]
    docs, kind = [], {}
    for _ in range(120):
        base = [words[i] for i in rng.integers(0, len(words), rng.integers(60, 500))]
        docs.append(" ".join(base))
        kind[len(docs) - 1] = "base"
        for share, name in ((0.01, "copy"), (0.2, "other")):
            if rng.random() < 0.5:
                other = list(base)
                for i in rng.integers(0, len(base), max(1, int(share * len(base)))):
                    other[i] = words[rng.integers(len(words))] + "x"
                docs.append(" ".join(other))
                kind[len(docs) - 1] = name
    got = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    sim = {i: max((jaccard(docs[i], docs[j]) for j in range(max(0, i - 2), i)), default=0) for i in kind}
    close, far = [i for i in kind if sim[i] >= 0.85], [i for i in kind if sim[i] < 0.65]
    assert len(close) > 30 and sum(i in got for i in close) <= 0.05 * len(close)
    assert all(i in got for i in far)


def edited_pairs(kind, share, n=60, seed=3):
    """Pairs of random texts of 150 to 600 words: one with a passage replaced, appended to, or words changed here and there."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 5000, k)]
    for _ in range(n):
        size = int(rng.integers(150, 601))
        base, k = word(size), int(share * size)
        at = int(rng.integers(0, size - k))
        if kind == "block":
            other = [*base[:at], *word(k), *base[at + k :]]
        elif kind == "append":
            other = [*base, *word(k)]
        else:
            other = list(base)
            for i in rng.choice(size, max(1, k // 5), replace=False):
                other[i] = "new"
        yield " ".join(base), " ".join(other)


def test_similar_pairs_are_found_and_only_those(spark):
    """Every pair from 0.8 by whole shingle sets is linked, none below, also just beside the limit."""
    cases = [("block", 0.09), ("block", 0.102), ("block", 0.13), ("append", 0.235), ("append", 0.3), ("scattered", 0.1), ("scattered", 0.16)]
    pairs = [p for i, (kind, share) in enumerate(cases) for p in edited_pairs(kind, share, seed=i)]
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    similar = [jaccard(*p) >= 0.8 for p in pairs]
    assert 150 < sum(similar) < len(pairs) - 100
    assert sum(2 * i + 1 in got for i, x in enumerate(similar) if x) <= 0.01 * sum(similar)
    assert all(2 * i + 1 in got for i, x in enumerate(similar) if not x)


def test_parts_of_large_tiles_meet(spark):
    """A dense group, a chain whose ends are unlike and texts apart, each in many parts of a tile: as one part would find them."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):  # each beside the base
        other = list(base)
        other[int(rng.integers(300))] = f"x{i}"
        docs.append(" ".join(other))
    for i in range(120):  # each beside the one before
        base[2 * i] = f"y{i}"
        docs.append(" ".join(base))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    one = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame).collect()}
    many = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame, part_rows=7).collect()}
    assert one == many and set(one.values()) == {0}


def test_groups_of_odd_rows(spark):
    rows = [(5, None), (6, ""), (2, " \t"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A  b c d e F"), (None, "alone here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(frame).collect()), key=str)
    assert got == sorted([(5, 2), (6, 2), (2, 2), (None, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=str)
    assert simhash.similar_groups(frame.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in simhash.dedup(frame).collect()) == ["2", "7", "7", "None", "None"]
