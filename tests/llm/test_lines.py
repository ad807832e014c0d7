from collections import defaultdict
from dataclasses import replace

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from notegauge.llm import lines
from notegauge.llm.lines import CuckooFilter, LineIndex

SHARED = "This Line is Long Enough to Count as a Repeated One"


def brute(docs):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 40:
                held[low(x)].add(d)
    keep = lambda d, x: not (len(low(x)) >= 40 and len(held[low(x)]) >= 5 and max(held[low(x)]) != d)
    return sorted((d, "\n".join(x for x in (t or "").split("\n") if keep(d, x))) for d, t in docs)


def corpus():
    rng = np.random.default_rng(5)
    pool = [f"{SHARED} {i}" for i in range(12)] + ["short", "", f"  {SHARED.upper()} 3\t", "É" * 40]
    return [(int(d), "\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 9)))) for d in rng.permutation(60)] + [(100, None), (101, "")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_against_brute_force(spark):
    docs = corpus()
    assert kept(lines.dedup(frame(spark, docs))) == brute(docs)


def test_hot_lines_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    docs = corpus() + [(200 + i, f"{SHARED} 1\nown {i}") for i in range(300)]
    assert kept(lines.dedup(frame(spark, docs))) == brute(docs)


def test_deletion_reverses(spark):
    docs = [(i, f"{SHARED}\nrest {i}") for i in range(5)]
    index = LineIndex.build(frame(spark, docs))
    assert index.drops().count() == 4
    smaller = index.delete(frame(spark, docs[:1]))
    assert smaller.drops().count() == 0  # four holders are too few
    assert smaller.insert(frame(spark, docs[:1])).drops().count() == 4
    assert smaller.references().select("refs", "last").first() == (4, 4)


def state(index):
    return sorted(tuple(r) for r in index.references().select("h1", "h2", "refs", "last").collect()), sorted(map(tuple, index.drops().collect()), key=str)


def test_insertions_and_deletions_are_those_of_a_new_index(spark):
    """After each change the counts, the drops and the keys in the filters are what an index built anew has."""
    rng = np.random.default_rng(11)
    docs = dict(corpus())
    index = LineIndex.build(frame(spark, list(docs.items())))
    for step in range(3):
        gone = [int(d) for d in rng.choice(sorted(docs), 14, replace=False)]
        index = index.delete(frame(spark, [(d, None) for d in gone]))
        more = [(300 + 20 * step + i, docs[d]) for i, d in enumerate(gone[:9])]
        docs = {d: t for d, t in docs.items() if d not in gone} | dict(more)
        index = index.insert(frame(spark, more + more[:2]))
        fresh = LineIndex.build(frame(spark, list(docs.items())))
        assert state(index) == state(fresh)
        tags = lambda x: sum(int((np.frombuffer(r["tags"], np.uint16) != 0).sum()) for r in x.filters().collect())
        assert tags(index) == tags(fresh) == fresh.references().filter("refs >= 5").count()
        assert kept(lines.dedup(frame(spark, list(docs.items())), index)) == brute(list(docs.items()))


def test_only_touched_shards_change(spark):
    docs = [(i, f"{SHARED} {i // 6}\nrest {i}") for i in range(60)]
    index = LineIndex.build(frame(spark, docs))
    smaller = index.delete(frame(spark, docs[:1]))
    (old, kept_shards), (_, changed) = smaller.versions
    assert old == index.versions[0][0] and len(changed) == 1 and kept_shards | changed == set(range(index.shards))
    assert index.delete(frame(spark, [(999, None)])) .versions == index.versions


def test_what_the_filter_rejects_never_reaches_the_table(spark, tmp_path):
    """With empty filters nothing is dropped, though the exact table is whole."""
    docs = corpus()
    index = LineIndex.build(frame(spark, docs))
    assert index.drops().count() > 0
    folder = str(tmp_path / "lines")
    index.references().write.parquet(f"{folder}/counts")
    empty = CuckooFilter(16).tags.tobytes()
    spark.createDataFrame([(r["shard"], empty) for r in index.filters().collect()], "shard int, tags binary").write.parquet(f"{folder}/filters")
    blind = replace(index, versions=((folder, index.versions[0][1]),))
    assert blind.references().filter("refs >= 5").count() > 0 and blind.drops().count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), unique=True, max_size=300))
def test_cuckoo_filter_has_no_false_negatives(keys):
    a = np.array(keys, np.uint64).reshape(-1, 2)
    f = CuckooFilter.of(a[:, 0], a[:, 1])
    assert f.contains(a[:, 0], a[:, 1]).all()
    for h1, h2 in keys[::2]:
        assert f.delete(h1, h2)
    rest = a[1::2]
    assert f.contains(rest[:, 0], rest[:, 1]).all()
    assert (f.tags != 0).sum() == len(rest)


def test_cuckoo_filter_rejects_most_strangers():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**64, (5000, 2), dtype=np.uint64) for _ in range(2))
    f = CuckooFilter.of(a[:, 0], a[:, 1])
    assert f.contains(b[:, 0], b[:, 1]).mean() < 0.005


def test_many_rows_without_doc_id(spark):
    """They keep their lines and count as holders; none of their keys is gathered anywhere, and the join spreads them."""
    docs = [(None, f"{SHARED} {i % 50}\n{SHARED} number {i % 700}") for i in range(20000)] + [(i, f"{SHARED} {i % 50}\nown {i}") for i in range(600)]
    df = frame(spark, docs).repartition(8)
    index = LineIndex.build(df)
    drops = index.drops()
    assert drops.filter("doc_id is null").count() == 0 and drops.count() == 600 - 50
    got = lines.dedup(df, index)
    assert got.filter("doc_id is null and __n_dropped > 0").count() == 0 and got.count() == len(docs)
    assert sum(r["__n_dropped"] for r in got.filter("doc_id is not null").select("__n_dropped").collect()) == 550
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_task = got.filter("doc_id is null").groupBy(lines.F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in by_task) < 2 * 20000 / n or len(by_task) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.integers(1, 4))
def test_filter_filled_at_once(seed, n, parts):
    rng = np.random.default_rng(seed)
    h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    f = CuckooFilter.of(h1, h2)
    assert n == 0 or f.contains(h1, h2).all()
    assert (f.tags != 0).sum() == n
    g = CuckooFilter(max(16, n))
    if all(g.insert_all(a, b) for a, b in zip(np.array_split(h1, parts), np.array_split(h2, parts))):
        assert (n == 0 or g.contains(h1, h2).all()) and (g.tags != 0).sum() == n
        assert all(g.delete(a, b) for a, b in zip(h1.tolist(), h2.tolist())) and not g.tags.any()
