"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

A line key is a 128-bit hash, and its shard follows from it. The index keeps three
things in the shared folder: postings (which document holds which key), per shard the
exact reference counts (how many documents hold a key, and the largest of them), and
per shard a cuckoo filter of the keys that enough documents hold. Every probe goes to
its shard's filter, which needs two bytes a key in memory; only what the filter lets
through is joined with the exact table, so false positives never show.

Documents are inserted as a new segment of postings and deleted by a list of doc_ids.
Either way counts change for the keys concerned alone; keys that cross the threshold
are put into or taken out of their shard's filter, and shards without such documents
stay as they are. Lines of the documents that remain come back: the dedup is reversible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.llm.common import HOT, checkpointed, delete_on_exit, partitions, scratch_path, widened
from notegauge.runtime import ship

MIN_CHARS, MIN_DOCS = 40, 5
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None for lines that are never dropped."""
    s = line.strip(WHITE)
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower()) if len(s) >= min_chars else None


class CuckooFilter:
    """16-bit tags in buckets of four; supports insertion, deletion and vectorised lookup.

    Two places per key: bucket i and i xor hash(tag). Grows by doubling when an
    insertion finds no place, from the keys the caller can replay.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85)))))
        self.tags = np.zeros((n, self.SLOTS), np.uint16)
        self.rng = np.random.default_rng(1)

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        f = cls(1)
        f.tags = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return f

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mask = np.uint64(len(self.tags) - 1)
        tag = (h2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        i = h1.astype(np.uint64) & mask
        return tag, i.astype(np.int64), (i ^ self._hop(tag)).astype(np.int64)

    def _hop(self, tag):
        return (tag.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.tags) - 1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        tag, i, j = self._places(h1, h2)
        return (self.tags[i] == tag[:, None]).any(axis=1) | (self.tags[j] == tag[:, None]).any(axis=1)

    def _fill(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Put tags into free slots of their buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        own = bucket[order]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        rank = np.arange(len(own)) - np.repeat(at, np.diff(at, append=len(own)))
        free = self.tags[own] == 0
        placed = rank < free.sum(axis=1)
        slot = ((np.cumsum(free, axis=1) == rank[:, None] + 1) & free).argmax(axis=1)
        self.tags[own[placed], slot[placed]] = tag[order][placed]
        found = np.zeros(len(bucket), bool)
        found[order] = placed
        return found

    def insert_all(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Insert keys: all at once into free slots of their two buckets, those left by moving others about."""
        tag, i, j = self._places(h1, h2)
        left = np.flatnonzero(~self._fill(i, tag))
        left = left[~self._fill(j[left], tag[left])]
        return all([self.insert(a, b) for a, b in zip(h1[left].tolist(), h2[left].tolist())])

    def insert(self, h1: int, h2: int) -> bool:
        tag, i, j = (x[0] for x in self._places(np.array([h1], np.uint64), np.array([h2], np.uint64)))
        for _ in range(self.KICKS):
            for place in (i, j):
                free = np.flatnonzero(self.tags[place] == 0)
                if len(free):
                    self.tags[place, free[0]] = tag
                    return True
            slot = int(self.rng.integers(self.SLOTS))
            at = i if self.rng.integers(2) else j
            tag, self.tags[at, slot] = self.tags[at, slot], tag
            i = at
            j = int(np.uint64(at) ^ self._hop(np.array([tag], np.uint16))[0])
        return False

    def delete(self, h1: int, h2: int) -> bool:
        tag, i, j = (x[0] for x in self._places(np.array([h1], np.uint64), np.array([h2], np.uint64)))
        for place in (i, j):
            found = np.flatnonzero(self.tags[place] == tag)
            if len(found):
                self.tags[place, found[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter with all these (distinct) keys: larger ones are tried until all have a place."""
        size = max(16, len(h1))
        while True:
            f = cls(size)
            if f.insert_all(h1, h2):
                return f
            size *= 2


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2): the distinct keys of each document. Null texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {k for k in map(lambda x: line_key(x, min_chars), (text or "").split("\n")) if k}
                ids += [d] * len(own)
                keys += own
            h = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long")


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which long lines, with insertion and deletion of documents.

    A document is a doc_id: repeated rows of one count once. Keys held by a null
    doc_id count, but a null is never the largest holder and cannot be deleted.
    ``segments`` are folders of postings, each with the folders of doc_ids deleted
    since; ``versions`` are folders of counts and filters, each with the shards that
    are read from it. An index never changes; another one shares what stays the same.
    """

    spark: SparkSession
    shards: int
    min_chars: int
    min_docs: int
    segments: tuple[tuple[str, tuple[str, ...]], ...] = ()
    versions: tuple[tuple[str, frozenset[int]], ...] = ()

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        empty = cls(docs.sparkSession, partitions(docs.sparkSession), min_chars, min_docs)
        index = replace(empty, segments=((empty._saved(postings(docs, min_chars).distinct(), "postings"), ()),))
        counts = index.holders().groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last"))
        folder = scratch_path(index.spark, "lines")
        index._save(counts.withColumn("shard", index._shard()), f"{folder}/counts")
        index = replace(index, versions=((folder, frozenset(range(index.shards))),))
        frequent = index.references().filter(F.col("refs") >= min_docs).select("shard", F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("tags"), "h1", "h2")
        index._save(index._by_shard(frequent, _revise, "shard int, tags binary"), f"{folder}/filters")
        return index

    def _shard(self) -> Column:
        return F.pmod("h1", F.lit(self.shards)).cast("int")

    def _saved(self, df: DataFrame, name: str) -> str:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        delete_on_exit(self.spark, path)
        return path

    def _save(self, df: DataFrame, path: str) -> None:
        """Rows by shard, so that readers of some shards skip most of the files."""
        df.repartitionById(partitions(self.spark), F.pmod("shard", F.lit(partitions(self.spark))).cast("int")).sortWithinPartitions("shard").write.parquet(path)
        delete_on_exit(self.spark, path)

    def _by_shard(self, rows: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over rows (shard, kind, ...) of whole shards, kinds in order."""
        n = partitions(self.spark)
        return rows.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard", "kind").mapInArrow(run, schema)

    def holders(self) -> DataFrame:
        """(doc_id, h1, h2)."""
        parts = []
        for path, deleted in self.segments:
            df = self.spark.read.parquet(path)
            for gone in deleted:
                df = df.join(self.spark.read.parquet(gone), "doc_id", "left_anti")
            parts.append(df)
        return reduce(DataFrame.unionByName, parts)

    def _table(self, kind: str) -> DataFrame:
        parts = []
        for path, shards in self.versions:
            df = self.spark.read.parquet(f"{path}/{kind}")
            parts.append(df if len(shards) == self.shards else df.filter(F.col("shard").isin(*sorted(shards))))
        return reduce(DataFrame.unionByName, parts)

    def references(self) -> DataFrame:
        """The exact table: (h1, h2, refs, last, shard)."""
        return self._table("counts")

    def filters(self) -> DataFrame:
        """(shard, tags) of the shards that have keys with enough holders."""
        return self._table("filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        new = checkpointed(postings(docs, self.min_chars).distinct())
        held = self.holders()
        new = checkpointed(new.join(held, same(new, held, ["doc_id", "h1", "h2"]), "left_anti"))
        more = new.groupBy("h1", "h2").agg(F.count("*").alias("more"), F.max("doc_id").alias("top")).withColumn("shard", self._shard())
        old = self.references().select("shard", "h1", "h2", "refs", "last")
        changed = more.join(old, ["shard", "h1", "h2"], "left")
        changed = changed.select("shard", "h1", "h2", F.coalesce("refs", F.lit(0)).alias("before"), (F.coalesce("refs", F.lit(0)) + F.col("more")).alias("refs"), F.greatest("last", "top").alias("last"))
        return replace(self, segments=(*self.segments, (self._saved(new, "postings"), ())))._changed(changed)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forget the documents in the column doc_id of ``doc_ids``."""
        gone = self._saved(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "deleted")
        keys = checkpointed(self.holders().join(self.spark.read.parquet(gone), "doc_id", "left_semi").select("h1", "h2").distinct())
        left = replace(self, segments=tuple((path, (*deleted, gone)) for path, deleted in self.segments))
        now = left.holders().join(keys, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last"))
        old = self.references().select("shard", "h1", "h2", F.col("refs").alias("before"))
        changed = keys.withColumn("shard", self._shard()).join(old, ["shard", "h1", "h2"]).join(now, ["h1", "h2"], "left")
        return left._changed(changed.select("shard", "h1", "h2", "before", F.coalesce("refs", F.lit(0)).alias("refs"), "last"))

    def _changed(self, changed: DataFrame) -> LineIndex:
        """The index with other counts for the keys of ``changed`` (shard, h1, h2, before, refs, last); its shards get new tables, the others keep theirs."""
        changed = checkpointed(changed)
        touched = frozenset(r[0] for r in changed.select("shard").distinct().collect())  # numbers of shards, at most self.shards
        if not touched:
            return self
        folder, here = scratch_path(self.spark, "lines"), F.col("shard").isin(*sorted(touched))
        kept = self.references().filter(here).join(changed.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._save(kept.unionByName(changed.filter("refs > 0").drop("before")), f"{folder}/counts")
        enough, no_tags = F.col("refs") >= self.min_docs, F.lit(None).cast("binary").alias("tags")
        moved = changed.withColumn("kind", F.when(enough & (F.col("before") < self.min_docs), 1).when(~enough & (F.col("before") >= self.min_docs), 2)).filter("kind is not null")
        rows = self.filters().filter(here).select("shard", F.lit(0).alias("kind"), "tags", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
        rows = rows.unionByName(moved.select("shard", "kind", no_tags, "h1", "h2"))
        rows = rows.unionByName(self.spark.read.parquet(f"{folder}/counts").filter(enough).select("shard", F.lit(3).alias("kind"), no_tags, "h1", "h2"))
        self._save(self._by_shard(rows, _revise, "shard int, tags binary"), f"{folder}/filters")
        rest = ((path, shards - touched) for path, shards in self.versions)
        return replace(self, versions=(*[(path, shards) for path, shards in rest if shards], (folder, touched)))

    def drops(self) -> DataFrame:
        """(doc_id, h1, h2): the keys that each document loses; rows without doc_id lose none."""
        holders = self.holders().filter("doc_id is not null")
        frequent = checkpointed(self.references().filter(F.col("refs") >= self.min_docs).select("h1", "h2", "refs", "last"))
        total = holders.count()
        hot = frequent.filter(F.col("refs") * HOT >= max(total, HOT * 100)).select("h1", "h2", "last")  # at most HOT keys
        marked = holders.join(F.broadcast(hot.withColumnRenamed("last", "__last").withColumn("__hot", F.lit(True))), ["h1", "h2"], "left")
        lost = lambda last: F.col("doc_id") != F.col(last)
        settled = marked.filter("__hot").filter(lost("__last")).select("doc_id", "h1", "h2")
        rest = marked.filter("__hot is null").select(self._shard().alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tags"), "h1", "h2", "doc_id")
        first = self.filters().select("shard", F.lit(0).alias("kind"), "tags", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(None).cast("long").alias("doc_id"))
        passed = self._by_shard(first.unionByName(rest), _passed, "doc_id long, h1 long, h2 long")
        return settled.unionByName(passed.join(frequent.drop("refs"), ["h1", "h2"]).filter(lost("last")).select("doc_id", "h1", "h2"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) of runs of rows."""
    for b in batches:
        shard, kind = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if s < e:
                yield int(shard[s]), int(kind[s]), b.slice(s, e - s)


def _keys(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (3, 4))


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders (kind 1) whose keys the filter of their shard (kind 0, at most one row) may hold; a shard without a filter holds none."""
    now, cuckoo = None, None
    for shard, kind, rows in _runs(batches):
        if shard != now:
            now, cuckoo = shard, None
        if kind == 0:
            cuckoo = CuckooFilter.read(rows.column(2)[0].as_py())
        elif cuckoo is not None:
            maybe = pa.array(np.flatnonzero(cuckoo.contains(*_keys(rows))))
            yield pa.RecordBatch.from_arrays([rows.column(k).take(maybe) for k in (5, 3, 4)], ["doc_id", "h1", "h2"])


def _revise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of shards: the old one (kind 0), keys to insert (1), to delete (2), and all keys that it then holds (3), for a filter that is new or full."""
    now, cuckoo, full, every = None, None, False, []

    def done() -> Iterator[pa.RecordBatch]:
        kept = cuckoo
        if kept is None or full:
            kept = CuckooFilter.of(*(np.concatenate(x) for x in zip(*every))) if every else None
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([kept.tags.tobytes()], pa.binary())], ["shard", "tags"])

    for shard, kind, rows in _runs(batches):
        if shard != now:
            if now is not None:
                yield from done()
            now, cuckoo, full, every = shard, None, False, []
        if kind == 0:
            cuckoo = CuckooFilter.read(rows.column(2)[0].as_py())
        elif kind == 3:
            if cuckoo is None or full:
                every.append(_keys(rows))
        elif cuckoo is not None:
            # a filter is full only when an insertion fails, which has moved other tags about: it is made anew
            moved = cuckoo.insert_all(*_keys(rows)) if kind == 1 else all([cuckoo.delete(a, b) for a, b in zip(*(x.tolist() for x in _keys(rows)))])
            full = full or not moved
    if now is not None:
        yield from done()


def dedup(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """``docs`` without its repeated lines, plus ``__n_lines`` and ``__n_dropped``.

    A null text has one empty line and comes back empty. Rows whose doc_id is null
    keep their lines. All other columns pass through; an empty table stays empty.
    """
    ship(docs.sparkSession)
    index = index or LineIndex.build(docs)
    keys = index.drops().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__keys")).withColumnRenamed("doc_id", "__id")
    # rows without doc_id find no keys; numbers of their own spread them over the tasks of the join
    own = F.col("doc_id").cast("long")
    marked = docs.select("*", F.coalesce(own, F.monotonically_increasing_id()).alias("__own"), own.isNull().alias("__null"))
    joined = marked.join(keys.withColumn("__known", F.lit(False)), (F.col("__own") == F.col("__id")) & (F.col("__null") == F.col("__known")), "left").select(*[marked[c] for c in docs.columns], F.transform("__keys", lambda k: k["h1"]).alias("__h1"), F.transform("__keys", lambda k: k["h2"]).alias("__h2"))
    place, width, min_chars = docs.columns.index("text"), len(docs.columns), index.min_chars
    schema = widened(docs.schema, __n_lines="long", __n_dropped="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, lost = [], [], []
            for text, x, y in zip(b.column(place).to_pylist(), b.column(width).to_pylist(), b.column(width + 1).to_pylist()):
                lines = (text or "").split("\n")
                kept = lines
                if x:
                    gone = set(np.array([x, y], np.int64).T.astype(">i8").tobytes()[i : i + 16] for i in range(0, 16 * len(x), 16))
                    kept = [line for line in lines if line_key(line, min_chars) not in gone]
                texts.append("\n".join(kept))
                total.append(len(lines))
                lost.append(len(lines) - len(kept))
            columns = list(b.columns[:width])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*b.schema.names[:width], "__n_lines", "__n_dropped"])

    return joined.mapInArrow(run, schema)

