"""The parent set under change: reference counts per target, and the notes whose parent finding flips.

Two logs are kept in a folder. Links hold what each structure note points to; the last
entry of a path counts, an empty one means that the note is gone. Counts hold changes
of the number of structure notes that point to a target; their sum is the number. An
update appends what it changes and commits both with one entry of a commit log, so it
is there whole or not at all. Segments are parted by a hash of their key: an update
reads the parts that its own keys fall into. When many updates have piled up, they are
put together into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.functions.lexer import lexed
from notegauge.sources.runs import CommitLog

SHARDS = 64
#: Updates after which the logs are put together.
PILED = 16
LINKS = "note_path string, targets array<string>, version long, shard int"
COUNTS = "target string, n long, shard int"


def links(notes: DataFrame) -> DataFrame:
    """(note_path, targets): what structure notes (note_path, content) link to; several rows of a path count as one note."""
    one = notes.select("note_path", F.array_distinct(F.filter(F.transform(lexed("content", "links")["links"], X.link_target), lambda t: t != "")).alias("targets"))
    return one.groupBy("note_path").agg(F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"))


def shard(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int").alias("shard")


class ParentSet:
    """The targets of the structure notes seen so far, in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def _segments(self, kind: str, schema: str) -> DataFrame:
        entries = self.log.entries()
        base = max((i for i, e in enumerate(entries) if e["whole"]), default=0)
        paths = [f"{e['path']}/{kind}" for e in entries[base:]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]  # at most PILED and one
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def postings(self) -> DataFrame:
        """(note_path, targets): the structure notes that are there."""
        last = self._links().groupBy("note_path").agg(F.max_by("targets", "version").alias("targets"))
        return last.filter("size(targets) > 0")

    def _links(self) -> DataFrame:
        return self._segments("links", LINKS)

    def references(self) -> DataFrame:
        """(target, refs): how many structure notes point to each target that has any."""
        return self._segments("counts", COUNTS).groupBy("target").agg(F.sum("n").alias("refs")).filter("refs <> 0")

    def targets(self) -> DataFrame:
        """(target), as audit.parent_targets() has it."""
        return self.references().select("target")

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
        """Take in structure notes (note_path, content) that are new or changed, and the paths (note_path) of those that are gone.

        Returns (target, before, after) of the targets that gained their first or lost
        their last reference. A path in both is a changed one; a path that was not there
        and is removed changes nothing.
        """
        entries = self.log.entries()
        version, path = (entries[-1]["version"] if entries else 0), self.log.staged()
        new = links(changed)
        if removed is not None:
            gone = removed.select("note_path").distinct().join(new.select("note_path"), "note_path", "left_anti")
            new = new.unionByName(gone.select("note_path", F.array().cast("array<string>").alias("targets")))
        self._save(new.select("*", F.lit(version + 1).cast("long").alias("version"), shard("note_path")), f"{path}/links")
        new = self.spark.read.schema(LINKS).parquet(f"{path}/links")
        old = self._last_of(new)
        point = lambda df, n: df.select(F.explode("targets").alias("target"), F.lit(n).cast("long").alias("n"))
        delta = point(new, 1).unionByName(point(old, -1)).groupBy("target").agg(F.sum("n").alias("n")).filter("n <> 0")
        self._save(delta.select("*", shard("target")), f"{path}/counts")
        delta = self.spark.read.schema(COUNTS).parquet(f"{path}/counts")
        before = self._segments("counts", COUNTS).filter(F.col("shard").isin(*self._shards(delta))).join(delta.select("target"), "target", "left_semi").groupBy("target").agg(F.sum("n").alias("before"))
        flips = delta.join(before, "target", "left").select("target", F.coalesce("before", F.lit(0)).alias("before"), "n").select("target", "before", (F.col("before") + F.col("n")).alias("after"))
        flips = flips.filter("(before = 0) <> (after = 0)")
        flips.write.parquet(f"{path}/flips")
        if self.log.commit({"path": path, "whole": not entries}, version) is None:
            raise ValueError("another update of the parent set came first; apply this one again")
        self._put_together()
        return self.spark.read.schema(flips.schema).parquet(f"{path}/flips")

    def _last_of(self, new: DataFrame) -> DataFrame:
        """(targets) that the paths of ``new`` had so far."""
        there = self._links().filter(F.col("shard").isin(*self._shards(new))).join(new.select("note_path"), "note_path", "left_semi")
        return there.groupBy("note_path").agg(F.max_by("targets", "version").alias("targets"))

    @staticmethod
    def _shards(rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select("shard").distinct().collect()] or [-1]  # at most SHARDS numbers

    @staticmethod
    def _save(rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("shard").parquet(path)

    def _put_together(self) -> None:
        entries = self.log.entries()
        base = max((i for i, e in enumerate(entries) if e["whole"]), default=0)
        if len(entries) - base <= PILED:
            return
        version, path = entries[-1]["version"], self.log.staged()
        self._save(self.postings().select("*", F.lit(version).cast("long").alias("version"), shard("note_path")), f"{path}/links")
        self._save(self.references().select("target", F.col("refs").alias("n"), shard("target")), f"{path}/counts")
        self.log.commit({"path": path, "whole": True}, version)  # where another update came first, the next one does it


def flipped(notes: DataFrame, flips: DataFrame) -> DataFrame:
    """(note_path, missing_parent): the notes (note_path, stem) whose parent finding a change of the parent set turns over."""
    return notes.select("note_path", "stem").join(flips.select(F.col("target").alias("stem"), (F.col("after") == 0).alias("missing_parent")), "stem").select("note_path", "missing_parent")
