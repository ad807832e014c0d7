"""Audit runs as immutable snapshots, and what changed between two of them.

A run's rows are staged in a folder of their own, and a commit entry then names that
folder. Entries are numbered files; each is written aside and renamed to the next free
number, which fails where another writer took it, so a commit is there whole or not at
all. Readers go by the entries: what no entry names, the leftover of a writer that
failed, is never seen. A committed run is never written again.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from notegauge.operators import scoring
from notegauge.schemas import AUDIT_ROW
from notegauge.vocab import BUCKETS, ROW_STATUSES

#: Seconds after which staged files without a commit count as left behind.
STALE = 24 * 3600


@dataclass(frozen=True)
class CommitLog:
    """Numbered entries in the folder ``root``/commits, each a JSON object. The driver reads them: one per commit, whatever the rows."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self) -> Any:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """All commits, oldest first; each has its number as ``version``."""
        files, folder = self._files(), self._path("commits")
        names = sorted(n for n in (f.getPath().getName() for f in files.listStatus(folder)) if n.endswith(".json") and n[0] not in "._") if files.exists(folder) else []
        read = self.spark._jvm.org.apache.commons.io.IOUtils
        found = []
        for name in names:
            stream = files.open(self._path(f"commits/{name}"))
            try:
                found.append(json.loads(read.toString(stream, "UTF-8")) | {"version": int(name.removesuffix(".json"))})
            finally:
                stream.close()
        return found

    def commit(self, entry: dict, against: int) -> int | None:
        """Add ``entry`` as the number after ``against``; None if that number is taken."""
        jvm, version = self.spark._jvm, against + 1
        files, aside, place = self._files(), self._path(f"commits/_{uuid.uuid4().hex}"), self._path(f"commits/{version:012d}.json")
        out = files.create(aside, False)
        try:
            out.write(json.dumps(entry, sort_keys=True).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(aside), files.makeQualified(place), no_options)
        except Py4JJavaError as e:
            files.delete(aside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return None
            raise
        return version

    def staged(self) -> str:
        """A new folder for the files of a commit to come."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def sweep(self, named: set[str], older_than: float = STALE) -> list[str]:
        """Delete the staged folders that no entry names and that have not changed for ``older_than`` seconds; returns their names."""
        files, folder = self._files(), self._path("data")
        if not files.exists(folder):
            return []
        known = {p.rstrip("/").rsplit("/", 1)[-1] for p in named}
        old = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() not in known and f.getModificationTime() / 1000 <= time.time() - older_than]
        for path in old:
            files.delete(path, True)
        return sorted(p.getName() for p in old)


class Runs:
    """The committed audit runs in a folder, each under its run_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root, CommitLog(spark, root)

    def write(self, rows: DataFrame, run_id: str) -> int:
        """Stage the rows of a run and commit them; the version. A run_id that is committed already is an error, also where another writer was faster."""
        self._unused(run_id)
        seen, path = Observation(), self.log.staged()
        bucket = scoring.bucket_key(F.col("priority"))
        counts = [F.count("*").alias("rows"), F.count_if(F.col("note_path").isNull()).alias("unnamed")]
        counts += [F.count_if(F.col("row_status") == s).alias(f"status_{s}") for s in ROW_STATUSES] + [F.count_if(bucket == b).alias(f"bucket_{b}") for b in BUCKETS]
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT_ROW])
        typed.observe(seen, *counts).write.parquet(path)
        told = seen.get
        if told["unnamed"]:
            raise ValueError(f"{told['unnamed']} rows without note_path")
        entry = {
            "run_id": run_id, "path": path, "rows": told["rows"], "committed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
            "row_status_counts": {s: told[f"status_{s}"] for s in ROW_STATUSES}, "priority_counts": {b: told[f"bucket_{b}"] for b in BUCKETS},
        }
        while True:
            last = self._unused(run_id)
            version = self.log.commit(entry, last)
            if version is not None:
                return version

    def _unused(self, run_id: str) -> int:
        """The last version, where no commit has this run_id."""
        entries = self.log.entries()
        if any(e["run_id"] == run_id for e in entries):
            raise ValueError(f"run is committed already: {run_id}")
        return entries[-1]["version"] if entries else 0

    def committed(self) -> list[dict]:
        return self.log.entries()

    def rows(self, run_id: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a run: by run_id, as of a version, or of the last one."""
        wanted = [e for e in self.log.entries() if (run_id is None or e["run_id"] == run_id) and (version is None or e["version"] <= version)]
        if not wanted:
            raise ValueError(f"no committed run: {run_id if run_id is not None else 'none at all' if version is None else version}")
        return self.spark.read.schema(AUDIT_ROW).parquet(wanted[-1]["path"])

    def sweep(self, older_than: float = STALE) -> list[str]:
        return self.log.sweep({e["path"] for e in self.log.entries()}, older_than)

    def difference(self, before: str, after: str) -> DataFrame:
        return difference(self.rows(before), self.rows(after))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note_path, change, content_changed, score_before, score_after, priority_before, priority_after, gained, lost) per note of either run.

    ``change`` is added, removed, changed (content, score, priority or codes differ) or
    same; gained and lost are finding codes in order. Paths are unique in a run. Only
    the columns compared are read and moved.
    """
    side = lambda rows, s: rows.select("note_path", F.col("content_hash").alias(f"hash_{s}"), F.col("score").alias(f"score_{s}"), F.col("priority").alias(f"priority_{s}"), scoring.codes(F.col("findings")).alias(f"codes_{s}"))
    both = side(before, "before").join(side(after, "after"), "note_path", "full")
    none = F.array().cast("array<string>")
    was, now = (F.coalesce(f"codes_{s}", none) for s in ("before", "after"))
    differs = lambda k: ~F.col(f"{k}_before").eqNullSafe(F.col(f"{k}_after"))
    added, removed = F.col("codes_before").isNull(), F.col("codes_after").isNull()
    gained, lost = F.array_except(now, was), F.array_except(was, now)
    change = F.when(added, "added").when(removed, "removed").when(differs("hash") | differs("score") | differs("priority") | (was != now), "changed").otherwise("same")
    return both.select("note_path", change.alias("change"), (~added & ~removed & differs("hash")).alias("content_changed"), "score_before", "score_after", "priority_before", "priority_after", gained.alias("gained"), lost.alias("lost"))


def summary(differences: DataFrame) -> DataFrame:
    """(change, notes, better, worse): how many notes, and how many of them have a higher or a lower score than before."""
    delta = F.col("score_after") - F.col("score_before")
    return differences.groupBy("change").agg(F.count("*").alias("notes"), F.count_if(delta > 0).alias("better"), F.count_if(delta < 0).alias("worse"))
