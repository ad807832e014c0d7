"""A Python data source for folders of Markdown notes.

Spark's file sources skip empty files and names that begin with ``_`` or ``.``; a
vault counts them. The driver lists the upper folders and tasks the deeper ones, which
gives the paths; these are dealt out evenly and read where they arrive, so a deep folder
is listed by one task but read by all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from notegauge.runtime import ship
from notegauge.schemas import NOTE

CHUNK = 256
#: Levels of folders below the first that the driver lists.
LISTED = 2


def resolved(root: str, note_path: str) -> Path:
    """The file of a note: inside the vault, also behind links, a Markdown file, and there."""
    base, name = Path(root).resolve(), PurePosixPath(note_path)
    full = base.joinpath(*name.parts).resolve()
    for wrong, what in (
        (name.is_absolute() or ".." in name.parts or not full.is_relative_to(base), "must stay inside vault"),
        (full.suffix != ".md", "must be a Markdown file"),
        (not full.exists(), "does not exist"),
    ):
        if wrong:
            raise ValueError(f"note path {what}: {note_path}")
    return full


class Chunk(InputPartition):
    """Notes by path, or all that lie under a folder, which the task that reads them lists."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


class VaultReader(DataSourceReader):
    def __init__(self, root: str, folder: str, chunk: int):
        self.root, self.folder, self.chunk = root, folder, chunk

    def notes_in(self, place: str, files: list[str]) -> list[str]:
        """Relative paths of the notes among the files of a folder."""
        return sorted(os.path.relpath(os.path.join(place, f), self.root).replace(os.sep, "/") for f in files if f.endswith(".md"))

    def partitions(self) -> list[Chunk]:
        """Chunks of the notes in the first LISTED levels of folders, and the folders below; a missing folder has none."""
        found, below = [], []
        base = os.path.join(self.root, self.folder)
        for at, dirs, files in os.walk(base):
            found += self.notes_in(at, files)
            if os.path.relpath(at, base).count(os.sep) + (at != base) == LISTED:
                below += [Chunk([], os.path.join(at, d)) for d in sorted(dirs)]
                dirs.clear()
        return [Chunk(found[i : i + self.chunk]) for i in range(0, len(found), self.chunk)] + below or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        yield from ((path,) for path in partition.paths)
        if partition.folder:
            yield from ((p,) for at, _, files in os.walk(partition.folder) for p in self.notes_in(at, files))


class VaultSource(DataSource):
    """The paths of notes. Options: path (the vault), folder (within it), chunk (files to a partition of the listing)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self):
        return "note_path string"

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"], self.options.get("folder", ""), int(self.options.get("chunk", CHUNK)))


def read_notes(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The notes at the paths of ``batches``, CHUNK at a time."""
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            rows = []
            for path in b.column(0).slice(i, CHUNK).to_pylist():
                full = os.path.join(root, path)
                with open(full, encoding="utf-8") as f:  # any line break is read as \n
                    content = f.read()
                rows.append((path, path.rsplit("/", 1)[-1].removesuffix(".md"), content, datetime.fromtimestamp(int(os.stat(full).st_mtime), timezone.utc)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.name for f in NOTE])


def notes(spark: SparkSession, vault: str, folder: str = "") -> DataFrame:
    """(note_path, stem, content, modified_time) of the notes in a folder of a vault."""
    ship(spark)
    spark.dataSource.register(VaultSource)
    paths = spark.read.format("vault").option("folder", folder).load(vault)
    return paths.repartition(spark.sparkContext.defaultParallelism).mapInArrow(partial(read_notes, vault), NOTE)
