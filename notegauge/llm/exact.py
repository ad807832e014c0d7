"""Exact deduplication as a stateful stream over the files of a growing folder.

Two streams run one after the other whenever there are new files. The first notes for
every row the digest of its normalised text, its doc_id and where its content lies
(file and row), the second keeps a state per digest, on disk in RocksDB and without
expiry: how many rows have it, which of them stays, and where the first one lies. Rows
are summed up per digest in each task before they go to the task of their digest, so
copies of one text cost a row per task however many they are.

A digest alone decides nothing: the new rows of every digest that has several are read
again by their locators, together with the first one, and compared byte by byte.
Digests under which texts differ are noted, and their rows are grouped by whole texts
instead, so results are exact under any digest.

All that is kept lies in one folder that the executors share: the streams' checkpoints
with the state, sightings, groups and clashes. A stream that is broken off goes on from
its checkpoint; a micro-batch that is repeated replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from notegauge.llm.common import delete_on_exit, lookup_join, scratch_path

WHITE = " \t\n\x0b\x0c\r"
#: Files of the source to a micro-batch.
FILES = 100_000
#: The state lies on disk, within bounded memory, and its changes are what is saved at each step.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition takes some MB of disk before it has a row
}
KEEP = "struct<size:bigint,none:boolean,doc_id:bigint,file:string,row:bigint>"
SIGHTING = "doc_id long, n_chars long, digest binary, file string, row long, seen timestamp"
GROUP = f"digest binary, n long, keep {KEEP}, first struct<seen:timestamp,file:string,row:bigint>"


def content(text: Column) -> Column:
    """What equal texts share: the text without ASCII white space; empty for null."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Deduplicator:
    """The copies among the rows (doc_id, text) of the Parquet file or folder ``source``.

    ``folder`` holds the state; one folder belongs to one source, and the number of its
    state partitions is that of the session's shuffle partitions at first use. ``files``
    bounds a micro-batch.
    """

    spark: SparkSession
    source: str
    folder: str
    digest: Callable[[Column], Column] = sha256
    files: int = FILES

    def advance(self) -> Deduplicator:
        """Take in all files of the source that are new."""
        schema = self.spark.read.parquet(self.source).schema
        # as a pattern, since a stream's path must be a folder or a pattern, and the source may be a single file
        source = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files).parquet(f"{self.source[:-1]}[{self.source[-1]}]")
        seen = source.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), self.digest(content(F.col("text"))).alias("digest"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.current_timestamp().alias("seen"),
        )
        self._run(seen.writeStream.format("parquet").option("path", f"{self.folder}/sightings"), "sightings")
        told = self.spark.readStream.schema(SIGHTING).parquet(f"{self.folder}/sightings")
        # of a group stays the longest original text, then the smallest doc_id, null last, then the first by place
        keep = F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
        state = told.groupBy("digest").agg(F.count("*").alias("n"), F.min(keep).alias("keep"), F.min(F.struct("seen", "file", "row")).alias("first"))
        write = lambda changed, batch: changed.write.mode("overwrite").parquet(f"{self.folder}/groups/batch={batch}")
        self._run(state.writeStream.outputMode("update").foreachBatch(write), "state")
        self._compare()
        return self

    def _run(self, writer: DataStreamWriter, name: str) -> None:
        with settings(self.spark, STATE):
            query = writer.option("checkpointLocation", f"{self.folder}/checkpoints/{name}").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def sightings(self) -> DataFrame:
        """(doc_id, n_chars, digest, file, row, seen) of every row taken in."""
        return self.spark.read.schema(SIGHTING).parquet(f"{self.folder}/sightings")

    def groups(self) -> DataFrame:
        """(digest, n, keep, first): the state of each digest."""
        told = self.spark.read.schema(f"{GROUP}, batch int").parquet(f"{self.folder}/groups")
        last = told.groupBy("digest").agg(F.max_by(F.struct("n", "keep", "first"), "batch").alias("s"))
        return last.select("digest", "s.*")

    def clashes(self) -> DataFrame:
        """(digest): the digests under which texts differ."""
        return self._compared().filter("digest is not null").select("digest").distinct()

    def _compared(self) -> DataFrame:
        path = f"{self.folder}/compared"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], "upto timestamp, digest binary")
        return self.spark.read.schema("upto timestamp, digest binary").parquet(path)

    def _contents(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (file, row and more) with the content that lies there. Only files with such rows are read."""
        files = [r[0] for r in wanted.select("file").distinct().collect()]  # as many as there are files, which the driver lists anyway
        if not files:
            return wanted.withColumn("content", F.lit(""))
        rows = self.spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), content(F.col("text")).alias("content"))
        return wanted.join(rows, ["file", "row"])

    def _compare(self) -> None:
        """Compare the rows that came since the last time, where their digest has several, with the first row of the digest."""
        since: datetime | None = self._compared().agg(F.max("upto")).first()[0]
        sightings = self.sightings()
        upto = sightings.agg(F.max("seen")).first()[0]
        if upto is None or upto == since:
            return
        new = sightings if since is None else sightings.filter(F.col("seen") > F.lit(since))
        several = self.groups().filter("n > 1").select("digest", "n", "first")
        hits = lookup_join(new.select("digest", "file", "row"), several, ["digest"], "n").filter("first is not null")
        firsts = several.join(hits.select("digest").distinct(), "digest", "left_semi").select("digest", "first.file", "first.row")
        # equal texts of a task are one row before they move, so the copies of one text never meet in a task
        texts = self._contents(hits.select("digest", "file", "row").unionByName(firsts)).groupBy("digest", "content").agg(F.lit(1).alias("one"))
        unlike = texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.lit(upto).cast("timestamp").alias("upto"), "digest")
        mark = self.spark.range(1).select(F.lit(upto).cast("timestamp").alias("upto"), F.lit(None).cast("binary").alias("digest"))
        unlike.unionByName(mark).write.mode("append").parquet(f"{self.folder}/compared")

    def result(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, digest, file, row of every row taken in.

        Null texts are empty, and all empty texts are equal. A row without doc_id stays
        only if no equally long row of its group has one; keep_id is then null. Of rows
        that repeat, doc_id and all, the first by place stays, so a group keeps one row.
        """
        groups = self.groups().select("digest", "n", "keep")
        rows = self.sightings()
        clashes = self.clashes()
        done = None
        if not clashes.isEmpty():
            own = self._contents(rows.join(clashes, "digest"))
            keep = F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
            done = own.join(own.groupBy("digest", "content").agg(F.count("*").alias("n"), F.min(keep).alias("keep")), ["digest", "content"])
            rows, groups = rows.join(clashes, "digest", "left_anti"), groups.join(clashes, "digest", "left_anti")
        # lookup_join() takes its weight off, so the size comes twice
        every = lookup_join(rows.select("doc_id", "digest", "file", "row"), groups.withColumn("weight", F.col("n")), ["digest"], "weight")
        every = every if done is None else every.unionByName(done.select(*every.columns))
        kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return every.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest", "file", "row")


def over(spark: SparkSession, source: str, **options) -> Deduplicator:
    """All rows of ``source``, with the state in a folder that goes with the driver."""
    folder = scratch_path(spark, "exact")
    delete_on_exit(spark, folder)
    return Deduplicator(spark, source, folder, **options).advance()


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; an empty table stays empty."""
    spark = docs.sparkSession
    path = scratch_path(spark, "exact-source")
    docs.write.parquet(path)
    delete_on_exit(spark, path)
    keep = over(spark, path).result().filter("kept").select("file", "row")
    rows = spark.read.schema(docs.schema).parquet(path)
    place = rows.select(*docs.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return place.join(keep.toDF("__file", "__row"), ["__file", "__row"], "left_semi").select(*docs.columns)
