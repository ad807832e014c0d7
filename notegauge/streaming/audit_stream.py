"""Continuous audit: notes stream in, rows are appended once per note and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notegauge.functions.text import content_hash
from notegauge.operators.audit import audit

#: Parts of the sink.
SHARDS = 64


def audit_batch(batch: DataFrame, targets: DataFrame, sink: str, run_id: str, config: dict[str, str]) -> None:
    """Audit the notes of a micro-batch whose (path, content) the sink does not hold yet: replays add nothing.

    Rows lie in the sink by a hash of their path, so a batch reads the keys of those
    parts alone that its own paths fall into.
    """
    spark = batch.sparkSession
    shard = F.pmod(F.xxhash64("note_path"), F.lit(SHARDS)).cast("int").alias("shard")
    # of a note that changed twice in a batch the latest version counts (of one moment, that with the larger hash)
    hashed = batch.withColumn("content_hash", content_hash(F.col("content")))
    latest = F.max_by(F.struct(*hashed.columns), F.struct(F.coalesce("modified_time", F.timestamp_seconds(F.lit(0))), "content_hash"))
    new = hashed.groupBy("note_path").agg(latest.alias("note")).select("note.*")
    if exists(spark, f"{sink}/_SUCCESS"):
        touched = [r[0] for r in batch.select(shard).distinct().collect()]  # at most SHARDS numbers
        held = spark.read.parquet(sink).filter(F.col("shard").isin(*touched)) if touched else spark.read.parquet(sink).limit(0)
        new = new.join(held.select("note_path", "content_hash"), ["note_path", "content_hash"], "left_anti")
    audit(new.drop("content_hash"), targets, run_id, config).select("*", shard).write.mode("append").partitionBy("shard").parquet(sink)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream(notes: DataFrame, targets: DataFrame, sink: str, checkpoint: str, run_id: str, config: dict[str, str]) -> StreamingQuery:
    """Start auditing a stream of notes (note_path, stem, content, modified_time)."""
    return (
        notes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: audit_batch(batch, targets, sink, run_id, config))
        .trigger(availableNow=True)
        .start()
    )
