"""Corpus pipeline: ``documents`` to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of ``documents``. Rows that a stage has no
reason to drop stay as they are: null and empty texts are neither toxic nor made of
repeated lines, and all of them are near copies of one another. Repeated rows are rows
of their own; a row without doc_id is never the copy of another nor dropped for one.
Other columns than those of ``documents`` are left out. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.llm import lines, mixing, packing, simhash, toxicity
from notegauge.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; equal texts go or stay together."""
    scored = toxicity.scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("__score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents hold stay in the last of them only; n_chars follows the text. A null text comes back empty."""
    kept = lines.dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, as often as it is repeated."""
    return simhash.dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of the sources takes them, in whole copies; those without words once. Null sources are one source."""
    return mixing.apply_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a null text is one closing token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack),
]

#: The classifier, XXH64 and the tokenizer are beyond SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``; between stages the documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
