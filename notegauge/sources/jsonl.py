"""JSON Lines: strict reading with line numbers, typed reading, and sorted writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegauge.functions.text import strip
from notegauge.runtime import scratch
from notegauge.schemas import AUDIT_ROW


#: Splits whose first lines are broadcast at most, some hundred bytes each; more are joined by a shuffle.
SPLITS = 100_000


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are not blank.

    A line's number is its place among the ids of its split, after the lines of the
    file's earlier splits. One small aggregate says where each split begins and goes to
    all tasks, so no text is moved or sorted. Should the file be split in another way
    when it is read the second time, that is an error and no wrong number.
    """
    from pyspark.sql import Window

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    splits = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    folder = scratch(spark)
    splits.select("file", "start", "first", "n", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(folder)
    begun = spark.read.schema("file string, start long, first long, n long, before long").parquet(folder)
    lines = raw.join(F.broadcast(begun) if begun.count() <= SPLITS else begun, ["file", "start"], "left")
    own = F.col("id") - F.col("first")
    line = F.when(own.between(0, F.col("n") - 1), F.col("before") + own + 1).otherwise(F.raise_error(F.concat(F.lit("the splits of a file have changed while it was read: "), F.col("file"))).cast("long"))
    return lines.select("file", line.alias("line"), "value").filter(strip(F.col("value")) != "")


def errors(lines: DataFrame) -> DataFrame:
    """(file, line, error) of the lines that are no JSON objects."""
    value = F.col("value")
    return lines.filter(F.try_parse_json(value).isNull() | ~strip(value).startswith("{")).select("file", "line", F.lit("not a JSON object").alias("error"))


def violations(lines: DataFrame, contract: Callable[[Column], Column]) -> DataFrame:
    """(file, line, error): the first thing that the contract says against each bad line."""
    from notegauge.operators.contracts import line

    return lines.select("file", "line", F.get(line(F.col("value"), contract), F.lit(0)).alias("error")).filter("error is not null")


def strict_lines(spark: SparkSession, path: str, contract: Callable[[Column], Column]) -> DataFrame:
    """(file, line, value) of files whose every line holds to the contract; the first line that does not is an error, named path:line."""
    lines = numbered(spark, path)
    bad = violations(lines, contract).orderBy("file", "line").first()
    if bad:
        name = path if bad["file"].endswith(path) else bad["file"]
        raise ValueError(f"{name}:{bad['line']}: {bad['error']}")
    return lines


def typed_lines(lines: DataFrame, schema: T.StructType = AUDIT_ROW) -> DataFrame:
    """Rows of checked lines, with the file and line they come from."""
    return lines.select("file", "line", F.from_json("value", schema).alias("row")).select("file", "line", "row.*")


def strict(spark: SparkSession, path: str, contract: Callable[[Column], Column], schema: T.StructType = AUDIT_ROW) -> DataFrame:
    """Rows of files whose lines are those of strict_lines()."""
    strict_lines(spark, path, contract)
    return typed(spark, path, schema)


def typed(spark: SparkSession, path: str, schema: T.StructType = AUDIT_ROW) -> DataFrame:
    """Rows of validated files."""
    return spark.read.schema(schema).json(path)


def as_json(rows: DataFrame, optional: tuple[str, ...] = ("created_time", "factual_risk_reason")) -> DataFrame:
    """(value): JSON text per row with fields by name; optional fields are left out where null, other nulls are written."""
    names = sorted(c for c in rows.columns if c not in optional)
    # a judgment's findings need no evidence, but none is no key (in a string the quotes would be escaped)
    text = F.replace(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), F.lit(',"evidence":null'), F.lit(""))
    for c in optional:
        if c in rows.columns:
            piece = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
            text = F.when(F.col(c).isNull(), text).otherwise(F.concat(F.expr("''"), F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(piece, F.lit(2), F.length(piece))))
    return rows.select(text.alias("value"))


def write(rows: DataFrame, path: str, single: bool = False) -> None:
    """Sorted by note_path; one file only where a reader asks for it."""
    ordered = rows.orderBy("note_path")
    out = as_json(ordered)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def append(lines: DataFrame, path: str) -> None:
    """A batch's lines of JSON (value); resumed runs skip what is there by an anti join."""
    lines.select("value").write.mode("append").text(path)
