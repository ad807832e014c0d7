"""One text file from sections of ordered lines, without any line passing through the driver.

Tasks sort ranges of the lines and write them as part files, a file per section and
task, and say how many bytes each has. From these figures every part's place in the
whole is known: the driver lays down the text between the sections, tasks copy the
parts to their places, and the file takes its name when it is whole. Copying again
writes the same bytes at the same place, so tasks may be repeated.

The folder of the file has to be seen by all executors.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.runtime import ship

#: Bytes that a task copies at a time.
BUFFER = 1 << 20

Blocks = list[str | int]


def as_it_is(line: str) -> str:
    return line


def arranged(lines: DataFrame, order: list) -> DataFrame:
    """``lines`` (section, line, ...) in ranges that follow one another, each sorted."""
    keys = [F.col("section"), *order]
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("section", "line")


def text(blocks: Blocks, lines: DataFrame, order: list, shape: Callable[[str], str] = as_it_is) -> str:
    """The same as one text, for few lines."""
    own: dict[int, list[str]] = {}
    for r in lines.orderBy("section", *order).select("section", "line").collect():
        own.setdefault(r["section"], []).append(shape(r["line"]) + "\n")
    return "".join("".join(own.get(b, [])) if isinstance(b, int) else b for b in blocks)


def write(path: str, blocks: Blocks, lines: DataFrame, order: list, shape: Callable[[str], str] = as_it_is) -> None:
    """Write ``blocks`` to the file ``path``: texts as they are, and for a number the lines of that section in ``order``, each shaped and ended by a line break.

    A section that no block names is left out.
    """
    spark = lines.sparkSession
    ship(spark)
    path = os.path.abspath(path)
    stage = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(stage)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, out, told = TaskContext.get().partitionId(), None, None, []
        for b in batches:
            for section, line in zip(*(c.to_pylist() for c in b.columns)):
                if section != now:
                    if out:
                        out.close()
                    now, name = section, os.path.join(stage, uuid.uuid4().hex)
                    out = open(name, "wb")
                    told.append([section, task, name, 0])
                data = (shape(line) + "\n").encode()
                out.write(data)
                told[-1][3] += len(data)
        if out:
            out.close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], kind) for i, kind in enumerate(kinds)], ["section", "task", "name", "bytes"])

    try:
        told = arranged(lines, order).mapInArrow(parts, "section int, task int, name string, bytes long").collect()  # a row per task and section
        at, places, texts = 0, [], []
        for block in blocks:
            if isinstance(block, int):
                for r in sorted((r for r in told if r["section"] == block), key=lambda r: r["task"]):
                    places.append((r["name"], at))
                    at += r["bytes"]
            else:
                texts.append((at, block.encode()))
                at += len(texts[-1][1])
        whole = os.path.join(stage, "whole")
        with open(whole, "wb") as f:
            f.truncate(at)
            for begin, data in texts:
                f.seek(begin)
                f.write(data)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, begin in zip(*(c.to_pylist() for c in b.columns)):
                    with open(name, "rb") as source, open(whole, "r+b") as target:
                        target.seek(begin)
                        shutil.copyfileobj(source, target, BUFFER)
                yield b

        if places:
            df = spark.createDataFrame(places, "name string, begin long")
            df.repartition(min(len(places), spark.sparkContext.defaultParallelism)).mapInArrow(copy, df.schema).count()
        os.replace(whole, path)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
