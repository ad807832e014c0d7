"""Asking an external judge from the tasks: batches in parallel, answers committed once.

Batches are dealt to tasks. A task asks batch by batch; what times out, does not parse
or does not match its notes is asked again in halves. Each answer, and each failure
that led to halves, is laid down under the batch's own name as soon as it is there, so
a task that is run again asks for nothing that was answered. What the tasks return is
held against the contract in one job; batches with a bad answer are halved and asked
in another round. Accepted judgments are appended by a writer whose files appear when
its job commits, and not at all otherwise.

The vault and the work folder have to be seen by all executors under one path.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from notegauge.operators import batching, contracts, runner
from notegauge.runtime import ship

#: Tasks that ask at the same time.
ASKERS = 4


# --- a writer of lines that appear when they are committed


@dataclass
class Staged(WriterCommitMessage):
    path: str | None


class LinesWriter(DataSourceWriter):
    """Rows (value) as lines of one file per task, staged in ``folder`` under a name that readers pass over, and moved up at the commit.

    A task that still runs while its job is given up may leave staged files; nobody sees them.
    """

    def __init__(self, folder: str):
        self.folder, self.stage = folder, os.path.join(folder, f"_staged-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Staged:
        path = None
        for row in rows:
            if path is None:
                os.makedirs(self.stage, exist_ok=True)
                path = os.path.join(self.stage, f"part-{uuid.uuid4().hex}.jsonl")
                out = open(path, "w", encoding="utf-8")
            out.write(row[0] + "\n")
        if path:
            out.close()
        return Staged(path)

    def commit(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m and m.path:
                os.rename(m.path, os.path.join(self.folder, os.path.basename(m.path)))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class LinesSink(DataSource):
    """Option: path, a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"])


def append_lines(lines: DataFrame, path: str) -> None:
    """Append lines (value) to the folder ``path``: all of them or none."""
    ship(lines.sparkSession)
    lines.sparkSession.dataSource.register(LinesSink)
    os.makedirs(path, exist_ok=True)
    lines.select("value").write.format("committed_lines").mode("append").save(path)


# --- asking


class Answers:
    """What was answered, and what failed, by batch: a file each, written aside and renamed."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def name(self, index: int, rows: list[dict]) -> str:
        asked = hashlib.sha256(json.dumps([[r["note_path"], r["content"]] for r in rows]).encode()).hexdigest()
        return os.path.join(self.folder, f"{index}-{asked[:32]}.json")

    def get(self, index: int, rows: list[dict]) -> dict | None:
        try:
            return json.loads(Path(self.name(index, rows)).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return None

    def put(self, index: int, rows: list[dict], told: dict) -> None:
        path = self.name(index, rows)
        aside = f"{path}.{uuid.uuid4().hex}"
        Path(aside).write_text(json.dumps(told), encoding="utf-8")
        os.replace(aside, path)


def answered(index: int, rows: list[dict], ask: Callable[[list[dict]], list[dict]], answers: Answers) -> Iterator[tuple[int, list[dict]]]:
    """As batching.collect(), but nothing that was answered, or failed and was halved, is asked again."""

    def once(part: list[dict], number: int) -> list[dict]:
        told = answers.get(number, part)
        if told is None:
            try:
                got = ask(part)
                if [g.get("note_path") for g in got] != [r["note_path"] for r in part]:
                    raise batching.RetryableError(f"batch {number}: responses do not match the rows")
                told = {"judgments": got}
            except batching.RetryableError as e:
                if len(part) == 1:
                    raise  # not laid down: the next run may ask for it again
                told = {"failed": str(e)}
            answers.put(number, part, told)
        if "failed" in told:
            raise batching.RetryableError(told["failed"])
        return told["judgments"]

    try:
        yield index, once(rows, index)
    except batching.RetryableError:
        if len(rows) == 1:
            raise
        half = len(rows) // 2
        yield from answered(index * 1000 + 1, rows[:half], ask, answers)
        yield from answered(index * 1000 + 2, rows[half:], ask, answers)


def ask_all(batches: DataFrame, judge: runner.CommandRunner, head: str, work: str, askers: int = ASKERS) -> DataFrame:
    """(batch, pos, value) of the batches (batch, pos, note_path, content): the judgments as JSON text, per batch or half of it."""
    ship(batches.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.path.join(work, f"task-{uuid.uuid4().hex}")
        os.makedirs(folder)
        text = lambda rows: "\n\n".join([head, *[f"## {r['note_path']}\n\n{r['content']}" for r in rows]])
        ask, answers = runner.asker(judge, text, folder), Answers(os.path.join(work, "answers"))

        def one(rows: list[dict]) -> pa.RecordBatch:
            found = [(index, i, json.dumps(g, sort_keys=True)) for index, got in answered(rows[0]["batch"], rows, ask, answers) for i, g in enumerate(got)]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["batch", "pos", "value"])

        now: list[dict] = []  # the rows of one batch, which batching bounds
        for part in parts:
            for row in part.to_pylist():
                if now and now[0]["batch"] != row["batch"]:
                    yield one(now)
                    now = []
                now.append(row)
        if now:
            yield one(now)

    dealt = batches.select("batch", "pos", "note_path", "content").repartition(askers, "batch").sortWithinPartitions("batch", "pos")
    return dealt.mapInArrow(run, "batch long, pos int, value string")


def judge_all(batches: DataFrame, judge: runner.CommandRunner, head: str, work: str, out: str, askers: int = ASKERS) -> int:
    """Judgments of all batches (batch from 1, pos, note_path, content), appended to ``out``; how many.

    A round asks for all batches that are left, and appends those whose every answer
    holds to the contract; the others are halved. A single note without a good answer
    is an error, after what was good has been appended.
    """
    spark, count, left = batches.sparkSession, 0, batches.select("batch", "pos", "note_path", "content")
    work = os.path.abspath(work)
    while not left.isEmpty():
        place = os.path.join(work, f"round-{uuid.uuid4().hex}")
        got = ask_all(left, judge, head, work, askers)
        append_lines(got.select(F.to_json(F.struct("batch", "pos", F.col("value").alias("answer"))).alias("value")), place)
        told = spark.read.schema("batch long, pos int, answer string").json(place)
        checked = told.select("*", F.get(contracts.line(F.col("answer"), contracts.judgment), F.lit(0)).alias("error"))
        bad = checked.filter("error is not null").groupBy("batch").agg(F.min(F.struct("pos", "error")).alias("first"))
        sizes = told.groupBy("batch").agg(F.count("*").alias("n"))
        bad = bad.join(sizes, "batch").select("batch", "n", "first.error")
        good = told.join(bad.select("batch"), "batch", "left_anti")
        count += good.count()
        append_lines(good.select(F.col("answer").alias("value")), out)
        single = bad.filter("n = 1").orderBy("batch").first()
        if single:
            raise batching.RetryableError(f"batch {single['batch']}: {single['error']}")
        # the halves of what was answered badly, found by the notes that the answers name
        notes = told.join(bad, "batch").select("batch", "n", "pos", F.get_json_object("answer", "$.note_path").alias("note_path"))
        halves = notes.select("note_path", F.when(F.col("pos") < F.floor(F.col("n") / 2), F.col("batch") * 1000 + 1).otherwise(F.col("batch") * 1000 + 2).alias("batch"), "pos")
        halves = halves.withColumn("pos", (F.row_number().over(Window.partitionBy("batch").orderBy("pos")) - 1).cast("int"))
        left = halves.join(batches.select("note_path", "content"), "note_path").select("batch", "pos", "note_path", "content")
    return count
