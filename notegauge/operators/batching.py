"""Batches of notes for judgment: greedy packing, prompts, responses, and the collection loop."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.operators.judgments import stamped, unfinished
from notegauge.runtime import ship
from notegauge.schemas import JUDGMENT

MAX_NOTES, MAX_CHARS = 20, 50_000
#: Paths to a span that its bounds are drawn from.
SAMPLED = 100


def greedy_batches(notes: DataFrame, max_notes: int = MAX_NOTES, max_chars: int = MAX_CHARS, group: str | None = None, spans: int | None = None) -> DataFrame:
    """(note_path, batch_id) over notes (note_path, size) in path order: a batch closes when the next note would not fit.
    A null size is 0; each ``group`` (a folder, say) is packed by itself.

    Greedy packing depends on every earlier choice, but on little of it: a batch that
    is open where a span of notes begins was opened by one of the ``max_notes`` notes
    before. So each span says, for each of these, what it makes of the batch it finds
    open; what the spans say is put together in order (a few numbers per span); and
    then all spans are packed, each from its true start.
    """
    ship(notes.sparkSession)
    keys = [group] if group else []
    df = notes.select(*keys, "note_path", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    names = F.struct(*keys, "note_path")
    n = spans or notes.sparkSession.sparkContext.defaultParallelism
    # names that part the notes into spans of about one size, from a sample of at most a few hundred to a span
    total = df.count()
    every = max(1, total // (n * SAMPLED))
    picked = sorted((tuple(r) for r in df.filter(F.pmod(F.xxhash64(*keys, "note_path"), F.lit(every)) == 0).select(*keys, "note_path").limit(n * SAMPLED * 4).collect()), key=lambda c: [(x is not None, x or "") for x in c]) if n > 1 else []
    cuts = sorted({picked[len(picked) * k // n] for k in range(1, n)} if picked else set(), key=lambda c: [(x is not None, x or "") for x in c])
    bounds = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for x, c in zip(cut, [*keys, "note_path"])]) for cut in cuts])
    placed = df.withColumn("span", F.size(F.filter(bounds, lambda b: b <= names)) if cuts else F.lit(0))
    schema = ", ".join([f"{g} string" for g in keys] + ["note_path string", "size long", "span int", "batch_id long"])

    def ordered() -> DataFrame:
        return placed.repartitionById(len(cuts) + 1, F.col("span")).sortWithinPartitions("span", *keys, "note_path")

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, object, int]]:
        for f in frames:
            yield from zip(f["span"].tolist(), f[group].tolist() if group else [0] * len(f), f["size"].tolist())

    def fits(state: tuple, key: object, size: int) -> bool:
        return state[1] > 0 and state[0] == key and state[1] < max_notes and state[2] + size <= max_chars

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last notes of each span, the latest first."""
        last: dict[int, deque] = {}
        for span, key, size in steps(frames):
            last.setdefault(span, deque(maxlen=max_notes)).appendleft((key, size))
        yield pd.DataFrame([(s, json.dumps(list(d))) for s, d in last.items()], columns=["span", "tail"])

    ends = {r["span"]: [tuple(x) for x in json.loads(r["tail"])] for r in ordered().mapInPandas(tails, "span int, tail string").collect()}
    present = sorted(ends)

    def entries(span: int) -> list[tuple]:
        """The open batches, as (group, notes, chars), that may be there where the span begins; the first: none."""
        before: list[tuple] = []
        for s in reversed([x for x in present if x < span]):
            before += ends[s]
            if len(before) >= max_notes:
                break
        found, chars = [(None, 0, 0)], 0
        for k, (key, size) in enumerate(before[:max_notes]):
            if key != before[0][0]:
                break
            chars += size
            found.append((key, k + 1, chars))
        return found

    starts = {s: entries(s) for s in present}

    def effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For every entry of a span the batch it leaves open, the batches of that group it opens, and whether there is no other group."""
        now: dict[int, list] = {}
        for span, key, size in steps(frames):
            for run in now.setdefault(span, [[state, 0, True] for state in starts[span]]):
                if fits(run[0], key, size):
                    run[0] = (key, run[0][1] + 1, run[0][2] + size)
                else:
                    same = run[0][1] > 0 and run[0][0] == key
                    run[:] = (key, 1, size), run[1] + 1 if same else 1, run[2] and same
        rows = [(s, k, json.dumps(list(state)), opened, alone) for s, runs in now.items() for k, (state, opened, alone) in enumerate(runs)]
        yield pd.DataFrame(rows, columns=["span", "entry", "left", "opened", "alone"])

    told = {(r["span"], r["entry"]): r for r in ordered().mapInPandas(effects, "span int, entry int, left string, opened long, alone boolean").collect()}
    state, count, enter = (None, 0, 0), 0, {}
    for s in present:
        k = starts[s].index(state)
        enter[s] = state, count
        count = told[s, k]["opened"] + (count if told[s, k]["alone"] else 0)
        state = tuple(json.loads(told[s, k]["left"]))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, batch = None, (None, 0, 0), -1
        for f in frames:
            out = []
            for span, key, size in steps([f]):
                if span != now:
                    now, (state, opened) = span, enter[span]
                    batch = opened - 1
                if fits(state, key, size):
                    state = (key, state[1] + 1, state[2] + size)
                else:
                    batch = batch + 1 if state[1] and key == state[0] else 0
                    state = (key, 1, size)
                out.append(batch)
            yield f.assign(batch_id=out)

    return ordered().mapInPandas(packed, schema).drop("span")


def prompts(notes: DataFrame, header: str = "Judge each of the following notes. Answer with one JSON object per note, in order.") -> DataFrame:
    """(batch_id, prompt) of notes (batch_id, pos, note_path, content_hash, content)."""
    block = F.concat(F.lit("## "), F.col("note_path"), F.lit("\nhash: "), F.col("content_hash"), F.lit("\n\n"), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    return notes.groupBy("batch_id").agg(F.concat(F.lit(header + "\n\n"), F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n")).alias("prompt"))


def parse_response(text: str) -> list[dict]:
    """JSON array, single object, or a JSON object per line, with or without a code fence around; no answer is an error."""
    m = re.fullmatch(r"\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*", text, re.DOTALL)
    text = (m[1] if m else text).strip()
    if not text:
        raise ValueError("the response is empty")
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        value = []
        for n, line in enumerate(text.splitlines(), start=1):
            if line.strip():
                try:
                    value.append(json.loads(line))
                except json.JSONDecodeError as e:
                    raise ValueError(f"response line {n}: {e}") from e
    value = value if isinstance(value, list) else [value]
    if not all(isinstance(v, dict) for v in value):
        raise ValueError("response must hold JSON objects")
    return value


def responses(batches: DataFrame) -> DataFrame:
    """(batch_id, pos, judgment fields) of (batch_id, response); provenance is stamped."""
    ship(batches.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, i, json.dumps(v)) for b, r in zip(f["batch_id"], f["response"]) for i, v in enumerate(parse_response(r))]
            yield pd.DataFrame(rows, columns=["batch_id", "pos", "json"])

    parsed = batches.select("batch_id", "response").mapInPandas(run, "batch_id long, pos int, json string")
    return stamped(parsed.select("batch_id", "pos", F.from_json("json", JUDGMENT).alias("j")).select("batch_id", "pos", "j.*"))


class RetryableError(Exception):
    """A batch that may succeed in halves: invalid answers, timeouts."""


def collect(rows: list[dict], ask: Callable[[list[dict]], list[dict]], index: int = 1) -> Iterator[tuple[int, list[dict]]]:
    """(batch index, judgments) of ``rows``; a batch that fails is halved until single notes fail.

    ``ask`` answers a batch in order; halves of batch i are i*1000+1 and i*1000+2.
    """
    try:
        got = ask(rows)
        if [g.get("note_path") for g in got] != [r["note_path"] for r in rows]:
            raise RetryableError(f"batch {index}: responses do not match the rows")
    except RetryableError:
        if len(rows) == 1:
            raise
        half = len(rows) // 2
        yield from collect(rows[:half], ask, index * 1000 + 1)
        yield from collect(rows[half:], ask, index * 1000 + 2)
        return
    yield index, got


def pending_batches(rows: DataFrame, done: DataFrame, limit: int | None = None, order: str = "note_path", **sizes) -> DataFrame:
    """Batches of what a resumed run still has to judge, of the first ``limit`` rows by ``order`` (the line of the
    file they come from, where there is one) before anything is skipped."""
    chosen = rows.orderBy(order).limit(limit) if limit is not None else rows
    return greedy_batches(unfinished(chosen, done), **sizes)


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as \\uXXXX, pairs for those beyond 16 bits."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(code(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), code(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 128, c).when(n < 0x10000, code(n)).otherwise(pair)

    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text)


def cache_key(note_path: Column, content_hash: Column, versions: dict[str, str]) -> Column:
    """``model-judgment:v1:`` and the SHA-256 of the compact JSON of all that a judgment depends on, keys sorted, ASCII only."""
    parts = {"content_hash": content_hash, "note_path": note_path} | {k: F.lit(v) for k, v in versions.items()}
    text = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))
    return F.concat(F.lit("model-judgment:v1:"), F.sha2(ascii_json(text), 256))


def with_cache(rows: DataFrame, cache: DataFrame, versions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose judgment is cached with it, rows still to judge) by key; ``cache`` has cache_key and judgment."""
    keyed = rows.withColumn("cache_key", cache_key(F.col("note_path"), F.col("content_hash"), versions))
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti").drop("cache_key")
