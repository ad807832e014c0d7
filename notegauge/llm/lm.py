"""Language-model scores from an Elias-Fano n-gram trie.

Words, bigrams and trigrams are counted over all training texts; those seen LEAST
times or more enter the model, so what it learns grows with the corpus, and whether an
n-gram is known depends on its own count alone. Smoothing is interpolated absolute
discounting down to add-half unigrams over all seen words and one unseen, so the
probabilities after any context sum to one.

Nothing of the model is ever in one place. Texts become chunks: the hashes of their
distinct words, and a code per token. Then two rounds of questions and answers:

1. Each chunk asks for its words, by ranges of their hashes. A range sums the counts of
   all chunks, numbers its words and answers each chunk with counts and numbers.
2. Each chunk asks once for each of its distinct trigrams (u, v, w), with the times it
   holds them in training texts, in the shard of the middle word v. A shard sums the
   counts, builds the trie of its contexts, maps it as a file and answers each question
   with what the context gives to the word, from which the chunk scores its texts.

A trigram that comes a million times is a question per chunk at most, and frequent
middle words are spread over many shards by the word before them; the successors of
such words, which all their shards need, are counted beforehand. So no shard grows
with one word, and the work grows with the corpus alone.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.llm.common import packed, partitions, unpacked, written
from notegauge.llm.eliasfano import Trie, quantised, restored
from notegauge.runtime import ship

#: Occurrences in training from which an n-gram is in the model, at every size of the corpus.
LEAST, DISCOUNT = 2, 0.75
#: Bytes of text to a chunk (a longer text is a chunk of its own), tokens to a shard and to a range of words, chunks to a task.
CHUNK, SHARD, RANGE, CHUNKS = 6 << 20, 700_000, 8_000_000, 8
#: The end of a text: no word, since words have no white space.
END = xxhash.xxh3_64_intdigest(b"\n")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 1


# --- arrays of numbers as bytes


def bundle(*arrays: np.ndarray) -> bytes:
    made = [packed(x) for x in arrays]
    return b"".join(len(m).to_bytes(8, "little") + m for m in made)


def unbundle(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(unpacked(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def differences(x: np.ndarray) -> bytes:
    """Ascending 64-bit hashes."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def summed_up(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def falls(x: np.ndarray, *over: np.ndarray) -> np.ndarray:
    """Where a run of equal ``over`` begins, and 0."""
    new = np.zeros(len(x), bool)
    new[:1] = True
    for o in over:
        new[1:] |= o[1:] != o[:-1]
    return new


def stepped(x: np.ndarray, *over: np.ndarray) -> np.ndarray:
    """Numbers that ascend where ``over`` stays: their steps, and whole at the start of a run."""
    return np.where(falls(x, *over), x, x - np.concatenate(([0], x[:-1])))


def unstepped(steps: np.ndarray, *over: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    starts = np.flatnonzero(falls(steps, *over))
    return total - np.repeat((total - steps)[starts], np.diff(np.append(starts, len(steps))))


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of each pair of numbers."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(n, starts)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, its rows without the key): the first column is the key, equal keys are neighbours."""
    now, rows = None, []
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns)):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


# --- chunks


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, ascending; a code into them per token; tokens of each text, its end included)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = split.flatten().dictionary_encode()
    words, index = flat.dictionary.cast(pa.binary()).to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    h = xxhash.xxh3_64_intdigest
    every = np.fromiter((*map(h, words), END), np.uint64, len(words) + 1)
    solid = np.fromiter((*map(bool, words), True), bool, len(words) + 1)  # white space at the edges leaves empty words
    hashes, place = np.unique(every[solid], return_inverse=True)
    code = np.full(len(every), -1, np.int64)
    code[solid] = place
    index, text_of = index[solid[index]], text_of[solid[index]]
    sizes = np.bincount(text_of, minlength=len(texts)) + 1
    codes = np.full(int(sizes.sum()), code[-1])
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = code[index]
    return hashes, codes, sizes


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, tokens, doc_id, words, n, body) of stretches of rows: words has the distinct hashes,
    n their training occurrences, body the codes of all tokens, the sizes of the texts and their held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("words", pa.binary()), ("n", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for part in _stretches(batches):
            hashes, codes, sizes = tokenised(part.column(2))
            held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(codes, np.repeat(~held, sizes), len(hashes)).astype(np.int64)
            row = ((task << 32) | serial, len(codes), part.column(0).to_pylist(), differences(hashes), packed(n), bundle(codes, sizes, held))
            serial += 1
            yield batch(schema, [row])

    return rows.mapInArrow(run, "chunk long, tokens long, doc_id array<long>, words binary, n binary, body binary")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about CHUNK bytes of text in all."""
    waiting, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            stop = min(b.num_rows, at + 1 + int(np.searchsorted(ends[at:], done + CHUNK - size)))
            waiting.append(b.slice(at, stop - at))
            size += int(ends[stop - 1] - done)
            at = stop
            if size >= CHUNK:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


# --- first round: words


def word_answers(asked: DataFrame, ranges: int, tasks: int, least: int) -> DataFrame:
    """(chunk, part, seen, total, data): counts and numbers of a chunk's words in a range of hashes.

    Words seen ``least`` times have a number, as has the end of a text; 0 stands for none.
    seen and total, of which one answer of a range has more than 0, are its distinct words and their counts in training.
    """
    question = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("n", pa.binary())])
    answer = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("seen", pa.int64()), ("total", pa.int64()), ("data", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words, n in zip(*(c.to_pylist() for c in b.columns)):
                words, n = summed_up(words), unpacked(n)
                part = ((words >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                yield batch(question, [(int(part[s]), chunk, differences(words[s:e]), packed(n[s:e])) for s, e in zip(cuts, cuts[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches):
            words = [summed_up(w) for _, w, _ in rows]
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(place, np.concatenate([unpacked(n) for _, _, n in rows]), len(distinct)).astype(np.int64)
            rank = np.empty(len(c), np.int64)
            rank[np.lexsort((distinct, -c))] = np.arange(len(c))
            number = np.where((c >= least) | (distinct == END), 1 + part + ranges * rank, 0)
            ends = np.cumsum([len(w) for w in words])
            for k, (row, e) in enumerate(zip(rows, ends)):
                own = place[e - len(words[k]) : e]
                yield batch(answer, [(row[0], part, 0 if k else int((c > 0).sum()), 0 if k else int(c.sum()), bundle(c[own], number[own]))])

    met = asked.mapInArrow(ask, "part long, chunk long, words binary, n binary").repartitionById(tasks, _task("part", tasks)).sortWithinPartitions("part", "chunk")
    return met.mapInArrow(run, "chunk long, part long, seen long, total long, data binary")


# --- second round: trigrams


class Questions:
    """The distinct trigrams of a chunk, in the order in which it asks for them and has them answered."""

    def __init__(self, body: bytes, answers: list[bytes], shards: int, limit: int):
        codes, self.sizes, self.held = unbundle(body)
        self.c, number = (np.concatenate(x) for x in zip(*map(unbundle, answers)))
        self.codes, starts = codes, np.cumsum(self.sizes) - self.sizes
        ascending, rank = np.unique(np.append(0, number), return_inverse=True)  # all words without a number are 0
        base = len(ascending)
        local = rank[1:][codes]
        end = local[-1]  # every chunk ends with the end of a text
        v = np.concatenate(([end], local[:-1]))
        v[starts] = end
        u = np.concatenate(([0], v[:-1]))
        u[starts] = 0
        self.asked = v > 0
        pair, place = np.unique(v[self.asked] * base + u[self.asked], return_inverse=True)
        key, self.place = np.unique(place * base + local[self.asked], return_inverse=True)
        train = np.repeat(self.held == 0, self.sizes)[self.asked]
        n = np.bincount(self.place, train, len(key)).astype(np.int64)
        v, u, w = pair[key // base] // base, pair[key // base] % base, key % base
        number, count = ascending, np.zeros(base, np.int64)
        count[rank[1:]] = self.c
        count[0] = 0
        spread = 1 + count[v] // limit  # shards of a frequent middle word
        shard = shard_of(number[v], mixed(number[np.where(u > 0, u, w)], np.zeros(len(u), np.int64)) % spread.astype(np.uint64), shards)
        self.order = np.argsort(shard, kind="stable")
        self.shard, self.n = shard[self.order], n[self.order]
        self.v, self.u, self.w = (x[self.order] for x in (v, u, w))
        self.number, self.count, self.spread = number, count, spread[self.order]

    def per_shard(self) -> Iterator[tuple[int, bytes]]:
        cuts = [0, *(np.flatnonzero(np.diff(self.shard)) + 1).tolist(), len(self.shard)]
        for s, e in zip(cuts, cuts[1:]):
            if s < e:
                hot = np.unique(self.v[s:e][self.spread[s:e] > 1])
                v, u, w = (self.number[x[s:e]] for x in (self.v, self.u, self.w))
                yield int(self.shard[s]), bundle(stepped(v), stepped(u, v), stepped(w, v, u), self.n[s:e], self.number[hot], self.count[hot])

    def successors(self, tables: int) -> Iterator[tuple[int, bytes]]:
        """What follows the frequent middle words, with how many shards each has, by a hash of the pair."""
        take = (self.spread > 1) & (self.w > 0) & (self.n > 0)
        key, n = summed(self.v[take] * len(self.number) + self.w[take], self.n[take])
        v, w = key // len(self.number), key % len(self.number)
        spread = np.zeros(len(self.number), np.int64)
        spread[self.v[take]] = self.spread[take]
        table = (mixed(self.number[v], self.number[w]) % np.uint64(tables)).astype(np.int64)
        order = np.argsort(table, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(table[order])) + 1).tolist(), len(order)]
        for s, e in zip(cuts, cuts[1:]):
            if s < e:
                own = order[s:e]
                yield int(table[own[0]]), bundle(self.number[v[own]], self.number[w[own]], n[own], spread[v[own]])


def questions(data: bytes) -> list[np.ndarray]:
    v, u, w, *rest = unbundle(data)
    v = unstepped(v)
    u = unstepped(u, v)
    return [v, u, unstepped(w, v, u), *rest]


def _task(number: str, tasks: int) -> Column:
    """Shards in turn: each task has as many as any other."""
    return F.pmod(F.col(number), F.lit(tasks)).cast("int")


def shard_of(v: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(v, part + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _frequent_successors(shards: int, least: int):
    """Counts of the successors of frequent words, sent to every shard of the word."""
    schema = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in by_key(batches):
            v, w, n, spread = (np.concatenate(x) for x in zip(*(unbundle(d) for (d,) in rows)))
            words, own = np.unique(np.concatenate((v, w)), return_inverse=True)
            key, n = summed(own[: len(v)] * len(words) + own[len(v) :], n)
            key, n = key[n >= least], n[n >= least]
            width = dict(zip(v.tolist(), spread.tolist()))
            to: dict[int, list[int]] = {}
            contexts, first = np.unique(key // len(words), return_index=True)
            for k, word in enumerate(words[contexts].tolist()):
                for shard in set(shard_of(np.full(width[word], word), np.arange(width[word], dtype=np.uint64), shards).tolist()):
                    to.setdefault(shard, []).append(k)
            ends = np.append(first[1:], len(key))
            for shard, ks in to.items():
                take = np.concatenate([np.arange(first[k], ends[k]) for k in ks])
                yield batch(schema, [(shard, 0, table, bundle(words[key[take] // len(words)], words[key[take] % len(words)], n[take]))])

    return run


def trie_of(v, u, w, n, hot, hot_count, pairs, least: int) -> Trie:
    """The trie of a shard, of distinct trigrams of local numbers (-1: none) and training counts.
    ``hot`` words have their counts and successors (``pairs``: v, w, n) from outside, since other shards hold more of them."""
    size = 1 + max(int(x.max(initial=-1)) for x in (v, u, w, *pairs[:2]))
    counts = np.bincount(v, n, size).astype(np.int64)
    elsewhere = np.zeros(size, bool)
    elsewhere[hot], counts[hot] = True, hot_count
    follow = (w >= 0) & ~elsewhere[v]
    after, n_after = summed(v[follow] * size + w[follow], n[follow])
    lead = u >= 0
    context, n_context = summed(u[lead] * size + v[lead], n[lead])
    key = np.concatenate((after, context, pairs[0] * size + pairs[1]))
    n2 = np.concatenate((n_after, n_context, pairs[2]))
    enough = n2 >= least
    two, at = np.unique(key[enough], return_index=True)  # a bigram from two sides has one count
    kept = np.flatnonzero((n >= least) & lead & (w >= 0))
    before, here = (np.searchsorted(two, x[kept] * size + y[kept]) for x, y in ((u, v), (v, w)))
    return Trie.build(counts, two, n2[enough][at], before, here, n[kept], DISCOUNT)


def _answers(least: int):
    """(chunk, part, data): the two weights of every trigram that a chunk asked for in a shard, from the shard's trie."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches):
            given = [unbundle(d) for kind, _, d in rows if kind == 0]
            asked = [(chunk, questions(d)) for kind, chunk, d in rows if kind == 1]
            del rows[:]
            if not asked:
                continue
            v, u, w, n, hot, hot_count = (np.concatenate([a[k] for _, a in asked]) for k in range(6))
            pairs = [np.concatenate(x) for x in zip(*given)] if given else [np.zeros(0, np.int64)] * 3
            sizes = [len(a[0]) for _, a in asked]
            chunks_ = [c for c, _ in asked]
            del given, asked
            words, local = np.unique(np.concatenate(([0], v, u, w, hot, *pairs[:2])), return_inverse=True)
            cuts = np.cumsum([1, len(v), len(u), len(w), len(hot), len(pairs[0])])
            v, u, w, hot, first, second = (x - 1 for x in np.split(local, cuts)[1:])
            base = len(words)
            pair, place = np.unique(v * base + u + 1, return_inverse=True)
            key, place = np.unique(place * base + w + 1, return_inverse=True)
            n = np.bincount(place, n, len(key)).astype(np.int64)
            v, u, w = pair[key // base] // base, pair[key // base] % base - 1, key % base - 1
            handle, path = tempfile.mkstemp(prefix="notegauge-trie-")
            os.close(handle)
            try:
                trie_of(v, u, w, n, hot, hot_count, (first, second, pairs[2]), least).save(path)
                a, b = map(quantised, Trie.load(path).weights(u, v, w))
            finally:
                os.unlink(path)
            for chunk, own in zip(chunks_, np.split(place, np.cumsum(sizes)[:-1])):
                yield batch(schema, [(chunk, shard, bundle(a[own], b[own]))])

    return run


def scores(docs: DataFrame, least: int = LEAST, shard_size: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    Null and empty texts are one END. A null doc_id counts as the empty text when the
    held-out fifth is drawn. Repeated rows are counted and scored as often as they
    come. Without training rows every token is unseen. Columns besides doc_id and
    text are not read; an empty table gives an empty result. Words are told apart by
    64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    held = written(chunks(docs), "chunks")
    tokens, number_of_chunks = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    ranges, shards = max(n, math.ceil(tokens / RANGE)), max(2 * n, math.ceil(tokens / shard_size))
    tasks = max(n, math.ceil(number_of_chunks / CHUNKS))
    words = written(word_answers(held.select("chunk", "words", "n"), ranges, max(n, ranges // 2), least), "words")
    distinct, total = words.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    limit = max(1, total // (2 * shards))
    whole = total + 0.5 * (distinct + 1)
    # one exchange brings a chunk and its words together; all three uses below read it
    known = held.select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), F.col("body").alias("data"), "doc_id").unionByName(words.select("chunk", F.lit(1).alias("kind"), "part", "data"), allowMissingColumns=True).repartition(tasks, "chunk")
    question = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])

    def ask(kind: int, what):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in by_key(batches):
                for shard, data in what(Questions(rows[0][2], [r[2] for r in rows[1:]], shards, limit)):
                    yield batch(question, [(shard, kind, chunk, data)])

        return known.sortWithinPartitions("chunk", "kind", "part").mapInArrow(run, "shard long, kind int, chunk long, data binary")

    frequent = ask(2, lambda q: q.successors(ranges)).select("shard", "data").repartitionById(n, _task("shard", n)).sortWithinPartitions("shard")
    frequent = frequent.mapInArrow(_frequent_successors(shards, least), "shard long, kind int, chunk long, data binary")
    tasks = max(n, shards // 2)
    met = ask(1, Questions.per_shard).unionByName(frequent).repartitionById(tasks, _task("shard", tasks)).sortWithinPartitions("shard", "kind", "chunk")
    weights = met.mapInArrow(_answers(least), "chunk long, part long, data binary")
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(given: pa.Table, answers: pa.Table) -> pa.Table:
        given, answers = given.sort_by([("kind", "ascending"), ("part", "ascending")]), answers.sort_by("part")
        data = given["data"].to_pylist()
        q = Questions(data[0], data[1:], shards, limit)
        p = ((q.c + 0.5) / whole)[q.codes]
        a, b = np.zeros(len(p)), np.ones(len(p))
        if len(answers):
            for to, x in zip((a, b), zip(*map(unbundle, answers["data"].to_pylist()))):
                of = np.empty(len(q.order))
                of[q.order] = restored(np.concatenate(x))
                to[q.asked] = of[q.place]
        starts = np.cumsum(q.sizes) - q.sizes
        sums = [np.add.reduceat(x, starts) for x in ((q.c > 0)[q.codes].astype(np.int64), np.log10(p), np.log10(a + b * p))]
        ids = given["doc_id"][0].values
        return pa.Table.from_arrays([ids, pa.array(q.held > 0), pa.array(q.sizes), pa.array(sums[0]), pa.array(np.full(len(ids), total)), *map(pa.array, sums[1:])], schema=schema)

    return known.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
