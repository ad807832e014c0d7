"""Audit of how the sources of a language differ in their words, in exact whole numbers.

The first pass over the texts counts in how many documents of a language each term
occurs, and lays the texts out in chunks of bounded size. Terms fall into shards by a
hash; a chunk sends each shard the terms it has there, packed, and the shard adds up,
keeps what enough documents hold, numbers it and tells each chunk which of its terms
that are. In the second pass a chunk makes an automaton (pyahocorasick) of the kept
terms it has, padded with the delimiter on both sides, and counts their occurrences in
one run over each of its texts. So an automaton is bounded by its chunk, and no task
ever holds the vocabulary.

Counts return to the shards as sparse postings (language, source, term, count). Each
shard compares its languages' sources over its own terms, block by block of sources,
and sends one figure per pair and the most telling terms per source; the sums and the
best of these are the result. A language or source that holds most documents is many
chunks, and a frequent term is one entry per chunk.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegauge.llm.common import delete_on_exit, packed, scratch_path, unpacked
from notegauge.runtime import ship

LEAST, TOP = 10, 10
#: What shares are counted in, and what is added to every count.
UNIT, ADDED = 1_000_000_000, 2
#: Characters to a chunk, and to a piece of a long text.
CHUNK, PIECE = 12_000_000, 1_000_000
#: Bytes of text to a shard of terms, and the fewest shards.
SHARE, SHARDS = 32_000_000, 128
#: Sources to a block when a shard compares them.
BLOCK = 64
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
GAP = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]")
CHUNKS = "chunk long, shard int, lang string, source string, data binary, size int, held binary"
KEPT = "shard int, chunk long, lang string, data binary, size int, numbers binary, n int"
COUNTED = "shard int, langs array<string>, sources array<string>, groups binary, numbers binary, counts binary"
POSTINGS = "shard int, lang string, source string, numbers binary, counts binary, total long"
COMPARED = "part string, lang string, source string, item string, value long"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut where no term is."""
    start = 0
    while len(text) - start > size:
        gap = GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def terms(text: str) -> list[str]:
    """The terms of a text; only A-Z are lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def blob(text: str) -> tuple[bytes, int]:
    """A text compressed, and its size in bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unblob(data: bytes, size: int) -> str:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""


def shard_of(term: str, shards: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % shards


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    columns = [c.split(" ") for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)], [name for name, _ in columns])


class _Chunk:
    """Texts of some documents, and in how many of them each term is."""

    def __init__(self):
        self.texts: dict[tuple[str, str], list[str]] = {}
        self.held: dict[str, Counter] = {}
        self.size = 0

    def rows(self, number: int, shards: int) -> Iterator[pa.RecordBatch]:
        out = [(number, None, lang, source, *blob(" ".join(x)), None) for (lang, source), x in self.texts.items()]
        for lang, held in self.held.items():
            own: dict[int, list[str]] = {}
            for term in held:
                own.setdefault(shard_of(term, shards), []).append(term)
            out += [(number, shard, lang, None, *blob("\n".join(ts)), packed(np.array([held[t] for t in ts], np.int64))) for shard, ts in own.items()]
        yield from _table(out, CHUNKS).to_batches()


def _chunks(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                seen: set[str] = set()
                for piece in pieces(text):
                    found = terms(piece)
                    new = set(found)
                    held = chunk.held.setdefault(lang, Counter())
                    held.update(new - seen)
                    held.update(dict.fromkeys(new & seen, 0))  # asked for here, counted in an earlier piece
                    seen |= new
                    chunk.texts.setdefault((lang, source), []).append(" ".join(found))
                    chunk.size += len(piece) + len(lang) + len(source) + 16
                    if chunk.size >= CHUNK:
                        yield from chunk.rows(number, shards)
                        number, chunk = number + 1, _Chunk()
        if chunk.size:
            yield from chunk.rows(number, shards)

    return run


def _lists(rows: pa.Table) -> Iterator[tuple[int, str, list[str], bytes]]:
    """(chunk, lang, terms, the packed numbers beside them)."""
    for chunk, lang, data, size, beside in zip(*(rows.column(c).to_pylist() for c in ("chunk", "lang", "data", "size", "held" if "held" in rows.column_names else "numbers"))):
        yield chunk, lang, unblob(data, size).split("\n") if size else [], beside


def _vocabulary(least: int) -> Callable[[pa.Table], pa.Table]:
    def keep(rows: pa.Table) -> pa.Table:
        """Of a shard: per chunk its terms that ``least`` documents of the language hold, with their numbers; as chunk -1 all of them."""
        shard, held = rows["shard"][0].as_py(), {}
        for _, lang, names, counts in _lists(rows):
            own = held.setdefault(lang, {})
            for term, n in zip(names, unpacked(counts).tolist()):
                own[term] = own.get(term, 0) + n
        number = {lang: {t: i for i, t in enumerate(sorted(t for t, n in own.items() if n >= least))} for lang, own in held.items()}
        out = [(shard, -1, lang, *blob("\n".join(own)), packed(np.arange(0)), len(own)) for lang, own in number.items() if own]
        for chunk, lang, names, _ in _lists(rows):
            kept = [t for t in names if t in number[lang]]
            if kept:
                out.append((shard, chunk, lang, *blob("\n".join(kept)), packed(np.array([number[lang][t] for t in kept], np.int64)), len(kept)))
        return _table(out, KEPT)

    return keep


def _occurrences(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Per shard the occurrences in the texts of a chunk of the terms that are kept."""
    names: dict[str, list[str]] = {}
    place: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for shard, (_, lang, own, numbers) in zip(answers["shard"].to_pylist(), _lists(answers)):
        names.setdefault(lang, []).extend(own)
        place.setdefault(lang, []).append((np.full(len(own), shard), unpacked(numbers)))
    parts: dict[int, list[tuple[tuple[str, str], np.ndarray, np.ndarray]]] = {}
    for lang, own in names.items():
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(own):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        shard, number = (np.concatenate(x) for x in zip(*place[lang]))
        here = texts.filter(pc.equal(texts["lang"], lang))
        for source, data, size in zip(*(here[c].to_pylist() for c in ("source", "data", "size"))):
            hits = np.fromiter((i for _, i in automaton.iter(f" {unblob(data, size)} ")), np.int64)
            found, n = np.unique(hits, return_counts=True)
            order = np.argsort(shard[found], kind="stable")
            found, n = found[order], n[order]
            at, first = np.unique(shard[found], return_index=True)
            for s, ids, counts in zip(at.tolist(), np.split(number[found], first[1:]), np.split(n, first[1:])):
                parts.setdefault(s, []).append(((lang, source), ids, counts))
    out = []
    for s, own in parts.items():
        keys = list(dict.fromkeys(k for k, _, _ in own))
        at = {k: i for i, k in enumerate(keys)}
        groups = np.concatenate([np.full(len(ids), at[k]) for k, ids, _ in own])
        out.append((s, [k[0] for k in keys], [k[1] for k in keys], packed(groups), packed(np.concatenate([x[1] for x in own])), packed(np.concatenate([x[2] for x in own]))))
    return _table(out, COUNTED)


def _postings(rows: pa.Table) -> pa.Table:
    """Of a shard: per (language, source) its terms by number with their occurrences, and per language those of all sources (source null)."""
    shard, found = rows["shard"][0].as_py(), {}
    for langs, sources, groups, numbers, counts in zip(*(rows[c].to_pylist() for c in ("langs", "sources", "groups", "numbers", "counts"))):
        groups, numbers, counts = unpacked(groups), unpacked(numbers), unpacked(counts)
        for i, key in enumerate(zip(langs, sources)):
            own = groups == i
            found.setdefault(key, []).append((numbers[own], counts[own]))
            found.setdefault((key[0], None), []).append((numbers[own], counts[own]))
    out = []
    for (lang, source), own in found.items():
        numbers, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        counts = np.zeros(len(numbers), np.int64)
        np.add.at(counts, at, np.concatenate([x[1] for x in own]))
        out.append((shard, lang, source, packed(numbers), packed(counts), int(counts.sum())))
    return _table(out, POSTINGS)


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * size)) of whole numbers, exactly."""
    under = total + ADDED * size
    if under >= 2**53:  # else a thousand times a remainder fits in 64 bits
        return np.array([1 + UNIT * (c + ADDED) // under for c in counts.tolist()], np.int64)
    rest, found = counts + ADDED, (counts + ADDED) // under
    for _ in range(3):  # UNIT is 1000 ** 3
        rest = rest % under * 1000
        found = found * 1000 + rest // under
    return found + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, info: pa.Table) -> pa.Table:
        """Of a shard: per pair of sources of a language the sum of the differences over its terms, and per source its ``top`` most telling ones."""
        counted = {(r["lang"], r["source"]): (unpacked(r["numbers"]), unpacked(r["counts"])) for r in rows.to_pylist()}
        names, groups = {}, {}
        for r in info.to_pylist():
            if r["data"] is not None:
                names[r["lang"]] = unblob(r["data"], r["size"]).split("\n")
            else:
                groups.setdefault(r["lang"], {})[r["source"]] = (r["total"], r["terms"])
        out = []
        for lang, own in groups.items():
            total = own.pop(None)
            # without terms here every difference is 0; it is said once, by the first shard
            if lang not in names and info["shard"][0].as_py() != 0:
                continue
            n = len(names.get(lang, ()))
            sources = sorted(own)

            def dense(source: str | None) -> np.ndarray:
                counts = np.zeros(n, np.int64)
                if (lang, source) in counted:
                    numbers, found = counted[lang, source]
                    counts[numbers] = found
                return counts

            def block(names: list[str]) -> np.ndarray:
                return np.array([shares(dense(s), *own[s]) for s in names]) if n else np.ones((len(names), 0), np.int64)

            blocks = [sources[i : i + BLOCK] for i in range(0, len(sources), BLOCK)]
            for i, left in enumerate(blocks):
                p = block(left)
                for right in blocks[i:]:
                    q = p if right is left else block(right)
                    for j, a in enumerate(left):
                        begin = j + 1 if right is left else 0
                        value = difference(p[j], q[begin:]).sum(axis=1).tolist()
                        out += [("pair", lang, a, b, v) for b, v in zip(right[begin:], value)]
            if not n:
                continue
            every, label = shares(dense(None), *total), np.array(names[lang], object)
            for source in sources:
                counts = dense(source)
                p = shares(counts, *own[source])
                at = np.flatnonzero((counts > 0) & (p > every))
                value = difference(p[at], every[at])
                if len(at) > top:
                    most = value >= np.partition(value, -top)[-top]
                    at, value = at[most], value[most]
                best = sorted(zip((-value).tolist(), label[at].tolist()), key=lambda x: (x[0], x[1].encode("utf-8", "surrogatepass")))[:top]
                out += [("term", lang, source, term, -v) for v, term in best]
        return _table(out, COMPARED)

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; what it holds is compressed already."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Divergence:
    """The vocabulary, postings and differences of the documents (lang, source, text).

    Null texts, languages and sources are empty ones. Repeated rows count each. A group
    (language, source) without terms is one like any other. Other columns are not read.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST):
        ship(docs.sparkSession)
        docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = max(SHARDS, -(-size // SHARE))
        self.chunks = _kept(docs.mapInArrow(_chunks(self.shards), CHUNKS), "terms")
        asked = self.chunks.filter("shard is not null").select("shard", "chunk", "lang", "data", "size", "held")
        #: (shard, chunk, lang, data, size, numbers, n): the terms that ``least`` documents hold, of each chunk, and of all as chunk -1
        self.vocabulary = _kept(asked.groupBy("shard").applyInArrow(_vocabulary(least), KEPT), "vocabulary")
        texts = self.chunks.filter("shard is null").select("chunk", "lang", "source", "data", "size")
        answers = self.vocabulary.filter("chunk >= 0").select("chunk", "shard", "lang", "data", "size", "numbers")
        counted = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_occurrences, COUNTED)
        #: (shard, lang, source, numbers, counts, total)
        self.postings = _kept(counted.groupBy("shard").applyInArrow(_postings, POSTINGS), "postings")
        sizes = self.vocabulary.filter("chunk = -1").groupBy("lang").agg(F.sum("n").alias("terms"))
        totals = self.postings.groupBy("lang", "source").agg(F.sum("total").alias("total"))
        groups = texts.select("lang", "source").distinct()
        groups = groups.unionByName(groups.select("lang", F.lit(None).cast("string").alias("source")).distinct())
        joined = groups.join(totals.withColumnsRenamed({"lang": "l", "source": "s"}), (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
        #: (lang, source, total, terms): each group, and each language with source null; terms is the number of kept terms of the language
        self.groups = _kept(joined.join(sizes, "lang", "left").na.fill(0, ["total", "terms"]), "groups")

    def compared(self, top: int = TOP) -> DataFrame:
        """(part, lang, source, item, value): differences of each pair of sources, once, and terms that may be among the ``top`` of a source; by shard."""
        shard = F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard")
        none = lambda kind: F.lit(None).cast(kind)
        every = self.groups.select(shard, "lang", "source", none("binary").alias("data"), none("int").alias("size"), "total", "terms")
        names = self.vocabulary.filter("chunk = -1").select("shard", "lang", none("string").alias("source"), "data", "size", none("long").alias("total"), none("long").alias("terms"))
        postings = self.postings.select("shard", "lang", "source", "numbers", "counts")
        return _kept(postings.groupBy("shard").cogroup(every.unionByName(names).groupBy("shard")).applyInArrow(_compare(top), COMPARED), "compared")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language, and its most telling terms.

    Ties rank by item in UTF-8 order. A language without kept terms has differences of
    0 and no terms; an empty table gives an empty result.
    """
    found = Divergence(docs, least).compared(top)
    sums = found.filter("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("part", "lang", pair.alias("pair"), "value").select("part", "lang", "pair.source", "pair.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ("lang", "source", "part", "item", "value", "rank")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).select(*columns).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top).select(*columns))
