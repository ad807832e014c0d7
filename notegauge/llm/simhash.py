"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are made where the text is read. Distinct fingerprints fall into
tiles by the population counts of their four 16-bit quarters; two fingerprints
within the radius have counts that differ by at most the radius in sum, so a tile
meets only the tiles inside that ball and every other pair of tiles is skipped.
Inside a meeting numpy compares blocks by exclusive-or and bit counts, and skips
pairs of blocks whose population counts per byte are too far apart. Nothing is
approximate: each pair within the radius is compared. A tile of many rows is cut by
stretches of the bits, of which a pair within the radius shares one, so that a row
goes to a few parts of a tile however large it is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.llm.common import checkpointed, components, lookup_join, packed, partitions, unpacked, written
from notegauge.runtime import ship

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Rows of a tile that one meeting holds in memory, about; larger tiles are split, losslessly.
TILE_ROWS = 8192
#: Rows to a block inside a meeting.
BLOCK = 256


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text (ASCII case folded); 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n <= width:
        digests = xxhash.xxh64_digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_digest
        digests = b"".join([h(line[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())])
    return _majority(digests)


def _majority(digests: bytes) -> int:
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n, total = len(raw), np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):
        bits = np.unpackbits(raw[i : i + 255 * 256], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Null and empty texts have 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signature(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]


def half_ball(radius: int, dims: int = 4) -> list[tuple[int, ...]]:
    """Integer offsets of at most ``radius`` in sum whose first non-zero part is positive, and zero itself: each pair of tiles once."""
    every = itertools.product(range(-radius, radius + 1), repeat=dims)
    return [o for o in every if sum(map(abs, o)) <= radius and next((x for x in o if x), 0) >= 0]


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) between the representatives of ``distinct`` (fp, rep) that connect all fingerprints within the radius.

    Each meeting emits a spanning forest of its links, so a dense group gives as
    many edges as it has members and not as many as it has pairs.
    """
    ship(distinct.sparkSession)
    digits = [17**3, 17**2, 17, 1]
    code = lambda parts: sum((p * d for p, d in zip(parts[1:], digits[1:])), parts[0] * digits[0])
    rows = distinct.select("fp", "rep", *[p.alias(f"p{k}") for k, p in enumerate(_signature(F.col("fp")))])
    rows = rows.withColumn("tile", code([F.col(f"p{k}") for k in range(4)]).cast("int"))
    # at most 17**4 = 83,521 rows, whatever the input: safe to broadcast
    tiles = rows.groupBy("tile").count().select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    # of radius + 1 stretches of the bits two fingerprints within the radius have one in common: in a tile of many parts
    # a row goes to one part per stretch, whatever their number
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    stretches = [F.shiftrightunsigned(F.shiftleft("fp", 64 - z), 64 - z + a) for a, z in zip(cuts, cuts[1:])]
    own = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array(*[F.pmod(F.xxhash64(x), F.col("parts")).cast("int") + k * F.col("parts") for k, x in enumerate(stretches)]))
    here = rows.join(F.broadcast(tiles), "tile").select("tile", F.explode(own).alias("part"), F.lit(0).alias("side"), "fp", "rep")
    ball = F.array(*[F.struct(*[F.lit(x).alias(f"o{k}") for k, x in enumerate(o)]) for o in half_ball(radius) if any(o)])
    moved = rows.select("fp", "rep", "p0", "p1", "p2", "p3", F.explode(ball).alias("o"))
    moved = moved.filter(" and ".join(f"p{k} + o.o{k} between 0 and 16" for k in range(4)))
    moved = moved.select("fp", "rep", code([F.col(f"p{k}") + F.col(f"o.o{k}") for k in range(4)]).cast("int").alias("tile"))
    there = moved.join(F.broadcast(tiles), "tile").select("tile", F.explode(own).alias("part"), F.lit(1).alias("side"), "fp", "rep")
    n = partitions(distinct.sparkSession)
    met = here.unionByName(there).repartition(n, "tile", "part").sortWithinPartitions("tile", "part", "side")
    return met.mapInArrow(_meet(radius), "a long, b long")


def _meet(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, None
        for b in batches:
            tile, part, side, fp, rep = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            out: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if s == e:
                    continue
                k = (int(tile[s]), int(part[s]))
                if k != key:
                    key, home = k, Meeting(radius)
                (home.take if side[s] == 0 else home.compare)(fp[s:e], rep[s:e], out)
            if out:
                a, c = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return run


class Meeting:
    """The rows of one part of a tile, held, against streamed rows of other tiles and parts."""

    def __init__(self, radius: int):
        self.radius, self.fp, self.rep = radius, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parent: dict[int, int] = {}
        self.blocks: list | None = None

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = p.get(y, y)
            x = p[x]
        return x

    def take(self, fp, rep, out):
        old = self.fp, self.rep
        self._against(_blocks(fp, rep), _blocks(fp, rep), out, True)
        if len(old[0]):
            self._against(_blocks(*old), _blocks(fp, rep), out, False)
        self.fp, self.rep, self.blocks = np.concatenate((old[0], fp)), np.concatenate((old[1], rep)), None

    def compare(self, fp, rep, out):
        if self.blocks is None:
            self.blocks = _blocks(self.fp, self.rep)
        self._against(self.blocks, _blocks(fp, rep), out, False)
        for x in rep.tolist():  # streamed rows come once; forget them
            self.parent.pop(x, None)

    def _against(self, left, right, out, same):
        for i, (f, r, lo, hi) in enumerate(left):
            for g, s, lo2, hi2 in right[i:] if same else right:
                gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi)).sum()
                if gap > self.radius:
                    continue  # the population counts alone rule out this pair of blocks
                near = np.bitwise_count(f[:, None] ^ g[None, :]) <= self.radius
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                # pairs inside one group tell nothing new: a dense group costs one pass and not one step per pair
                apart = self._roots(r)[x] != self._roots(s)[y]
                for a, b in zip(r[x[apart]].tolist(), s[y[apart]].tolist()):
                    self._join(a, b, out)

    def _roots(self, rep: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, rep.tolist()), np.int64, len(rep))

    def _join(self, a, b, out):
        # a is held, so the root of a group with a held row is held: streamed rows can be forgotten
        p, q = self.root(a), self.root(b)
        if p != q:
            self.parent[q] = p
            out.append((a, b))


def _blocks(fp: np.ndarray, rep: np.ndarray) -> list:
    """(fps, reps, lowest and highest population counts of each byte), rows with like counts together."""
    counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    order = np.lexsort(counts.T)
    fp, rep, counts = fp[order], rep[order], counts[order]
    return [(fp[i : i + BLOCK], rep[i : i + BLOCK], counts[i : i + BLOCK].min(axis=0), counts[i : i + BLOCK].max(axis=0)) for i in range(0, len(fp), BLOCK)]


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: component_id is the
    smallest doc_id reachable over links of at most ``radius`` differing bits.

    Null, empty and wordless texts share fingerprint 0 and link like any other.
    Repeated rows stay repeated. Rows whose doc_id is null join the component of
    their fingerprint but name none (null if they are alone). Columns besides
    doc_id and the text are not read. An empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, text))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    edges = links(distinct.filter("rep is not null"), radius)
    label = components(edges).withColumnsRenamed({"node": "rep"})
    named = checkpointed(distinct.join(label, "rep", "left").select("fp", "n", F.coalesce("label", "rep").alias("component_id")))
    return lookup_join(marked, named, ["fp"], "n")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- near copies by similarity: bands of a sketch bring rows together, SimHash and sketch find candidates, their word shingles decide

#: Near copies share this much of their shingles of WIDE words. Sketches of SKETCH bytes only rule out pairs whose estimate is SLACK below it, 4.5 standard errors.
SIMILARITY, SLACK, WIDE, SKETCH = 0.8, 0.16, 5, 128
#: Bits in which the SimHashes of candidates differ at most.
WIDE_RADIUS = 20
#: Rows meet that agree in one of BANDS stretches of BAND bytes of their sketches: of pairs at the similarity 99.8 % do, of closer ones more; README has the recall by kind of edit.
BANDS, BAND, FIRST = 21, 6, 4
#: Rows (a number each) that are broadcast at most.
FEW_ROWS = 1_000_000
#: Rows, and shingles, to a part of a tile; rows of a large tile that its parts have in common at first.
PART_ROWS, PART_SHINGLES, LEADERS = 2048, 2_000_000, 64
_FACTORS = np.random.default_rng(SEED).integers(0, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)


def sketch(text: str | None, width: int = WIDE) -> tuple[np.ndarray, bytes]:
    """(hashes of the distinct shingles, ascending; low bytes of their SKETCH minima): equal bytes estimate the Jaccard similarity."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint32), bytes(SKETCH)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line, k = b" ".join(words), max(1, len(words) - width + 1)
    h = xxhash.xxh32_intdigest
    found = {h(line[a:b]) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist())}
    values = np.sort(np.fromiter(found, np.uint32, len(found)))
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    for i in range(0, len(values), 4096):
        np.minimum(low, (values[i : i + 4096, None] * _FACTORS).min(axis=0), out=low)
    return values, ((low ^ low >> np.uint32(8) ^ low >> np.uint32(16)) & np.uint32(255)).astype(np.uint8).tobytes()


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, size, sketch, grams, key): grams holds the shingles' hashes, texts of the same words have equal keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            made = [sketch(t) for t in texts]
            size = pa.array([len(x) for x, _ in made], pa.int64())
            grams = pa.array([packed(np.diff(x, prepend=np.uint32(0))) for x, _ in made], pa.binary())
            keys = pa.array([xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), size, pa.array([x for _, x in made], pa.binary()), grams, keys], ["doc_id", "fp", "size", "sketch", "grams", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long, size long, sketch binary, grams binary, key binary")


def similar_links(labelled: DataFrame, grams: DataFrame, first: bool, radius: int = WIDE_RADIUS, similarity: float = SIMILARITY, part_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between labels of ``labelled`` (row, label, fp, size, sketch) that have similar rows; ``grams`` has (row, grams).

    Rows meet in tiles, one per band of the sketch and its value; tiles whose rows all
    have one label are left out. A tile is held in parts. In the ``first`` pass, over a
    few bands, the parts of a large tile share some of its rows as leaders, which is
    enough to join the parts of a dense group. In the second, over all bands, the rows
    that do not have the tile's commonest label go to all its parts, so that every pair
    of rows with different labels meets and a dense group costs little.
    """
    ship(labelled.sparkSession)
    bands = F.expr(f"transform(sequence(0, {(FIRST if first else BANDS) - 1}), i -> xxhash64(i, substring(sketch, i * {BAND} + 1, {BAND})))")
    placed = labelled.filter("size > 0").select(F.explode(bands).alias("tile"), "row", "label", "size")
    if first:  # each row is its own label
        tiles = placed.groupBy("tile").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.lit(None).cast("long").alias("main")).filter("n > 1")
        shared = F.pmod(F.xxhash64("row"), F.col("rows")) < LEADERS
    else:
        tiles = placed.groupBy("tile", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        tiles = tiles.groupBy("tile").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("labels")).filter("labels > 1")
        shared = F.col("label") != F.col("main")
    parts = F.greatest(F.ceil(F.col("n") / (part_rows or PART_ROWS)), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    tiles = checkpointed(tiles.select("tile", "n", F.col("n").alias("rows"), parts.alias("parts"), "main"))
    member = lookup_join(placed, tiles, ["tile"], "n").filter("parts is not null")
    member = member.withColumn("home", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("shared", (F.col("parts") > 1) & shared)
    places = F.when(F.col("shared"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
    member = member.select("tile", "row", "label", "home", F.explode(places).alias("part"))
    member = checkpointed(member)
    meeting_rows = member.select("row").distinct()
    if meeting_rows.count() <= FEW_ROWS:  # only their shingles need to move; of more rows all do
        grams = grams.join(F.broadcast(meeting_rows), "row", "left_semi")
    met = member.join(labelled.select("row", "fp", "sketch"), "row").join(grams, "row").select("tile", "part", (F.col("part") != F.col("home")).cast("int").alias("side"), "label", "fp", "sketch", "grams")
    met = met.repartition(partitions(labelled.sparkSession), "tile", "part").sortWithinPartitions("tile", "part", "side")
    need = SKETCH * ((similarity - SLACK) * 255 / 256 + 1 / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = SimilarMeeting(radius, similarity, need)
        key, waiting = None, []
        for b in batches:
            tile, part, side = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            cuts = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if s == e:
                    continue
                if (k := (tile[s], part[s])) != key:
                    meeting.hold(waiting)
                    key, waiting, meeting.held = k, [], None
                if side[s] == 0:
                    waiting.append(b.slice(s, e - s))
                else:
                    meeting.hold(waiting)
                    waiting = []
                    meeting.compare(b.slice(s, e - s))
            yield meeting.edges()
        meeting.hold(waiting)
        yield meeting.edges()

    return met.mapInArrow(run, "a long, b long")


class Rows:
    """Rows in a meeting, those with like population counts together."""

    def __init__(self, batches: list[pa.RecordBatch]):
        b = pa.concat_batches(batches)
        fp = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        counts = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)
        order = np.lexsort(counts.T)
        self.fp, self.label = fp[order], b.column(3).to_numpy(zero_copy_only=False)[order]
        self.sketch = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        self.grams, self.order, self.sets = b.column(6), order, {}
        cuts = range(0, len(fp), BLOCK)
        self.blocks = [(i, counts[order[i : i + BLOCK]].min(axis=0), counts[order[i : i + BLOCK]].max(axis=0)) for i in cuts]

    def set(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = np.cumsum(unpacked(self.grams[int(self.order[i])].as_py()))
        return self.sets[i]


class SimilarMeeting(Meeting):
    """A part of a tile, held, against itself and against streamed rows; links labels with similar rows."""

    def __init__(self, radius: int, similarity: float, need: float):
        super().__init__(radius)
        self.similarity, self.need, self.held, self.out = similarity, need, None, []

    def hold(self, batches: list[pa.RecordBatch]) -> None:
        if batches:
            self.held = Rows(batches)
            self.meet(self.held, self.held)

    def compare(self, streamed: pa.RecordBatch) -> None:
        if self.held is not None:
            self.meet(self.held, Rows([streamed]))

    def edges(self) -> pa.RecordBatch:
        a, b = np.array(self.out, np.int64).reshape(-1, 2).T
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def meet(self, left: Rows, right: Rows) -> None:
        for k, (i, lo, hi) in enumerate(left.blocks):
            for j, lo2, hi2 in right.blocks[k:] if left is right else right.blocks:
                if np.maximum(0, np.maximum(lo - hi2, lo2 - hi)).sum() > self.radius:
                    continue  # the population counts alone rule out this pair of blocks
                x, y = np.nonzero(np.bitwise_count(left.fp[i : i + BLOCK, None] ^ right.fp[None, j : j + BLOCK]) <= self.radius)
                if not len(x):
                    continue
                # pairs inside one group tell nothing new: a dense group costs one pass and not one step per pair
                apart = self._roots(left.label[i : i + BLOCK])[x] != self._roots(right.label[j : j + BLOCK])[y]
                x, y = x[apart] + i, y[apart] + j
                for at in range(0, len(x), 1 << 14):
                    p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                    like = (left.sketch[p] == right.sketch[q]).sum(axis=1) >= self.need
                    for a, b in zip(p[like].tolist(), q[like].tolist()):
                        self.decide(left, a, right, b)

    def decide(self, left: Rows, a: int, right: Rows, b: int) -> None:
        p, q = self.root(int(left.label[a])), self.root(int(right.label[b]))
        if p != q:
            x, y = left.set(a), right.set(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            # decimals such as 0.8 are not exact: 4 of 5 are similar
            if both >= self.similarity * (len(x) + len(y) - both) - 1e-9:
                self.parent[q] = p
                self.out.append((p, q))


def similar_groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, part_rows: int | None = None) -> DataFrame:
    """(doc_id, component_id): groups of near copies, whose shingles of WIDE words are similar; as near_groups() otherwise.

    Shingles are told apart by 32-bit hashes, texts by 128 bits. Texts without words are one group."""
    marked = written(sketched(docs, text).withColumn("row", F.monotonically_increasing_id()), "sketched")
    # rows of one key are equal; where doc_ids repeat, each text has a row that stands for it
    first = F.min(F.struct("row", "fp", "size", "sketch")).alias("first")
    distinct = checkpointed(marked.groupBy("key").agg(F.min("doc_id").alias("doc"), first, F.count("*").alias("n")).select("key", "doc", "n", "first.*"))
    grams, live = marked.select("row", "grams"), distinct.filter("doc is not null")
    found = checkpointed(similar_links(live.withColumn("label", F.col("row")), grams, True, similarity=similarity, part_rows=part_rows))
    label = components(found).withColumnsRenamed({"node": "row"})
    labelled = checkpointed(live.join(label, "row", "left").withColumn("label", F.coalesce("label", "row")))
    more = checkpointed(similar_links(labelled, grams, False, similarity=similarity, part_rows=part_rows))
    label = components(found.unionByName(more)).withColumnsRenamed({"node": "row"})
    grouped = checkpointed(distinct.join(label, "row", "left").select("key", "n", "doc", F.coalesce("label", "row").alias("group")))
    smallest = grouped.groupBy("group").agg(F.min("doc").alias("component_id"), F.count("*").alias("keys"))
    named = checkpointed(lookup_join(grouped, smallest, ["group"], "keys").select("key", "n", "component_id"))
    return lookup_join(marked.select("doc_id", "key"), named, ["key"], "n").select("doc_id", "component_id")


def dedup(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, part_rows: int | None = None) -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest
    doc_id stays (all of them, where that row is repeated); all columns are kept.
    Rows with a null doc_id have no identity to group by and stay."""
    groups = similar_groups(docs, text, similarity, part_rows)
    gone = groups.filter("component_id is not null and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
