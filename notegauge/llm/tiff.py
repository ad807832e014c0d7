"""TIFF as a media column: a row per page of each file.

The reader walks the chain of image directories in either byte order, decodes
strips and tiles stored plain, as PackBits, LZW or deflate, undoes horizontal
differencing, and gives the samples of a page row by row. The writer makes small
baseline files of 8-bit samples in strips.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.runtime import ship

# Tags and codes of TIFF 6.0: fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PLAIN, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}

ROW = 64
STRIP_ROWS = 1024


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, width, last = bytearray(), [], 9, None
    bits = have = at = 0
    while True:
        while have < width:
            if at >= len(data):
                return bytes(out)
            bits, have, at = bits << 8 | data[at], have + 8, at + 1
        code = bits >> (have - width)
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += word
        last = word


def pack_lzw(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            out.append(bits >> (have - 8) & 255)
            have -= 8
            bits &= (1 << have) - 1

    put(256, 9)
    table, following, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
        if following >= 4094:
            put(256, width)
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data)


DECODERS = {PLAIN: bytes, LZW: unpack_lzw, PACKBITS: unpack_bits, ADOBE_DEFLATE: inflate, DEFLATE: inflate}
ENCODERS = {PLAIN: bytes, LZW: pack_lzw, PACKBITS: pack_bits, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1)}


@dataclass
class Page:
    number: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    data: bytes


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; raises ValueError for what is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            code = f"{order}{n}{TYPES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(code) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(code, data, place)
        yield _page(data, tags, number, order)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        number += 1


def _page(data: bytes, tags: dict, number: int, order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, samples = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(SAMPLES, 1)
    compression, predictor, planes = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1)
    if compression not in DECODERS or predictor not in (1, 2) or bits not in (8, 16, 32):
        raise ValueError(f"compression {compression}, predictor {predictor} or {bits} bits not supported")
    decode, kind = DECODERS[compression], np.dtype(f"{order}u{bits // 8}")
    deep = samples if planes == 1 else 1
    if TILE_OFFSETS in tags:
        w, h, offsets, counts = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height) or 1, tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across, down = -(-width // w) if w else 0, -(-height // h)
    out = np.zeros((samples if planes == 2 else 1, height, width, deep), kind)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        plane, rest = divmod(k, max(1, across * down))
        y, x = rest // max(1, across) * h, rest % max(1, across) * w
        rows = h if TILE_OFFSETS in tags else min(h, height - y)
        raw = np.frombuffer(decode(data[o : o + n]), kind, rows * w * deep).reshape(rows, w, deep)
        if predictor == 2:
            raw = np.cumsum(raw, axis=1, dtype=kind.newbyteorder("="))
        out[plane, y : y + rows, x : x + w] = raw[: height - y, : width - x]
    whole = out[0] if planes == 1 else np.moveaxis(out[..., 0], 0, -1)
    return Page(number, width, height, bits, samples, compression, whole.astype(kind.newbyteorder("=")).tobytes())


def write(samples: bytes, width: int = ROW, compression: int = ADOBE_DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian file of one page of 8-bit grey samples, ``width`` to a row."""
    height = len(samples) // width
    grid = np.frombuffer(samples, np.uint8, width * height).reshape(height, width)
    if predictor == 2:
        grid = np.diff(grid, axis=1, prepend=np.uint8(0))
    strips = [ENCODERS[compression](grid[i : i + strip_rows].tobytes()) for i in range(0, height, strip_rows)]
    offsets = (8 + np.concatenate(([0], np.cumsum([len(s) for s in strips])[:-1]))).astype(np.uint32)
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    lists = b"".join(np.asarray(x, "<u4").tobytes() for x in (offsets, [len(s) for s in strips]))
    at = 8 + len(body)
    many = len(strips) > 1
    entries = [
        (WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1),
        (STRIP_OFFSETS, 4, len(strips), at if many else int(offsets[0])), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, strip_rows),
        (STRIP_COUNTS, 4, len(strips), at + 4 * len(strips) if many else len(strips[0])), (PREDICTOR, 3, 1, predictor),
    ]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    lists = lists if many else b""
    return struct.pack("<2sHI", b"II", 42, at + len(lists)) + body + lists + directory


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def encode_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF of its UTF-8 bytes, with zeros up to whole rows of ROW samples."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                raw = [(t or "").encode() for t in b.column(1)[at : at + 512].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 512], pa.array([len(r) for r in raw], pa.int64()), pa.array([write(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """An average hash: which of 64 equal stretches of the samples are above the mean of all, as 16 hex digits."""
    if len(samples) < 64:
        samples = np.concatenate((samples, np.zeros(64 - len(samples), np.uint8)))
    means = samples[: len(samples) // 64 * 64].reshape(64, -1).mean(axis=1)
    return np.packbits(means > means.mean()).tobytes().hex()


#: What a page tells.
KINDS = {"page": "int", "width": "long", "height": "long", "bits": "int", "samples_per_pixel": "int", "samples": "binary", "feature": "string", "error": "string"}


def pages(files: DataFrame, media: str = "media") -> DataFrame:
    """A row per page of the TIFF files in column ``media``: page, width, height, bits,
    samples_per_pixel, samples (binary), feature, error; other columns pass through, under
    ``file_<name>`` where they have the name of one of these.

    A null or unreadable file gives one row with page null and the reason in error.
    """
    ship(files.sparkSession)
    files = files.withColumnsRenamed({c: f"file_{c}" for c in files.columns if c in KINDS and c != media})
    others = [c for c in files.columns if c != media]
    from pyspark.sql import types as T

    schema = T.StructType([*[files.schema[c] for c in others], *[T.StructField(k, T._parse_datatype_string(v)) for k, v in KINDS.items()]])
    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                own, rows = [], []
                for i, data in enumerate(b.column(len(others))[at : at + 512].to_pylist()):
                    try:
                        for p in read_pages(data or b""):
                            own.append(at + i)
                            rows.append((p.number, p.width, p.height, p.bits, p.samples, p.data, feature(np.frombuffer(p.data, np.uint8)), None))
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                        own.append(at + i)
                        rows.append((None,) * 7 + (str(e),))
                kept = [c.take(pa.array(own, pa.int64())) for c in b.columns[: len(others)]]
                made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, arrow)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*others, *KINDS])

    return files.select(*others, media).mapInArrow(run, schema)
