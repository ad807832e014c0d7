"""WARC archives: writing pages as records, and reading by a verified chain of boundaries.

Writing is one DataFrame write of text with the record separator as its line
separator, so Spark's own commit protocol covers lost tasks and any file system.

Reading trusts no magic by itself. The version line is the separator of a text scan,
so that splits of plain files (and whole compressed ones) are read as streams, and
every occurrence is only a candidate. From the lengths of the pieces follow the
offsets of the candidates, from their headers those of their successors. Per file,
pointer jumping over these links from offset 0 keeps the candidates that the chain
reaches; a version line inside a payload is never on it. Payloads stay where they were
read: a record that is one piece was hashed there, and only the pieces of the others
are brought together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegauge.llm.common import checkpointed, delete_on_exit, lookup_join, scratch_path
from notegauge.runtime import ship

MAGIC = "WARC/1.1\r\n"
CRLF = "\r\n"
END = "\r\n\r\n"
#: Payloads below this many bytes are never replaced by a revisit.
MIN_BYTES = 1000
#: Records to a file.
RECORDS = 4096
#: What a revisit of equal payloads is called.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, payload_bytes, refers_to.

    Of equal payloads of at least ``min_bytes`` bytes that with the largest page_id
    is kept (all rows that have it, where it is repeated) and the others refer to
    it. A null html is empty; a null page_id is never the largest.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_digest", F.sha1("html")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    copies = own.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    joined = lookup_join(own, checkpointed(copies), ["payload_digest"], "n")
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept")), F.col("kept"))).drop("kept")


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One text column: the records of decide()'s rows, without the separator that ends them.

    A response holds an HTTP answer with the payload as its body; a revisit has no block.
    """
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length(answer) + F.col("payload_bytes"))),
    )
    return pages.select(F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.concat(answer, F.col("html")))).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    rows = records(decide(pages, min_bytes))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def reachable(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Indices of the candidates on the chain from offset 0, by pointer jumping in log2(n) rounds."""
    n = len(offsets)
    if n == 0 or offsets[0] != 0:
        return np.zeros(0, np.int64)
    i = np.searchsorted(offsets, following)
    known = (i < n) & (offsets[np.minimum(i, n - 1)] == following)
    jump = np.append(np.where(known, i, n), n)  # n: the end of the file, or a broken link
    on = np.zeros(n + 1, bool)
    on[0] = True
    for _ in range(n.bit_length()):
        on[jump[on]] = True
        jump = jump[jump]
    return np.flatnonzero(on[:n])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, id, data) of what stands between version lines, in the order of the ids in a split that begins at ``start``."""
    raw = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")


def described(df: DataFrame, value: str = "value") -> DataFrame:
    """``df`` with what the bytes after a version line tell: head_bytes and length (null without a sound header), size, the record's fields, and
    payload_bytes and payload_digest if the whole record is there."""
    text = F.col(value)
    head = F.substring_index(text, END, 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(F.concat(F.lit(CRLF), F.col("__head")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    sound = F.contains(text, F.lit(END))
    df = df.withColumn("__head", F.when(sound, head)).withColumn("head_bytes", F.octet_length("__head").cast("long")).withColumn("size", F.octet_length(text).cast("long"))
    length = F.when(field("content-length").rlike(r"^\d{1,18}$"), field("content-length").cast("long"))
    df = df.withColumn("length", length).withColumn("kind", F.coalesce(field("warc-type"), F.lit("")))
    whole = F.col("size") >= F.col("head_bytes") + F.col("length") + 2 * len(END)
    block = F.when(whole, F.substring(text.cast("binary"), (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("length").cast("int")))
    df = df.withColumn("__block", block).withColumn("__http", F.coalesce(F.startswith(field("content-type"), F.lit("application/http")), F.lit(False)))
    told = F.octet_length(F.substring_index(F.col("__block").cast("string"), END, 1))
    answered = F.col("__http") & F.contains(F.col("__block").cast("string"), F.lit(END))
    payload = F.when(answered, F.substring(F.col("__block"), told + len(END) + 1, F.octet_length("__block"))).otherwise(F.col("__block"))
    number = lambda name: F.regexp_extract(F.coalesce(field(name), F.lit("")), r"<urn:x-page:(-?\d+)>", 1)
    visited = F.col("kind") == "revisit"
    return df.withColumn("__payload", payload).select(
        *[c for c in df.columns if c not in ("__head", "__block", "__http", value)],
        F.nullif(number("warc-record-id"), F.lit("")).cast("long").alias("page_id"), F.nullif(number("warc-refers-to"), F.lit("")).cast("long").alias("refers_to"),
        F.when(visited, field("x-payload-length").cast("long")).otherwise(F.octet_length("__payload").cast("long")).alias("payload_bytes"),
        F.when(visited, F.regexp_replace(field("warc-payload-digest"), "^sha1:", "")).otherwise(F.sha1("__payload")).alias("payload_digest"),
    )


def _chain(given: pa.Table) -> pa.Table:
    """(id, record, nth, whole) of the pieces of a file that belong to records on its chain: the id of the piece that a record begins
    with, the piece's number in the record, and whether the record is this piece alone."""
    given = given.sort_by([("start", "ascending"), ("id", "ascending")])
    ids, size, head, length = (given[c].to_numpy(zero_copy_only=False) for c in ("id", "size", "head_bytes", "length"))
    ends = np.cumsum(size + len(MAGIC)) - len(MAGIC)  # where each piece ends in the file
    offsets = ends[:-1]  # the version line before the next piece; the first piece is what stands before the first of them
    ids, size, head, length = ids[1:], size[1:], head[1:], length[1:]
    following = np.where(np.isnan(head + length), -1, offsets + len(MAGIC) + np.nan_to_num(head) + np.nan_to_num(length) + 2 * len(END)).astype(np.int64)
    following[following > ends[-1]] = -1  # cut off
    records = reachable(offsets, following)
    records = records[following[records] >= 0]
    owner = np.searchsorted(records, np.arange(len(ids)), side="right") - 1
    inside = np.flatnonzero((owner >= 0) & (offsets < following[records[np.maximum(owner, 0)]] if len(records) else owner >= 0))
    owner = records[owner[inside]]
    whole = following[owner] <= offsets[owner] + len(MAGIC) + size[owner]
    return pa.table({"id": ids[inside], "record": ids[owner], "nth": inside - owner, "whole": whole})


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path`` (plain, or compressed in any way Spark reads), payloads hashed as they were read.

    What is not on the chain from a file's start gives no row: junk before the first
    version line, all after a broken link, and a record cut off by the end.
    """
    ship(spark)
    told = checkpointed(described(pieces(spark, path)))
    numbers = told.select("file", "start", "id", "size", F.col("head_bytes").cast("double").alias("head_bytes"), F.col("length").cast("double").alias("length"))
    on = checkpointed(numbers.groupBy("file").applyInArrow(lambda t: _chain(t.select(["start", "id", "size", "head_bytes", "length"])), "id long, record long, nth long, whole boolean"))
    fields = ["page_id", "payload_bytes", "payload_digest", "kind", "refers_to"]
    found = told.join(on.filter("whole"), "id").select(*fields)
    parts = on.filter("not whole")
    if not parts.isEmpty():
        # a version line in the payload has cut the record: its pieces are read again, and only they travel
        again = pieces(spark, path).select("id", "value").join(parts, "id")
        joined = again.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
        found = found.unionByName(described(joined).select(*fields))
    return found.withColumnRenamed("kind", "record_type")


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: a row per page.

    Repeated rows give records of their own; empty tables give no record; columns
    besides page_id, url and html are not read.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    delete_on_exit(pages.sparkSession, path)
    return read(pages.sparkSession, path)
