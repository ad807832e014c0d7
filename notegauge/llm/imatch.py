"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only.

The lexicon is the band of terms that neither nearly all documents nor hardly any
hold. A document's distinct terms in the band, sorted, are hashed once whole and
once for each of the fixed random subsets of the lexicon. Subsets come at falling
rates, so for short and long texts alike some of them hold a term or two: those
survive an edit elsewhere in the text, and the share of subsets that two documents
hash alike, of those that either has terms in, is their likeness.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegauge.llm.common import SPACE, checkpointed, partitions

#: Terms in at least and at most these shares of the documents. There are at most
#: (mean distinct terms of a document) / LOW such terms, whatever the size of the corpus.
LOW, HIGH = 0.005, 0.2
#: Rates 2**-1 to 2**-RATES, so many subsets each.
RATES, SUBSETS, SEED = 9, 14, 11
#: Documents to a bucket of neighbouring doc_ids, at most, while there are no more than BUCKETS buckets; they grow beyond.
BUCKET, BUCKETS = 1024, 1 << 17
#: Buckets are looked up in three steps, in so many borders each at most.
WIDTH = 64


def terms(text: Column) -> Column:
    """The words of a text in lower case; none for null and blank texts."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text: str = "text") -> list[int]:
    """Hashes of the terms in the band, from the document frequencies of all terms of all documents."""
    held = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    count = docs.count()
    band = held.groupBy("term").count().filter(F.col("count").between(F.lit(low * count), F.lit(high * count)))
    return sorted(r[0] for r in band.select(F.xxhash64("term")).collect())


def subsets(rates: int = RATES, each: int = SUBSETS, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(shift, bits, value): the terms whose hash, shifted, ends in these bits."""
    rng = random.Random(seed)
    return [(rng.randrange(64 - r), r, rng.randrange(1 << r)) for r in range(1, rates + 1) for _ in range(each)]


def fingerprint(df: DataFrame, text: str, out: str, lex: list[int]) -> DataFrame:
    """``df`` with ``out``, an array of one number from 1 to 65535 per subset, 0 where the text has no term in it.

    The first is the hash over the whole band, or over all terms of a text that has none in the band.
    """
    member = f"xxhash64(t) in ({', '.join(f'{h}L' if h > -(2**63) else 'bigint(-9223372036854775808)' for h in lex)})" if lex else "false"
    t, k = f"__{out}_terms", f"__{out}_keys"
    df = df.withColumn(t, terms(F.col(text)))
    df = df.withColumn(k, F.expr(f"transform(array_sort(array_distinct(filter(`{t}`, t -> {member}))), t -> xxhash64(t))"))
    squeeze = lambda h: f"cast(pmod({h}, 65535) + 1 as int)"
    whole = squeeze(f"if(size(`{k}`) > 0, xxhash64(`{k}`), xxhash64(array_sort(array_distinct(`{t}`))))")
    df = df.withColumn(f"__{out}_parts", F.expr("array(" + ", ".join(f"filter(`{k}`, h -> (shiftrightunsigned(h, {s}) & {(1 << r) - 1}L) = {v}L)" for s, r, v in subsets()) + ")"))
    numbers = F.expr(f"concat(array({whole}), transform(`__{out}_parts`, p -> if(size(p) = 0, 0, {squeeze('xxhash64(p)')})))")
    return df.withColumn(out, numbers).drop(t, k, f"__{out}_parts")


def likeness(a: str, b: str, rates: int = RATES, each: int = SUBSETS) -> Column:
    """Share of the subsets with terms on either side that hash alike, 0 to 1.

    A subset of rate 2**-r weighs 2**(r/2): the finer ones hold fewer terms each and tell more of how many are shared.
    """
    weights = "array(1D, " + ", ".join(f"{2 ** (r / 2)!r}D" for r in range(1, rates + 1) for _ in range(each)) + ")"
    total = lambda test: F.expr(f"aggregate(zip_with(zip_with({a}, {b}, (x, y) -> {test}), {weights}, (t, w) -> if(t, w, 0D)), 0D, (s, w) -> s + w)")
    return F.least(F.lit(1.0), total("x = y and x > 0") / total("x > 0 or y > 0"))


def text_form(fp: str) -> Column:
    return F.expr(f"array_join(transform({fp}, x -> lpad(lower(hex(x)), 4, '0')), '')")


def previous(buckets: DataFrame) -> DataFrame:
    """(q, s, before_q, before_s) for distinct (q, s): the next smaller pair, and the largest for the smallest.

    Neighbours are found inside each q, of which there are WIDTH at most; the first of a q follows the last of the q before.
    """
    inside = buckets.withColumn("__before", F.lag("s").over(Window.partitionBy("q").orderBy("s")))
    lasts = buckets.groupBy("q").agg(F.max("s").alias("last"))
    order, every = Window.partitionBy().orderBy("q"), Window.partitionBy()
    pair = F.struct("q", "last")
    over = lasts.select("q", F.coalesce(F.lag(pair).over(order), F.max(pair).over(every)).alias("over"))
    first = F.col("__before").isNull()
    return inside.join(F.broadcast(over), "q").select("q", "s", F.when(first, F.col("over.q")).otherwise(F.col("q")).alias("before_q"), F.when(first, F.col("over.last")).otherwise(F.col("__before")).alias("before_s"))


#: The order of rows: by doc_id, null first, then by the hash of the text; rows alike in both hold one text, and salt parts them.
ORDER = ("doc_id", "hash", "salt")
PLACE = "struct<doc_id:bigint,hash:bigint,salt:bigint>"


def borders(keys: DataFrame, count: int) -> list[tuple]:
    """The first key of each bucket, in order: every BUCKET-th row of each part of the sorted keys, so that no bucket has more rows.

    At most BUCKETS and one per part come to the driver, whatever the corpus.
    """
    size = max(BUCKET, -(-count // BUCKETS))
    order = [F.col(ORDER[0]).asc_nulls_first(), *ORDER[1:]]
    ranked = keys.repartitionByRange(partitions(keys.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    found = ranked.filter((F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) % size == 0).select(*ORDER).collect()
    return sorted((tuple(r) for r in found), key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with hash, salt, q and s: buckets that follow one another as the rows do, of BUCKET rows at most.

    Borders come from the sorted keys, so runs of doc_ids, gaps, ties and nulls make no
    bucket larger. Salt has only to spread rows that repeat, doc_id and text: any of
    them may be told apart in another order the next time.
    """
    spark = rows.sparkSession
    df = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    own = F.struct(*ORDER)
    found = borders(df.select(*ORDER), rows.count())
    leaves = [found[i : i + WIDTH] for i in range(0, len(found), WIDTH)] or [[]]
    upper = max(WIDTH, -(-len(leaves) // WIDTH))  # leaves to a q; more than WIDTH only where there are many parts
    below = lambda heads: F.greatest(F.lit(0), F.size(F.filter(heads, lambda b: b <= own)) - 1)
    literal = lambda k: F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(ORDER, k)])
    tops = [leaves[i][0] for i in range(0, len(leaves), upper) if leaves[i]]
    inner = [(i // upper, [leaf[0] for leaf in leaves[i : i + upper] if leaf]) for i in range(0, len(leaves), upper)]
    outer = [(i // upper, i % upper, leaf) for i, leaf in enumerate(leaves)]
    inner, outer = spark.createDataFrame(inner, f"q int, heads array<{PLACE}>"), spark.createDataFrame(outer, f"q int, __r int, leaf array<{PLACE}>")
    df = df.withColumn("q", below(F.array(*map(literal, tops))) if len(tops) > 1 else F.lit(0))
    df = df.join(F.broadcast(inner), "q").withColumn("__r", below(F.col("heads"))).drop("heads")
    df = df.join(F.broadcast(outer), ["q", "__r"]).withColumn("s", (F.col("__r") * WIDTH + below(F.col("leaf"))).cast("long"))
    return df.select("doc_id", "text", "hash", "salt", "q", "s")


def with_next(rows: DataFrame, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (doc_id, text), with what ``derive`` adds, and ``next_<column>`` of the row with the next doc_id; after the last comes the first.

    Rows move once, to buckets of neighbouring doc_ids. The first row of each bucket
    also goes to the bucket before, as the neighbour of its last row. Repeated
    doc_ids follow one another in the order of their texts' hashes, and so do null ones, which come first.
    """
    own = placed(rows)
    # the first rows by text alone: nothing is derived for rows that are not first
    heads = own.groupBy("q", "s").agg(F.min_by("text", F.struct(*ORDER)).alias("text"))
    before = previous(checkpointed(own.select("q", "s").distinct()))
    guests = heads.join(before, ["q", "s"]).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("salt"), F.col("before_q").alias("q"), F.col("before_s").alias("s"), F.lit(1).alias("__guest"))
    every = derive(own.withColumn("__guest", F.lit(0))).unionByName(derive(guests))
    carried = [c for c in every.columns if c not in ("q", "s", "__guest", *ORDER)]
    order = Window.partitionBy("q", "s").orderBy("__guest", *ORDER)
    led = every.select("__guest", "doc_id", *carried, *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.filter("__guest = 0").drop("__guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    Null texts are empty. Of a table with one row the row is its own neighbour.
    Columns besides doc_id and text are not read; an empty table gives an empty result.
    """
    lex = lexicon(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    led = with_next(rows, lambda df: fingerprint(df, "text", "fp", lex))
    led = led.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    led = led.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - __half as int))"), F.expr("substring(next_text, 1, __half)")))
    led = led.select("doc_id", "n_chars", "fp", "next_fp", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    led = fingerprint(led, "edited", "edited_fp", lex)
    return led.select(
        "doc_id", "n_chars", "edited_sha256", text_form("fp").alias("fingerprint"), text_form("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
