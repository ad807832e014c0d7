"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Slot i of the schedule is the point frac(i * golden ratio) in whole numbers, mapped through
the cumulative target shares to a source; the r-th slot of a source takes its r-th
block of BLOCK words. Blocks cut the source's documents, laid end to end in a
shuffled order and repeated pass by pass. What a document gives is the overlap of
its words with the blocks that slots reach.

Words, blocks and slots are counted in two levels (sums per bucket, then inside
each bucket), so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegauge.llm.common import SPACE, checkpointed, prefix_sums, written

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words to a block, where the corpus is large; small ones have SLOTS slots.
BLOCK, SLOTS = 512, 4096
#: Neighbouring Fibonacci numbers, the largest below 2**63: slot i lies at i * GOLDEN modulo CIRCLE. All quotients of their ratio's continued
#: fraction are 1, as the golden ratio's, so points stay as even up to CIRCLE slots; in doubles late ones would lie on a coarse grid.
GOLDEN, CIRCLE = 4660046610375530309, 7540113804746346429
#: Points to a cell of the grid on which points and sources meet: some 3700 cells.
CELL = 51
#: Of any n golden-ratio points, the number in an interval differs from n times its length by less than 2 + log(n) (the
#: quotients of the ratio's continued fraction are all 1), so by less than REACH for every n below CIRCLE: no source has more
#: slots beyond its target.
REACH = 64
#: Slots per bucket, and documents to a bucket of a source on average.
RUN = 1 << 14
SPREAD = 512


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, position, target) of ``sizes`` (source, source_size).

    Weights 5, 2, 1 repeat over the sources by code point, null last. A target is
    min(3 * size, level * weight), where the level makes all targets sum to all
    sizes: what capped sources cannot take is shared by weight among the others
    until none is above its cap. One row per source is all that these windows see.
    """
    everything = Window.partitionBy()
    position = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("position") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = sizes.withColumn("position", position).withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "position")
    # sources before this one in the order of cap/weight are capped; this and later ones share what is left
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("sharing", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("sharing"))
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("position"), F.col("level")))).over(everything)["level"]
    t = t.withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
    return t.select("source", "source_size", "position", F.when(F.col("total") > 0, F.col("target")).otherwise(0.0).alias("target"))


def point(slot: Column) -> Column:
    """The point of a slot (below 10**18), a whole number below CIRCLE."""
    return ((slot.cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(19,0)")) % F.lit(CIRCLE).cast("decimal(19,0)")).cast("long")


def intervals(plan: DataFrame) -> DataFrame:
    """(position, target, lo, hi): the points from lo to hi, both included, of each source with a target."""
    total = Window.partitionBy()
    upto = total.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    share = plan.filter("target > 0").withColumn("share", F.sum("target").over(upto) / F.sum("target").over(total))
    share = share.withColumn("end", F.least(F.floor(F.col("share") * F.lit(float(CIRCLE))), F.lit(CIRCLE - 1)))
    share = share.withColumn("lo", F.coalesce(F.lag("end").over(total.orderBy("position")), F.lit(0).cast("long")))
    share = share.withColumn("hi", F.when(F.col("position") == F.max("position").over(total), F.lit(CIRCLE - 1)).otherwise(F.col("end") - 1))
    return share.filter("lo <= hi").select("position", "target", "lo", "hi")


def slots(plan: DataFrame, count: int, block: int) -> DataFrame:
    """(position, rank): for each of ``count`` golden-ratio points the source it falls to, ranked per source from 0.

    A source with more slots than its target and REACH, which the points rule out, would lose those: it is an error.
    """
    spark = plan.sparkSession
    # each source in the cells of the grid that it touches: as many rows as cells and sources for an equi-join
    cell = lambda c: F.shiftright(c, CELL)
    cells = intervals(plan).select("*", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    points = spark.range(count).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    drawn = points.withColumn("cell", cell("x")).join(cells, "cell").filter("x between lo and hi")
    drawn = drawn.select("slot", "position", "target", F.floor(F.col("slot") / RUN).alias("__bucket"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_sums(drawn, ["position"], "__bucket", ["slot"], "one", "rank")
    within = F.col("rank") * block < F.col("target") + REACH * block
    return ranked.select("position", F.when(within, F.col("rank")).otherwise(F.raise_error(F.lit("more slots than a target reaches")).cast("long")).alias("rank"))


def mix(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``, and the columns ``carried``.

    ``taken`` is how many of the document's words the mix takes, repeats counted:
    0 for documents without words, never above REPEATS times the size. Null sources
    are a source of their own, last in order; null texts have size 0. Repeated rows
    and ties of the shuffle stay in order of doc_id, then size. Reruns agree: the shuffle is
    a hash of doc_id. Columns besides doc_id, text and source are not read; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), *carried)
    rows = checkpointed(rows)
    plan = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(BLOCK, total // SLOTS))
    n_slots = total // block
    bits = min(31, (count // SPREAD).bit_length())
    named = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("doc_id", rows["source"], "size", "source_size", "position", "target", *carried)
    mixed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # buckets are ranges of the hash, so that the order of the shuffle does not depend on their number
    spread = named.withColumn("__mix", mixed).withColumn("__bucket", F.shiftright(F.conv(F.substring("__mix", 1, 8), 16, 10).cast("long"), 32 - bits))
    laid = prefix_sums(spread, ["position"], "__bucket", ["__mix", "doc_id", "size"], "size", "begin")
    laid = checkpointed(laid.withColumn("__row", F.monotonically_increasing_id()))
    # every pass over a source that its target may reach puts the document somewhere in the block stream
    runs = laid.filter("size > 0").select("__row", "position", "size", "source_size", F.explode(F.expr(f"sequence(0, {REPEATS - 1})")).alias("turn"), "begin", "target")
    runs = runs.withColumn("begin", F.col("begin") + F.col("turn") * F.col("source_size")).filter(F.col("begin") < F.col("target") + F.lit(REACH * block))
    pieces = runs.select("__row", "position", "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.expr(f"sequence(floor(begin / {block}), floor((begin + size - 1) / {block}))")).alias("rank"))
    reached = pieces.join(slots(plan, n_slots, block), ["position", "rank"])
    got = F.least(F.col("end"), (F.col("rank") + 1) * block) - F.greatest(F.col("begin"), F.col("rank") * block)
    taken = reached.groupBy("__row").agg(F.sum(got).alias("taken"))
    return laid.join(taken, "__row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *carried)


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in whole copies (taken / size, rounded).

    Rows without words add nothing to a mix of words and stay once.
    """
    # rows have numbers of their own, since doc_ids may be null or repeat; written, so that both readings agree on them
    rows = written(docs.withColumn("__number", F.monotonically_increasing_id()), "mix")
    share = mix(rows.select("doc_id", "text", "source", "__number"), "__number")
    share = share.select("__number", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("__copies"))
    joined = rows.join(share.filter("__copies > 0"), "__number")
    return joined.select(*docs.columns, F.explode(F.expr("sequence(1, __copies)")).alias("__copy")).drop("__copy")
