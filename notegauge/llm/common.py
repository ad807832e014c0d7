"""Plumbing shared by the training-data operators: shared-folder checkpoints,
skew-proof joins, prefix sums and exact connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegauge.runtime import give_back, shared_dir

#: ASCII white space, as the contracts write it.
SPACE = r"[\x20\x09-\x0D]"
#: Edges to a task when components are looked for, and the fewest tasks.
EDGES, LEAST_TASKS = 50_000, 8
#: A key with at least total/HOT rows is hot: at most HOT keys can be, so the hot side of a join has a fixed bound.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor costs one task and not the plan above."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/notegauge-{name}-{uuid.uuid4().hex}"


_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks: the last large object only, so that stages do not pile up in one worker."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove what lies at ``path`` when it ends."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """As checkpointed(), in compressed Parquet, for wide rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(schema: T.StructType, **columns: str) -> T.StructType:
    """``schema`` with more columns (name=type); the given schema, which a DataFrame caches, is left as it is."""
    more = [T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()]
    return T.StructType([*schema.fields, *more])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, key: list[str], weight: str) -> DataFrame:
    """left outer join of ``left`` with ``right``, whose keys are unique and whose
    column ``weight`` is the number of rows with the key on the left.

    Keys with a thousandth of all rows or more go by broadcast (they are at most
    HOT by construction); no other key can fill a task, so the rest is a plain
    shuffled join. Both inputs should be materialised: they are read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT >= max(total, HOT * 100)
    values = [c for c in right.columns if c not in (*key, weight)]
    hot, cold = right.filter(is_hot), right.filter(~is_hot)
    marked = left.join(F.broadcast(hot.select(*key, *values, F.lit(True).alias("__hot"))), key, "left")
    done = marked.filter("__hot").select(*left.columns, *values)
    rest = marked.filter("__hot is null").select(*left.columns).join(cold.select(*key, *values).hint("merge"), key, "left")
    return done.unionByName(rest.select(*left.columns, *values))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of the edges with the smallest node it can reach.

    Alternating large-star and small-star rounds; every round aggregates minima
    map-side before it shuffles and ends in a shared checkpoint. The neighbours of a
    hub, which the large star leaves behind, do not meet in one task: its minimum goes
    to them. The rounds grow
    with the logarithm of the longest chain. Nothing is collected.
    """
    edges = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    # few edges are dealt to few tasks, in proportion: a round is a dozen small steps, whose files would outweigh the rows
    tasks = max(LEAST_TASKS, -(-edges.count() // EDGES))
    few = lambda df: df.coalesce(tasks)
    edges = few(edges)
    while True:
        # large star: all larger neighbours of a node join its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        near = lookup_join(few(both), checkpointed(few(low)), ["u"], "n").filter("v > u")
        large = checkpointed(few(few(near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")).distinct()))
        # small star: a node and its smaller neighbours join the smallest of them
        low = few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = few(large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        following = checkpointed(few(few(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct()))
        # done when every node points straight at a root: no node has two, none of those pointed at points on
        if following.join(following.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            if following.groupBy("u").count().filter("count > 1").isEmpty():
                break
        edges = following
    roots = following.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return following.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` before each row, per group in (bucket, order) order.

    Two levels: sums per (group, bucket) give each bucket its offset, and a window
    inside the bucket gives the rest, so one group may hold any share of the rows.
    """
    from pyspark.sql import Window

    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = reduce(lambda x, y: x & y, [local[c].eqNullSafe(offsets[c]) for c in (*group, bucket)])
    joined = local.join(offsets, on)
    return joined.select(*[local[c] for c in df.columns], (local["__local"] + offsets["__offset"]).alias(out))


def packed(x: np.ndarray) -> bytes:
    """Non-negative whole numbers in their least width, by byte planes, deflated where that pays."""
    n = len(x)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    small = pa.compress(planes, codec="zstd", asbytes=True) if len(planes) > 64 else planes
    body, mark = (small, 1) if len(small) < len(planes) else (planes, 0)
    return n.to_bytes(6, "little") + bytes([width, mark]) + body


def unpacked(data: bytes) -> np.ndarray:
    n, width, mark, body = int.from_bytes(data[:6], "little"), data[6], data[7], data[8:]
    planes = pa.decompress(body, decompressed_size=n * width, codec="zstd", asbytes=True) if mark else body
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()
