"""Getting the package to where it runs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers, which may start elsewhere than in the repository; once per context."""
    sc = (spark or SparkSession.active()).sparkContext
    if getattr(sc, "_notegauge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="notegauge-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "notegauge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._notegauge_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the session's checkpoint folder. Where none is named, one of our own, which
    only a session on one machine can do with: elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="notegauge-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A folder in the shared one, gone when the driver ends."""
    path = f"{shared_dir(spark)}/notegauge-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions, as a small single file does; otherwise as it is.

    For work that costs far more than moving the rows. Large inputs have more splits than cores and do not move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on from stage to stage, and their memory counts beside the heap's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_slices(batch: pa.Array, make: Callable[[Any], Any], size: Callable[[Any], int], held: int, made_type: pa.DataType) -> Iterator[pa.Array]:
    """``make`` of each value of a batch, yielded as soon as values of ``held`` in size are made: the values become Python
    objects one by one, so that a batch of any size costs its Arrow form and one slice. After a large one, memory is given back."""
    made, since, slices = [], 0, 0
    for value in batch:
        value = value.as_py()
        made.append(make(value))
        since += size(value)
        if since >= held:
            yield pa.array(made, made_type)
            made, since, slices = [], 0, slices + 1
    if made:
        yield pa.array(made, made_type)
    if slices:
        give_back()
