"""The text sink whose lines never pass through the driver."""

import os
import random

import pytest
from pyspark.sql import functions as F

from notegauge.sources import ordered


def lines_of(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 0, 1, 3, 9]), rng.randrange(40), f"é{i} " + "x" * rng.randrange(30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "section int, key int, line string").repartition(7)


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_equal_bytes(spark, tmp_path, n):
    rows, lines = lines_of(spark, n)
    blocks = ["head é\n", 1, "", 0, "between\n", 2, 3, "no end of line"]
    path = str(tmp_path / "out.txt")
    ordered.write(path, blocks, lines, ["key", "line"], str.upper)
    own = lambda s: "".join(line.upper() + "\n" for _, line in sorted((k, x) for sec, k, x in rows if sec == s))
    want = "".join(own(b) if isinstance(b, int) else b for b in blocks)
    assert open(path, encoding="utf-8", newline="").read() == want == ordered.text(blocks, lines, ["key", "line"], str.upper)
    assert os.listdir(tmp_path) == ["out.txt"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "out.txt"
    path.write_text("old")
    _, lines = lines_of(spark, 50)
    with pytest.raises(Exception, match="stop"):
        ordered.write(str(path), [0], lines.withColumn("line", F.when(F.col("key") >= 0, F.raise_error(F.lit("stop"))).otherwise(F.col("line"))), ["key"])
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["out.txt"]


def test_lines_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    """What the driver collects is a row per task and section."""
    _, lines = lines_of(spark, 5000)
    seen = []
    frame = type(lines)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    monkeypatch.setattr(frame, "toLocalIterator", None)
    ordered.write(str(tmp_path / "out.txt"), [0, 1, 3, 9], lines, ["key", "line"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < sum(map(len, seen)) <= 4 * parts
    assert len(open(tmp_path / "out.txt").readlines()) == 5000
