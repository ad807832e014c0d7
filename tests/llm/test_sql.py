"""The training-data queries that SQL can express against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from notegauge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_is_answered(spark, name):
    """Whole tables: a row per document, page or vector, pieces of every document, or rows of every source."""
    got = queries.QUERIES[name](spark, SF)
    table, key = {"op4_warc": ("pages", "page_id"), "op11_annulus_clusters": ("embeddings", "vec_id"), "op12_source_divergence": ("documents", "source")}.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    found = [r[key] for r in got.select(key).collect()]
    assert set(found) == ids and (len(found) == len(ids) or name in ("op9_packing", "op12_source_divergence"))
