"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from notegauge.llm import imatch, lines, lm, mixing, packing, simhash, tiff, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, label string, tile int"
LONG = "word " * 40000 + "end\n" + "x" * 70000
ROWS = [
    (1, "one two three four", "en", "a", 18, 1, 1, "x", 1),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0, 0, "", 0),
    (4, LONG, "en", "a", len(LONG), 2, 2, "y", 2),
    (5, "one two three four", "en", "a", 18, 1, 1, "x", 1),
    (5, "one two three four", "en", "a", 18, 1, 1, "x", 1),
    (None, "naïve café \x1c \x85 漢字 😀 <|endoftext|> it's", "fr", None, 3, 1, 1, "z", 1),
    (7, " \t\n\x0b\x0c\r ", "en", "b", 7, 1, 1, "x", 1),
]


def labels(spark, rows=((1, 0), (3, 1), (5, 1), (4, 0))):
    return spark.createDataFrame([(d, 1, t) for d, t in rows], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda s, d: simhash.near_groups(d),
    "simhash dedup": lambda s, d: simhash.dedup(d),
    "imatch": lambda s, d: imatch.fingerprints(d),
    "lm": lambda s, d: lm.scores(d),
    "tiff": lambda s, d: tiff.pages(tiff.encode_texts(d)),
    "warc": lambda s, d: warc.archive(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "label")),
    "lines": lambda s, d: lines.dedup(d),
    "toxicity": lambda s, d: toxicity.scores(d, labels(s)),
    "toxicity without labels": lambda s, d: toxicity.scores(d, labels(s).limit(0)),
    "mix": lambda s, d: mixing.mix(d),
    "packing": lambda s, d: packing.pack(d),
    "tokens": lambda s, d: tokens.token_counts(d),
}
ONE_ROW_EACH = set(OPERATORS) - {"packing", "simhash dedup"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    if name in ONE_ROW_EACH:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


#: Columns that say where a row comes from and not what its text is.
PLACES = {"doc_id", "page_id", "held_out", "source", "lang", "n_chars", "n", "fp", "label", "tile", "target", "source_size", "taken", "component_id", "refers_to", "record_type", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "file_fp"}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH - {"warc"}))
def test_equal_texts_have_equal_results(spark, docs, name):
    """A null text is an empty one, and repeated rows tell the same."""
    rows = [r.asDict() for r in OPERATORS[name](spark, docs).collect()]
    told = lambda d: [{k: v for k, v in r.items() if k not in PLACES and k != ("text" if name.startswith("tox") else "")} for r in rows if r["doc_id"] == d]
    assert told(2) == told(3)
    assert told(5)[0] == told(5)[1] == told(1)[0]


def test_values_of_odd_rows(spark, docs):
    """What the docstrings say of nulls, empty texts, repeats and rows without doc_id."""
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = by_id(simhash.near_groups(docs))
    assert near[1]["component_id"] == near[5]["component_id"] == 1 and near[2]["component_id"] == near[3]["component_id"] == near[7]["component_id"] == 2
    assert near[None]["component_id"] is None and near[2]["fp"] == 0
    scored = by_id(lm.scores(docs))
    assert scored[2]["n_tokens"] == 1 and scored[4]["n_tokens"] == 40003 and scored[None]["held_out"] is not None
    kept = by_id(lines.dedup(docs))
    assert kept[2]["text"] == "" and kept[2]["__n_lines"] == 1 and kept[4]["text"] == LONG and kept[4]["__n_dropped"] == 0
    mixed = by_id(mixing.mix(docs))
    assert mixed[2]["size"] == mixed[7]["size"] == 0 and mixed[4]["size"] == 40002 and mixed[None]["source"] is None
    counted = by_id(tokens.token_counts(docs))
    assert counted[2]["n_tokens"] == 0 and counted[2]["n_bytes"] == 0 and counted[4]["over_limit"]
    paged = by_id(tiff.pages(tiff.encode_texts(docs)))
    assert bytes(paged[2]["samples"]) == bytes(64) and bytes(paged[4]["samples"]).rstrip(b"\0") == LONG.encode()
    pieces = packing.pack(docs).toPandas()
    assert pieces[pieces.doc_id == 2].doc_tokens.tolist() == [1] and len(pieces[pieces.doc_id == 5]) >= 2 and pieces[pieces.doc_id == 4].length.sum() == pieces[pieces.doc_id == 4].doc_tokens.iloc[0]


def test_one_run_of_many_megabytes(spark):
    """A text without any white space: one word, one shingle, one line and many tokens."""
    text = "ab3-" * 750_000
    docs = spark.createDataFrame([(1, text, "a"), (2, "a b", "b")], "doc_id long, text string, source string")
    one = lambda df: next(r for r in df.collect() if r["doc_id"] == 1)
    n = tokens.MEMO and one(tokens.token_counts(docs))["n_tokens"]
    assert n == one(packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n_tokens")))["n_tokens"] - 1 == 2_250_000
    assert one(lm.scores(docs))["n_tokens"] == 2 and one(mixing.mix(docs))["size"] == 1
    assert one(simhash.near_groups(docs))["component_id"] == 1 and len(one(lines.dedup(docs))["text"]) == len(text)
    assert 0 <= one(toxicity.scores(docs, labels(spark)))["__score"] <= 1


def test_columns_named_like_the_results(spark):
    files = spark.createDataFrame([(1, 7, "x", tiff.write(b"a" * 64))], "id int, page int, error string, media binary")
    got = tiff.pages(files).first()
    assert (got["id"], got["file_page"], got["file_error"], got["page"], got["error"]) == (1, 7, "x", 0, None)


def test_columns_pass_through(spark, docs):
    for name in ("simhash dedup", "lines", "toxicity"):
        assert set(docs.columns) <= set(OPERATORS[name](spark, docs).columns)
