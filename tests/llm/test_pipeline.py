"""The pipeline, each stage held against what its operator says of the same rows."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from notegauge.llm import tokens

SHARED = "this very long line comes back in many of the documents here"
BAD = ["worthless", "idiot", "pathetic"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("na", "lo", "mi", "ka")]
    docs, labels = [], []
    for i in range(400):
        body = [words[j] for j in rng.integers(0, len(words), 80)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                body.insert(int(rng.integers(len(body))), BAD[int(rng.integers(3))])
        text = " ".join(body)
        if i % 10 == 1:
            text = SHARED + "\n" + text
        if i % 50 == 3:
            text = docs[i - 1][1]  # an exact copy
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).checkpoint())
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxic_documents_go(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    toxic = {i for i in range(400) if i % 4 == 0}
    assert len(kept & toxic) <= 0.05 * len(toxic) and len(kept - toxic) >= 0.95 * (400 - len(toxic))


def test_repeated_lines_stay_once(stages):
    held = [r["doc_id"] for r in stages[1].collect() if SHARED in r["text"]]
    left = [r["doc_id"] for r in stages[2].collect() if SHARED in r["text"]]
    assert len(held) >= 5 and left == [max(held)]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2].collect()}
    ids = sorted(sets)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    twins = {b: [a for a in ids if a < b and alike(a, b) >= 0.8] for b in ids}
    assert any(twins.values())
    assert sorted(r["doc_id"] for r in stages[3].collect()) == [i for i in ids if not twins[i]]


def test_mix_repeats_or_drops_whole_documents(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    rows = stages[4].collect()
    assert rows and all(texts[r["doc_id"]] == r["text"] for r in rows)
    counts = np.unique([r["doc_id"] for r in rows], return_counts=True)[1]
    assert counts.max() <= 3


def test_pieces_cover_the_mix(stages):
    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = sorted(zlib.crc32(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in stages[4].collect())
    pieces = stages[5].toPandas()
    whole = pieces[pieces.length == pieces.doc_tokens]
    assert set(whole.ids_crc32) <= set(want)
    assert pieces.length.sum() == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_run_is_the_stages(spark, sf_dir, stages):
    """The same documents with the same tokens, each as often; where they are cut depends on the splits alone."""
    got, want = corpus_pipeline.run(spark, sf_dir).toPandas(), stages[5].toPandas()
    for df in (got, want):
        assert (df.start + df.length <= df.doc_tokens).all()
    tokens_of = lambda df: df.groupby(["doc_id", "doc_tokens"]).length.sum().to_dict()
    assert tokens_of(got) == tokens_of(want)


ODD = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "one two three four five six", "fr", None, 27), (None, None, "fr", "a", 0), (9, "x" * 300_000 + " word" * 30_000, "en", "b", 450_000)]


def test_odd_rows_through_all_stages(spark, sf_dir):
    """Nulls, repeats and long texts: the row without doc_id is no copy of another, null texts are one group, repeats stay."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 5) for r in ODD], columns + ", extra int")
    seen = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf_dir).checkpoint()
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        seen.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    assert seen[0] == seen[1] == ["1", "1", "2", "3", "9", "None", "None"]
    assert seen[2] == ["1", "1", "2", "9", "None", "None"]
    assert set(seen[3]) <= set(seen[2]) and "2" in seen[3]
    pieces = corpus_pipeline.pack(spark, docs, sf_dir).toPandas()
    assert (pieces[pieces.doc_id == 2].doc_tokens == 1).all()


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, sf_dir).collect() == []
