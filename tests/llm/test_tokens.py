import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from notegauge.llm import packing, tokens

ODD = st.lists(st.sampled_from([*"aBzéÉİẞ'sS1²ªµ×÷ \n\x1c\x85\xa0\t_.!?,<|>ΩΣς漢😀\u0301KÅſﬁ", "<|endoftext|>", "<|startoftext|>", "..."]), max_size=30).map("".join)
ENCODER = tokens.Encoder(tokens.vocabulary_path())
MACHINE = tokens.CountTransducer(tokens.vocabulary_path())
LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_ids_are_the_library_s(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(ODD, st.integers(1, 9))
def test_chunks_compose_to_the_library_s_count(text, size):
    machine = MACHINE
    old, tokens.CHUNK = tokens.CHUNK, size
    try:
        assert machine.counts([text.encode()]) == [len(library(text))]
    finally:
        tokens.CHUNK = old


LETTERS = st.text(alphabet="abcdefghijklmnopqrstuvwxyzésß'.,!-_=#", min_size=1, max_size=40)


@settings(max_examples=500, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=8))
def test_transducer_counts_what_the_library_encodes(runs):
    for run in runs:
        assert MACHINE.runs.count(run.encode()) == len(library(run))


def test_transducer_starts_afresh_and_shares_states(monkeypatch):
    """With few states at a time the counts are the same; long pieces do not make a state per byte."""
    monkeypatch.setattr(tokens, "STATES", 50)
    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(tokens, "PAIRS", 50)
    counter = tokens.RunCounter(tokens.vocabulary_path())
    rng = np.random.default_rng(4)
    for _ in range(300):
        run = "".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(1, 25))))
        assert counter.count(run.encode()) == len(library(run))
    counter.machine.restart()
    assert counter.count(b"ha" * 5000) == len(library("ha" * 5000)) and len(counter.machine.states) < 60


def test_composition_is_associative():
    machine = MACHINE
    parts = [b"ab c", b"d", b"", b" ", b"e f gh", b"i"]
    text, at = b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist()
    count = lambda i, j: machine.count(text[i:j])
    maps = [machine.chunk(p, i) for p, i in zip(parts, at)]
    left = maps[0]
    for m in maps[1:]:
        left = left.then(m, count)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = m.then(right, count)
    assert left == right == machine.sweep(maps, count)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, LETTERS, st.sampled_from(["'re", "'r", "e", "a" * 90, "!" * 90, "'" * 70, "é" * 80, "e\u0301" * 40, "\u0301" * 30, "각" * 40, "\u1100\u1161\u11a8" * 20, "漢" * 90, "<|endoftext|>" * 3, "<|endof"])), max_size=8).map("".join), st.integers(1, 40))
def test_long_runs_are_read_by_windows(text, window):
    old, tokens.WINDOW, tokens.LONG = (tokens.WINDOW, tokens.LONG), window, 0
    try:
        for run in text.encode().split():
            assert tokens.LongRun(MACHINE.runs).count(run) == len(library(run.decode()))
        assert MACHINE.counts([text.encode()]) == [len(library(text))]
    finally:
        tokens.WINDOW, tokens.LONG = old


def test_a_long_piece_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "STATES", 40)
    monkeypatch.setattr(tokens, "WINDOW", 50)
    rng = np.random.default_rng(4)
    run = "".join(rng.choice(list("etaoinshrdlu"), 3000))
    counter = tokens.RunCounter(tokens.vocabulary_path())
    assert tokens.LongRun(counter).count(run.encode()) == len(library(run)) and len(counter.machine.states) < 200


def test_a_run_of_many_megabytes_takes_little_memory():
    """Runs without white space, of one piece and of many, beside their own bytes."""
    import subprocess
    import sys

    code = """
import resource
from notegauge.llm import tokens
machine = tokens.CountTransducer(tokens.vocabulary_path())
for piece in ("haha", "ab1.", "漢字。", "x<|endoftext|>"):
    run = piece.encode() * (24_000_000 // len(piece.encode()))
    n = len(run) // len(piece.encode())
    per = machine.counts([(piece * 400).encode()])[0] - machine.counts([(piece * 200).encode()])[0]
    rest = machine.counts([(piece * 200).encode()])[0] - per
    assert machine.counts([run])[0] == per * n // 200 + rest, piece
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


def texts():
    rng = np.random.default_rng(2)
    words = ["alpha", "beta.", "gamma,", "delta!", "epsilon", "zeta?"]
    out = [" ".join(words[i] for i in rng.integers(0, 6, n)) for n in rng.integers(1, 900, 120)]
    return [*out, None, "", "word " * 9000, "noend " * 3000 + "end."]


def test_pieces_cover_every_id_once(spark):
    docs = list(enumerate(texts()))
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).toPandas()
    for d, t in docs:
        ids = [*library(t or ""), 1]
        at = 0
        for r in got[got.doc_id == d].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        n = int(g.length.sum())
        assert 0 < n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 0.03 * total


def cheapest(pos, cost, size):
    """The same minimum by trying every predecessor."""
    best = [0]
    for j in range(1, len(pos)):
        value = []
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                free = n in packing.POWERS and n < size
                value.append(best[i] + (0 if free else size - n))
        best.append(min(value) + cost[j])
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.data())
def test_dynamic_programme_is_optimal(gaps, data):
    pos = np.concatenate(([0], np.cumsum(gaps)))
    cost = np.array([0, *data.draw(st.lists(st.sampled_from([0, 4, 64]), min_size=len(gaps), max_size=len(gaps)))])
    size = 100
    cuts = packing.best_cuts(pos, cost, size)
    at = {p: c for p, c in zip(pos.tolist(), cost.tolist())}
    got = sum((0 if (n := b - a) in packing.POWERS and n < size else size - n) + at[b] for a, b in zip(cuts, cuts[1:]))
    assert got == cheapest(pos.tolist(), cost.tolist(), size)
