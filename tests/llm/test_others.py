import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegauge.llm import imatch, lm, mixing, tiff, toxicity, warc
from notegauge.llm.eliasfano import EliasFano, Trie


# --- Elias-Fano and the language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=200), st.lists(st.integers(0, 10**7), max_size=50))
def test_elias_fano(values, others):
    values = np.unique(np.array(values, np.int64))
    ef = EliasFano.of(values, 10**7 + 1)
    assert ef.get(np.arange(len(values))).tolist() == values.tolist()
    ask = np.array([*values.tolist(), *others], np.int64)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert ef.find(ask).tolist() == [place.get(v, -1) for v in ask.tolist()]


def test_elias_fano_with_repeats():
    values = np.array([0, 0, 3, 3, 3, 9, 64, 64, 4096])
    assert EliasFano.of(values, 4097).get(np.arange(9)).tolist() == values.tolist()


def test_probabilities_sum_to_one(tmp_path):
    rng = np.random.default_rng(1)
    text = rng.integers(0, 6, 4000)
    words, total = 6, 4001
    counts = np.bincount(text, minlength=words)
    uni = (counts + 0.5) / (total + 0.5 * (words + 1))
    key, n = np.unique((text[:-2] * words + text[1:-1]) * words + text[2:], return_counts=True)
    none = np.zeros(0, np.int64)
    u, v, w = key // words**2, key // words % words, key % words
    lm.trie_of(v, u, w, n, none, none, [none] * 3, 8).save(str(tmp_path / "t"))
    trie = Trie.load(str(tmp_path / "t"))
    for u in range(-1, words):
        for v in range(words):
            # the mass of the words, and what back-off leaves to the words outside
            a, b = trie.weights(np.full(words, u), np.full(words, v), np.arange(words))
            outside = trie.weights(np.array([u]), np.array([v]), np.array([-1]))
            assert outside[0][0] == 0
            assert (a + b * uni).sum() + outside[1][0] * (1 - uni.sum()) == pytest.approx(1, abs=2e-3)


def brute_scores(words, held):
    """Scores of lists of words by the definition: interpolated absolute discounting over n-grams seen twice."""
    train = [ws for i, ws in words.items() if not held[i]]
    one = Counter(w for ws in train for w in ws)
    two = Counter(x for ws in train for x in zip([None, *ws], ws))
    three = Counter(x for ws in train for x in zip([None, *ws], ws, ws[1:]))
    n, v = sum(one.values()), len(one)
    known = {w for w, c in one.items() if c >= 2} | {None}
    two = Counter({k: c for k, c in two.items() if c >= 2 and known.issuperset(k)})
    three = Counter({k: c for k, c in three.items() if c >= 2 and known.issuperset(k)})
    left2, left3 = Counter(), Counter()
    for (a, _), c in two.items():
        left2[a] += c - 0.75
    for (a, b, _), c in three.items():
        left3[a, b] += c - 0.75
    out = {}
    for i, ws in words.items():
        total = 0
        for k, w in enumerate(ws):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            a, b = ws[k - 1] if k else None, ws[k - 2] if k > 1 else None
            if a in known and one[a]:
                p = max(0, two[a, w] - 0.75) / one[a] + (1 - left2[a] / one[a]) * p
                if k and (b, a) in two:
                    p = max(0, three[b, a, w] - 0.75) / two[b, a] + (1 - left3[b, a] / two[b, a]) * p
            total += math.log10(p)
        out[i] = total
    return out


@pytest.mark.parametrize("shard_size", [lm.SHARD, 300])
def test_lm_score_by_definition(spark, shard_size, monkeypatch):
    """In one stretch and one shard, and in many of both, where frequent words are spread."""
    if shard_size < 1000:
        monkeypatch.setattr(lm, "CHUNK", 700)
    rng = np.random.default_rng(14)
    docs = [(i, " ".join(f"W{j}" for j in rng.zipf(1.4, rng.integers(0, 60)) % 70)) for i in range(240)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    want = brute_scores({i: [*t.lower().split(), None] for i, t in docs}, held)
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string"), shard_size=shard_size).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=2e-4 * (r["n_tokens"] + 1))


def test_lm_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"W{j}" for j in rng.zipf(1.5, 40) % 50)) for i in range(200)]
    got = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = {i: [*t.lower().split(), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_lm_learns_order(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(f"a{k} b{k} c{k}" for k in rng.integers(0, 9, 30))) for i in range(300)]
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).filter("held_out").toPandas()
    assert (got.score > got.base_score + 20).all()


def test_lm_keeps_an_ngram_by_its_own_count(spark):
    """Ten occurrences of a phrase teach its order, however much other text there is."""
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(1000) if i not in train)
    docs = [(i, "red green blue") for i in train[:10]] + [(held, "red green blue")]
    filler = spark.createDataFrame([(i,) for i in train[10:70]], "doc_id long").selectExpr("doc_id", "repeat('x ', 250000) as text")
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string").unionByName(filler)).filter("held_out").first()
    assert got["train_tokens"] > 15_000_000 and got["score"] > got["base_score"] + 12


# --- I-Match


def test_edited_texts_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET", 3)
    rng = np.random.default_rng(6)
    ids = np.unique(rng.integers(0, 10**9, 120)).tolist()
    docs = [(i, " ".join(f"w{j}" for j in rng.integers(0, 400, rng.integers(0, 90)))) for i in ids]
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(docs):
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[(k + 1) % len(docs)][1][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.7


def test_equal_texts_have_equal_fingerprints(spark):
    docs = [(i, f"shared words {i % 3} here") for i in range(12)]
    got = imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert got.assign(k=got.doc_id % 3).groupby("k").fingerprint.nunique().tolist() == [1, 1, 1]


def test_previous_across_groups(spark):
    pairs = sorted({(int(x), int(y)) for x, y in np.random.default_rng(2).integers(-1, 9, (60, 2))})
    got = {(r["q"], r["s"]): (r["before_q"], r["before_s"]) for r in imatch.previous(spark.createDataFrame(pairs, "q int, s long")).collect()}
    assert got == {k: pairs[i - 1] for i, k in enumerate(pairs)}


def spark_hash(spark, values):
    from pyspark.sql import functions as F

    values = list(dict.fromkeys(values))
    return {r["v"]: r["h"] for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", F.xxhash64("v").alias("h")).collect()}


WIDE = [-(2**63) + 5, 2**63 - 5, 2**62, -1, 0]


@pytest.mark.parametrize("ids", ["even", "wide", "tied", "nulls", "runs", "repeats", "one"])
def test_buckets_follow_the_rows(spark, monkeypatch, ids):
    """However the doc_ids lie, no bucket has more than BUCKET rows, they are in order, and each row is followed by the next."""
    monkeypatch.setattr(imatch, "BUCKET", 4)
    monkeypatch.setattr(imatch, "WIDTH", 3)
    rng = np.random.default_rng(3)
    n = 1 if ids == "one" else 400
    given = {
        "even": range(n), "wide": [*WIDE, *range(10**6, 10**6 + n - len(WIDE))], "tied": [7 if i % 3 == 0 else i for i in range(n)], "nulls": [None if i % 3 == 0 else i for i in range(n)],
        "runs": [(i // 40 << 33) + i % 40 for i in range(n)], "repeats": [5 if i % 2 else i for i in range(n)], "one": [3],
    }[ids]
    docs = [(i, "copy" if ids == "repeats" and k % 2 else f"text {k}") for k, i in enumerate(given)]
    frame = spark.createDataFrame([docs[k] for k in rng.permutation(n)], "doc_id long, text string")
    rows = imatch.placed(frame).collect()
    hashes = spark_hash(spark, [t for _, t in docs])
    key = lambda d, t: (d is not None, d or 0, hashes[t])
    rows.sort(key=lambda r: (*key(r["doc_id"], r["text"]), r["salt"]))
    places = [(r["q"], r["s"]) for r in rows]
    assert len(rows) == n and places == sorted(places) and max(Counter(places).values()) <= 4
    docs.sort(key=lambda r: key(*r))
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in imatch.with_next(frame).collect())
    assert got == Counter((*r, docs[(k + 1) % n][1]) for k, r in enumerate(docs))


def test_runs_of_many_rows(spark):
    """Ids in runs far apart, as monotonically_increasing_id makes them."""
    ids = spark.range(0, 200_000, 1, 23).select(imatch.F.monotonically_increasing_id().alias("doc_id"), imatch.F.lit("x").alias("text"))
    sizes = imatch.placed(ids).groupBy("q", "s").count().agg(imatch.F.max("count"), imatch.F.sum("count"), imatch.F.count("*")).first()
    assert sizes[0] <= imatch.BUCKET and sizes[1] == 200_000 and sizes[2] < 220


def test_fingerprints_by_definition(spark):
    """All numbers of the fingerprints and both likenesses, computed again in Python from Spark's hash alone."""
    rng = np.random.default_rng(8)
    ids = [*WIDE, *range(10, 120), None]
    docs = [(i, " ".join(f"W{j}" for j in rng.zipf(1.3, int(rng.integers(0, 50))) % 300) if k % 9 else None) for k, i in enumerate(ids)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame).collect()}
    docs = sorted([(i, t or "") for i, t in docs], key=lambda r: (r[0] is not None, r[0] or 0))
    following = [docs[(k + 1) % len(docs)][1] for k in range(len(docs))]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for (_, t), f in zip(docs, following)]
    terms = lambda t: sorted(set(t.lower().split()))
    held = Counter(w for _, t in docs for w in terms(t))
    band = {w for w, c in held.items() if 0.005 * len(docs) <= c <= 0.2 * len(docs)}
    one = spark_hash(spark, sorted({w for t in [*(t for _, t in docs), *edited] for w in terms(t)}))

    def lists(t):
        keys = [one[w] for w in terms(t) if w in band]
        inside = [[h for h in keys if ((h % 2**64) >> s) & ((1 << r) - 1) == v] for s, r, v in imatch.subsets()]
        return ("k", tuple(keys)) if keys else ("t", tuple(terms(t))), [tuple(x) for x in inside]

    every = {t: lists(t) for t in [*(t for _, t in docs), *edited]}
    from pyspark.sql import functions as F

    number = lambda c: (F.pmod(F.xxhash64(c), F.lit(65535)) + 1).alias("n")
    longs = list({x for w, parts in every.values() for x in ([w[1]] if w[0] == "k" else []) + parts if x})
    squeezed = {tuple(r["a"]): r["n"] for r in spark.createDataFrame([(list(x),) for x in longs], "a array<long>").select("a", number("a")).collect()}
    words = list({w[1] for w, _ in every.values() if w[0] == "t"})
    wordy = {tuple(r["a"]): r["n"] for r in spark.createDataFrame([(list(x),) for x in words], "a array<string>").select("a", number("a")).collect()}

    def numbers(t):
        whole, parts = every[t]
        return [(squeezed if whole[0] == "k" else wordy)[whole[1]], *[squeezed[p] if p else 0 for p in parts]]

    def alike(a, b):
        weights = [1.0, *[2 ** (r / 2) for r in range(1, imatch.RATES + 1) for _ in range(imatch.SUBSETS)]]
        same = sum(w for x, y, w in zip(a, b, weights) if x == y and x)
        return min(1.0, same / sum(w for x, y, w in zip(a, b, weights) if x or y))

    text = lambda xs: "".join(f"{x:04x}" for x in xs)
    for (i, t), f, e in zip(docs, following, edited):
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"], r["n_chars"]) == (text(numbers(t)), text(numbers(e)), hashlib.sha256(e.encode()).hexdigest(), len(t))
        assert r["near_edited"] == pytest.approx(alike(numbers(t), numbers(e))) and r["near_next"] == pytest.approx(alike(numbers(t), numbers(f)))


# --- WARC


def test_magic_inside_payloads_is_not_a_record(spark):
    evil = "x" * 400 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "WARC/1.1\r\n" * 40 + "y" * 900
    pages = [(1, "u", "a" * 1000), (2, "u\r\nX: y", evil), (3, None, "a" * 1000), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (7, "u", evil), (8, "u", "é" * 500)]
    got = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 3, 2: 7}


def record(block, kind="resource", page=1, more=b""):
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x-page:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), page, more, len(block), block)


def test_only_records_on_the_chain_are_read(spark, tmp_path):
    """Plain and compressed files in many splits: magic in payloads, junk, a cut end, a broken link."""
    inner = record(b"inner", page=99)
    blocks = [b"one", inner * 3, b"", bytes(range(256)), b"WARC/1.1\r\n" * 50, "é漢".encode() * 300]
    data = [b"".join(record(b, page=100 * k + i) for i, b in enumerate(blocks)) for k in range(4)]
    folder = tmp_path / "a" / "deep"
    folder.mkdir(parents=True)
    (folder / "whole.warc").write_bytes(data[0])
    (folder / "packed.warc.gz").write_bytes(gzip.compress(data[1]))
    (folder / "cut.warc").write_bytes(data[2] + record(b"lost", page=299)[:-9])
    (folder / "junk.warc").write_bytes(b"junk" + data[3])
    (folder / "broken.warc").write_bytes(record(b"first", page=40) + b"x" + record(b"after", page=41))
    (folder / "empty.warc").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {100 * k + i: (len(b), hashlib.sha1(b).hexdigest()) for k in range(3) for i, b in enumerate(blocks)}
    assert got == want | {40: (5, hashlib.sha1(b"first").hexdigest())}


def test_archives_are_what_other_readers_expect(spark, tmp_path):
    """Each record read by its length alone, as any sequential reader does: header lines, an HTTP answer or a revisit without a block."""
    pages = [(i, f"http://x/{i}", f"<p>{'long ' * 300 if i % 3 else i}</p>") for i in range(30)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    seen = {}
    for path in (tmp_path / "w").glob("part-*"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            n = int(fields["Content-Length"])
            block, data = rest[:n], rest[n + 4 :]
            assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
            page = int(fields["WARC-Record-ID"].split(":")[-1].rstrip(">"))
            if fields["WARC-Type"] == "revisit":
                assert n == 0 and fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] == "<urn:x-page:29>"
            else:
                status, _, body = block.partition(b"\r\n\r\n")
                assert status.startswith(b"HTTP/1.1 200 OK\r\n") and body.decode() == pages[page][2]
            seen[page] = fields["WARC-Type"]
    assert seen == {i: "revisit" if i % 3 and i != 29 else "response" for i in range(30)}


def test_reachable_by_jumping():
    offsets, following = np.array([0, 10, 25, 40, 70]), np.array([25, 40, 70, 70, 90])
    assert warc.reachable(offsets, following).tolist() == [0, 2, 4]
    assert warc.reachable(offsets + 1, following).tolist() == []


# --- TIFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from([tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE]), st.sampled_from([1, 2]), st.integers(1, 5))
def test_tiff_round_trip(data, compression, predictor, strip):
    data = tiff.padded(data)
    (page,) = tiff.read_pages(tiff.write(data, compression=compression, predictor=predictor, strip_rows=strip))
    assert page.data == data and page.width == 64 and page.height == len(data) // 64


def test_lzw_widens_codes():
    data = bytes(np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8)) + b"abcabc" * 9000
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff.unpack_lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"  # a known stream
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_big_endian_tiles_of_two_pages():
    """Two pages by hand: 16-bit samples in tiles with differences, then plain RGB in one strip."""
    import struct

    grid = np.arange(40 * 20, dtype=np.uint16).reshape(20, 40) * 3
    whole = np.zeros((32, 48), np.uint16)
    whole[:20, :40] = grid
    tiles = [whole[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16, 32)]
    packed = [zlib.compress(np.diff(t, axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()) for t in tiles]
    rgb = bytes(range(2 * 3 * 3))
    blob, offsets = b"", []
    for p in [*packed, rgb]:
        offsets.append(8 + len(blob))
        blob += p
    lists = 8 + len(blob)
    blob += struct.pack(">6I", *offsets[:6]) + struct.pack(">6I", *map(len, packed)) + struct.pack(">3H", 8, 8, 8)

    def directory(entries, following):
        out = struct.pack(">H", len(entries))
        for tag, kind, n, v in entries:
            out += struct.pack(">HHI", tag, kind, n) + (struct.pack(">HH", v, 0) if kind == 3 and n == 1 else struct.pack(">I", v))
        return out + struct.pack(">I", following)

    first = 8 + len(blob)
    one = [(256, 3, 1, 40), (257, 3, 1, 20), (258, 3, 1, 16), (259, 3, 1, 8), (277, 3, 1, 1), (317, 3, 1, 2), (322, 3, 1, 16), (323, 3, 1, 16), (324, 4, 6, lists), (325, 4, 6, lists + 24)]
    two = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 3, lists + 48), (259, 3, 1, 1), (273, 4, 1, offsets[6]), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 1, len(rgb))]
    size = len(directory(one, 0))
    data = struct.pack(">2sHI", b"MM", 42, first) + blob + directory(one, first + size) + directory(two, 0)
    a, b = tiff.read_pages(data)
    assert (np.frombuffer(a.data, np.uint16).reshape(20, 40) == grid).all() and (b.width, b.height, b.samples, b.data) == (3, 2, 3, rgb)


def test_query_columns_by_brute_force(spark, tmp_path):
    """All that op5 returns, computed again from the texts and from the stored bytes."""
    from notegauge.llm import queries

    texts = ["", None, "a", "é" * 100, "x" * 63, "x" * 64, "x" * 65, "many words here " * 500, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    media = {r["doc_id"]: bytes(r["media"]) for r in tiff.encode_texts(docs).collect()}
    for r in queries.op5_tiff_pages(spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        cells = np.frombuffer(payload, np.uint8)[: len(payload) // 64 * 64].reshape(64, -1).mean(axis=1)
        bits = "".join("1" if c > cells.mean() else "0" for c in cells)
        stored = media[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}")
        assert stored[:4] == b"II*\0" and len(stored) < len(payload) + 200


def test_bad_files_are_rows(spark):
    files = spark.createDataFrame([(1, b"no"), (2, None), (3, tiff.write(b"a" * 64))], "id int, media binary").coalesce(1)
    got = {r["id"]: r for r in tiff.pages(files).collect()}
    assert got[1]["error"] and got[2]["page"] is None and got[3]["error"] is None and bytes(got[3]["samples"]) == b"a" * 64


# --- toxicity


def test_toxicity_on_held_out_rows_and_misspellings():
    rng = np.random.default_rng(8)
    clean = [f"{a}{b}" for a in ("ba", "ko", "ti", "ru", "se") for b in ("na", "lo", "mi", "ka", "po", "du")]
    bad = ["worthless", "idiot", "pathetic"]
    texts, labels = [], []
    for i in range(600):
        words = [clean[j] for j in rng.integers(0, len(clean), rng.integers(10, 200))]
        if i % 3 == 0:
            for k in range(max(1, len(words) // 40)):
                words.insert(int(rng.integers(len(words))), bad[int(rng.integers(3))])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    logit, bias = toxicity.train(texts[:400], labels[:400])
    scorer = toxicity.Scorer(logit, bias)
    hit = np.array([scorer.score(t) >= toxicity.THRESHOLD for t in texts[400:]])
    want = np.array(labels[400:], bool)
    assert hit[want].mean() > 0.95 and hit[~want].mean() < 0.05
    assert scorer["idiots"] > 0 and scorer["worthles"] > 0  # never seen
    assert scorer.score("") < toxicity.THRESHOLD and scorer.score(None) == scorer.score("")


def toxic_texts(n, seed, clean, bad):
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        words = [clean[j] for j in rng.integers(0, len(clean), rng.integers(10, 200))]
        for _ in range(max(2, len(words) // 30) if i % 3 == 0 else 0):
            words.insert(int(rng.integers(len(words))), bad[int(rng.integers(len(bad)))])
        texts.append(" ".join(words))
    return texts, [int(i % 3 == 0) for i in range(n)]


@pytest.mark.parametrize("n, n_bad, least", [(900, 60, 0.9), (60, 3, 0.8)])
def test_rare_toxic_words_and_few_labelled_rows(n, n_bad, least):
    """Sixty toxic words, each in few texts; and twenty toxic texts in all."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), rng.integers(5, 10)))
    clean, bad = [word() for _ in range(400)], [word() for _ in range(n_bad)]
    scorer = toxicity.Scorer(*toxicity.train(*toxic_texts(n, 1, clean, bad)))
    texts, labels = toxic_texts(600, 2, clean, bad)
    hit, want = np.array([scorer.score(t) >= toxicity.THRESHOLD for t in texts]), np.array(labels, bool)
    assert hit[want].mean() > least and hit[~want].mean() < 0.05


def test_scores_are_the_forward_pass():
    """A text's score is that of averaged word vectors under the softmax, computed step by step."""
    rng = np.random.default_rng(5)
    clean, bad = [f"word{i}" for i in range(60)], ["idiot", "moron", "scum"]
    texts, labels = toxic_texts(90, 3, clean, bad)
    used, unit, p = toxicity.learned(texts, labels)
    vector = np.zeros((toxicity.BUCKETS, toxicity.DIM))
    vector[used] = unit[:, None] * p["e"]
    scorer = toxicity.Scorer(*toxicity.train(texts, labels))
    for text in [*texts[:30], "unseen idiots, MORON! é", "", " ".join(rng.choice(clean, 500))]:
        words = text.split()
        mean = sum((vector[toxicity.subwords(w)].mean(axis=0) for w in words), np.zeros(toxicity.DIM)) / (len(words) + toxicity.PAD)
        z = mean @ p["c"] + p["b"]
        assert scorer.score(text) == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-4)


def test_sample_is_bounded_by_rows(spark):
    """Repeated documents and labels take no more than their class's share; held_out is never null."""
    rows = [(i % 40, f"text {i}") for i in range(5000)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, per_class=5).collect()
    assert len(got) == 10 and len({r["doc_id"] for r in got}) == 10
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)


def test_training_without_both_classes():
    logit, bias = toxicity.train(["a"], [1])
    assert not logit.any() and toxicity.Scorer(logit, bias).score("x") < 0.1


# --- mixing


def water_fill(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, target, live = sum(sizes.values()), {}, set(names)
    left = total
    while live:
        w = sum(weight[n] for n in live)
        over = [n for n in live if left * weight[n] / w > 3 * sizes[n]]
        if not over:
            return target | {n: left * weight[n] / w for n in live}
        for n in over:
            target[n] = 3.0 * sizes[n]
        left = total - sum(target.values())
        live -= set(over)
    return target


def test_mix(spark):
    rng = np.random.default_rng(9)
    sources = ["b", "a", "Z", "é", None, "tiny", "😀"]
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 80))), sources[i % 7] if i % 50 else "tiny") for i in range(3000)]
    docs = [(i, "w w" if s == "tiny" else t, s) for i, t, s in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(frame).toPandas()
    assert len(got) == len(docs)
    size = {i: len(t.split()) for i, t, _ in docs}
    assert (got["size"] == got.doc_id.map(size)).all() and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    sizes = Counter()
    for i, _, s in docs:
        sizes[s] += size[i]
    want = water_fill(sizes)
    for source, g in got.groupby("source", dropna=False):
        source = None if source is None or source != source else source
        assert g.target.iloc[0] == pytest.approx(want[source]) and g.source_size.iloc[0] == sizes[source]
        assert g.taken.sum() == pytest.approx(want[source], rel=0.02)
    assert got.sort_values("doc_id").equals(mixing.mix(frame.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True).set_index(got.sort_values("doc_id").index))


def test_golden_points_fall_within_reach():
    """Counts in intervals stay close to their share: the largest difference grows like the logarithm."""
    n = 1 << 18
    x = np.array([i * mixing.GOLDEN % mixing.CIRCLE for i in range(n)], float) / mixing.CIRCLE
    rng = np.random.default_rng(1)
    worst = 0.0
    for a, b in rng.random((60, 2)):
        a, b = min(a, b), max(a, b)
        worst = max(worst, np.abs(np.cumsum((x >= a) & (x < b)) - (b - a) * np.arange(1, n + 1)).max())
    assert worst < 2 + np.log(n) and 2 + np.log(float(mixing.CIRCLE)) < mixing.REACH
    a, b = mixing.CIRCLE, mixing.GOLDEN
    while b > 1:  # every quotient is 1, to the end
        assert a // b == 1
        a, b = b, a % b


def test_late_slots_are_as_even_as_early_ones(spark):
    """Beyond 3e10 slots, rare sources still get their share within the bound."""
    first, n = 3 * 10**10, 4_000_000
    x = mixing.point(mixing.F.col("id"))
    shares = (1e-3, 1e-4, 1e-5, 3e-6)
    at = int(0.37 * mixing.CIRCLE)
    told = spark.range(first, first + n).select(x.alias("x")).agg(*[mixing.F.count_if(mixing.F.col("x").between(at, at + int(s * mixing.CIRCLE))).alias(str(i)) for i, s in enumerate(shares)]).first()
    assert all(abs(told[str(i)] - n * s) < 40 for i, s in enumerate(shares))
    some = [first, first + 1, 10**18 - 1, 0]
    got = spark.createDataFrame([(i,) for i in some], "id long").select("id", x.alias("x")).collect()
    assert {r["id"]: r["x"] for r in got} == {i: i * mixing.GOLDEN % mixing.CIRCLE for i in some}


def test_slots_cover_all_points(spark):
    """Each slot falls to one source, also with targets that are tiny, equal or none."""
    plan = spark.createDataFrame([(1, 0.0), (2, 1e-9), (3, 5.0), (4, 5.0), (5, 1e-30), (6, 1e12), (7, 3.0)], "position int, target double")
    got = mixing.slots(plan, 20000, 1).groupBy("position").agg(mixing.F.count("*").alias("n"), mixing.F.max("rank").alias("last"), mixing.F.count_distinct("rank").alias("ranks")).collect()
    assert sum(r["n"] for r in got) == 20000 and all(r["last"] + 1 == r["n"] == r["ranks"] for r in got)
    with pytest.raises(Exception, match="more slots than a target reaches"):
        mixing.slots(spark.createDataFrame([(1, 1.0)], "position int, target double"), 1000, 1).collect()


def test_copies_of_rows_without_doc_id_follow_their_source(spark):
    docs = [(None, " ".join([f"w{i}"] * 10), "a" if i < 20 else "b") for i in range(220)]
    rows = mixing.apply_mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    counts = Counter(r["source"] for r in rows)
    assert counts["a"] == pytest.approx(60, abs=3) and counts["b"] == pytest.approx(160, abs=8)  # 3 times 20, and what is left of 220


@pytest.mark.parametrize("text", ["", " a", "a b\tc\n", "\x0b\x0c", "a b", None, "\x1ca b"])
def test_word_sizes(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(mixing.words(mixing.F.col("t")).alias("n")).first()["n"]
    assert got == len(re.findall("[^\x20\x09-\x0d]+", text or ""))
