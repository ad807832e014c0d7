"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself; a text is
the mean of its words (and a few empty ones); a softmax layer over two classes reads that mean. Embeddings
and softmax are trained together by Adam in numpy, on a bounded balanced sample of
labelled rows. Since n-grams are shared, a misspelling that never occurred in
training still lands near the word it distorts.

After training, a word's share of the logit is one number, so a text is scored in
one pass over its words with a memo per distinct word: whole texts, any length.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.llm.common import kept, widened
from notegauge.runtime import ship

#: Labelled rows per class that the classifier is fitted on: the bound of the training sample.
SAMPLE_PER_CLASS = 3000
BUCKETS, DIM, EPOCHS, MINIBATCH, RATE, DECAY, SCALE, SEED = 1 << 17, 6, 6, 64, 0.005, 3e-4, 0.1, 7
NGRAMS = (3, 4, 5, 6)
#: A bucket whose share of texts differs by this many standard errors between the classes has half its weight; no bucket is left out.
HALF = 4.0
#: Steps of training that small samples get.
STEPS = 150
THRESHOLD = 0.7
#: Words without evidence that every text is averaged with, so that one chance n-gram does not decide a short text.
PAD = 80
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}|*#%&$-_/\\<>"
#: Distinct words remembered by a scoring task before it starts afresh (memory only, no effect on scores).
MEMO = 400_000


def subwords(word: str) -> list[int]:
    """Buckets of the word's n-grams, framed, and of the word itself."""
    w = f"<{word.lower().strip(EDGE)}>"
    crc, n, b = zlib.crc32, len(w), w.encode("utf-8", "surrogatepass")
    if len(b) == n:  # ASCII: slices of bytes are slices of characters
        grams = [b[i : i + k] for k in NGRAMS if k < n for i in range(n - k + 1)]
    else:
        grams = [w[i : i + k].encode("utf-8", "surrogatepass") for k in NGRAMS if k < n for i in range(n - k + 1)]
    return [crc(g) % BUCKETS for g in grams] + [crc(b) % BUCKETS]


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: the mean over its words of the mean over a word's subwords."""
    memo: dict[str, np.ndarray] = {}
    out = []
    for text in texts:
        counts = Counter(text.split())
        subs = [memo[w] if w in memo else memo.setdefault(w, np.array(subwords(w), np.int32)) for w in counts]
        if not subs:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        lens = np.fromiter(map(len, subs), np.int64, len(subs))
        share = np.fromiter(counts.values(), np.float64, len(subs)) / (sum(counts.values()) + PAD)
        buckets, at = np.unique(np.concatenate(subs), return_inverse=True)
        out.append((buckets, np.bincount(at, np.repeat(share / lens, lens)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(logit of each bucket, bias): what the two classes' softmax makes of the embeddings. Without both classes: nothing is toxic."""
    logit = np.zeros(BUCKETS, np.float32)
    got = learned(texts, labels, epochs)
    if got is None:
        return logit, -4.0
    used, unit, p = got
    logit[used] = unit * (p["e"] @ (p["c"][:, 1] - p["c"][:, 0]))
    return logit, float(p["b"][1] - p["b"][0])


def learned(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]] | None:
    """(buckets, their units, parameters): embeddings e of the buckets, by unit, and the softmax c, b. None without both classes."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    rows = features(texts)
    # all buckets are trained; evidence of a difference between the classes gives weight, smoothly, since most are held alike
    by_class = [np.bincount(np.concatenate([b for (b, _), c in zip(rows, y) if c == k]), minlength=BUCKETS) for k in (0, 1)]
    n, hold = np.bincount(y, minlength=2), by_class[0] + by_class[1]
    pooled = hold / len(y)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1])) + 1e-12
    z = (by_class[1] / n[1] - by_class[0] / n[0]) / error
    used = np.flatnonzero(hold)
    if not len(used):
        return None
    place = np.cumsum(hold > 0) - 1
    evidence = (z**2 / (z**2 + HALF**2))[used]
    # every bucket is measured by its usual share where it occurs, else the commonest words drown all others
    usual = np.bincount(np.concatenate([b for b, _ in rows]), np.concatenate([w for _, w in rows]), BUCKETS)[used] / hold[used]
    unit = SCALE / usual * evidence
    rows = [((x := place[b]).astype(np.int32), (w * unit[x]).astype(np.float32)) for b, w in rows]
    rng = np.random.default_rng(SEED)
    p = {"e": rng.normal(0, 1e-3, (len(used), DIM)), "c": rng.normal(0, 1, (DIM, 2)), "b": np.zeros(2)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weigh = 0.5 / np.bincount(y, minlength=2)[y] * len(y)
    t = 0
    for _ in range(max(epochs, math.ceil(STEPS * MINIBATCH / len(y)))):
        order = rng.permutation(len(y))
        for i in range(0, len(y), MINIBATCH):
            part = order[i : i + MINIBATCH]
            n = np.array([len(rows[d][0]) for d in part])
            idx, w = np.concatenate([rows[d][0] for d in part]), np.concatenate([rows[d][1] for d in part])
            text_of = np.repeat(np.arange(len(part)), n)
            h = _sums(text_of, p["e"][idx] * w[:, None], len(part))
            z = h @ p["c"] + p["b"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(part)), y[part]] -= 1
            dz = q * weigh[part][:, None] / len(part)
            dh = dz @ p["c"].T
            g = {"c": h.T @ dz, "b": dz.sum(axis=0), "e": _sums(idx, dh[text_of] * w[:, None], len(used)) + DECAY * p["e"]}
            t += 1
            for k in p:
                # one step size for all embeddings: a rare bucket does not move as far as a frequent one
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.02 * (np.mean(g[k] ** 2) - v[k])
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.98**t)) + 1e-12)
    return used, unit, p


def _sums(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(keys, x, n) for x in rows.T], axis=1)


class Scorer(dict):
    """word -> its mean bucket logit, filled as words come."""

    def __init__(self, logit: np.ndarray, bias: float):
        super().__init__()
        self.logit, self.bias = logit.tolist(), bias

    def __missing__(self, word: str) -> float:
        s, logit = subwords(word), self.logit
        self[word] = x = sum([logit[i] for i in s]) / len(s)
        return x

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        if len(self) > MEMO:
            self.clear()
        z = self.bias + sum(map(self.__getitem__, words)) / (len(words) + PAD)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def scorer(logit: np.ndarray, bias: float) -> Scorer:
    """The last model's scorer is kept between a worker's tasks, with the words it knows."""
    key = hashlib.sha256(logit.tobytes() + str(bias).encode()).hexdigest()
    return kept(f"scorer {key}", lambda: Scorer(logit, bias))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled training rows: of each class the ``per_class`` doc_ids with the lowest hash.

    A doc_id that comes more than once gives one row (that with the lowest hash of the text), so the bound holds
    for any table; one labelled more than once is toxic if any label says so. A null doc_id has no label.
    """
    train_on = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    known = labels.filter(train_on & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class pairs of numbers; only their texts leave the scan, one to a doc_id
    held = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return held.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample; the driver gets the bucket logits only."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *frames]).sort_values("doc_id", kind="stable")
        logit, bias = train([t or "" for t in got["text"]], [int(x) for x in got["toxic"]])
        yield pd.DataFrame({"logit": [logit.tobytes()], "bias": [bias]})

    row = sample(docs, labels).repartition(1).mapInPandas(run, "logit binary, bias double").first()
    return (np.frombuffer(row["logit"], np.float32), row["bias"]) if row else train([], [])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with one more column, ``__score`` (0 to 1, higher: more toxic).

    Null and empty texts get the score of no evidence; a null doc_id is scored like any other. Labels, language, source and
    doc_id are no inputs of a score, so equal texts have equal scores. All other
    columns pass through; repeated rows stay; an empty table stays empty.
    """
    logit, bias = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((logit, bias))  # BUCKETS floats, whatever the input
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(*model.value)
        for b in batches:
            got = pa.array([judge.score(t) for t in b.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "__score"])

    return docs.mapInArrow(run, widened(docs.schema, __score="double"))
