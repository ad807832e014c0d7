"""Token ids and token counts of a fixed public tokenizer, over whole texts.

The tokenizer's pieces never cross ASCII white space, and none of its normalising
steps does, so a text's ids are the ids of its runs of other characters, one after
the other. Each distinct run is encoded by the library once per worker memo.

Counting does not encode. The vocabulary and its merges are compiled into a
deterministic transducer whose transitions emit token counts, state by state as texts
reach them; white space leads back to its start. The paths of known runs are kept as
one transition each. A chunk of text is a map from entry state to exit state and emitted
count; maps compose associatively, so the chunks of a text of any length are combined
by the up-sweep of a parallel prefix scan. What is open at a chunk's edges is held as
places in the text, not as bytes. A run that spans chunks is read by a state that goes
on from window to window: a few characters, a state of the transducer and a count.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegauge.llm.common import kept
from notegauge.runtime import ship

VOCABULARY = "word_bpe_49k.json"
#: Distinct runs, and pieces of them, remembered by a worker before it starts afresh (memory only).
MEMO = 400_000
#: What a worker's transducer holds before it starts afresh (memory only): states, pairs of tokens, pieces, runs.
STATES, PAIRS, PIECES, RUNS = 60_000, 300_000, 500_000, 1_000_000
#: Pieces to a line for the library, and lines to a call.
BATCH = 512
#: Runs whose normal form is their lower case: printable ASCII but the apostrophe, and Latin-1 letters.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: Their pieces, in lower case, as the tokenizer splits: letters, one digit, marks.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
MARKS = frozenset(".,;:!?|")
PIECEWISE = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Bytes to a chunk of the transducer.
CHUNK = 1 << 16
#: Runs of more bytes are read window by window, and remembered by nobody.
LONG, WINDOW = 1 << 16, 1 << 16
#: Characters of an open piece that are kept as context, and characters that can change what stands before them ("'re").
CONTEXT, AHEAD = 16, 3
LIMIT = 2048


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """run of non-space characters -> its ids as little-endian unsigned 32-bit bytes.

    Runs of plain characters are taken apart into the tokenizer's own pieces (letters,
    single digits, other marks), so that case and punctuation variants share a word;
    every piece ends in a token with the end-of-word mark, which tells the pieces of
    one call apart. All other runs go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(config | {"truncation": None, "padding": None}))
        # the same model without normalising and splitting, which plain pieces have behind them
        self.pieces = Tokenizer.from_str(json.dumps(config | {"truncation": None, "padding": None, "normalizer": None, "pre_tokenizer": PIECEWISE}))
        suffix = config["model"]["end_of_word_suffix"]
        self.closing = np.zeros(1 + max(config["model"]["vocab"].values()), bool)
        self.closing[[i for w, i in config["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.memo: dict[bytes, bytes] = {}

    def learn(self, runs: set[bytes]) -> None:
        """Encode what is new, many pieces to a call."""
        on = gc.isenabled()
        gc.disable()  # many small objects without cycles: the collector would only walk them again and again
        try:
            self._learn(runs)
        finally:
            if on:
                gc.enable()

    def _learn(self, runs: set[bytes]) -> None:
        new = [r for r in runs if r not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(runs)
        word, words, marked, stems, marks, plain, split, rest = ([] for _ in range(8))
        for r in new:
            t = r.decode()
            if t.isascii():  # most runs are a word, or a word and a mark
                if t.isalpha():
                    word.append(r)
                    words.append(t.lower())
                    continue
                if t[-1] in MARKS and t[:-1].isalpha():
                    marked.append(r)
                    stems.append(t[:-1].lower())
                    marks.append(t[-1])
                    continue
            if PLAIN.fullmatch(t) and "<|" not in t:
                plain.append(r)
                split.append(PIECE.findall(t.lower()))
            else:
                rest.append(r)
        self._learn_words(set(words).union(stems, marks, *split))
        get = self.words.__getitem__
        self.memo.update(zip(word, map(get, words)))
        self.memo.update(zip(marked, map(add, map(get, stems), map(get, marks))))
        self.memo.update(zip(plain, [b"".join(map(get, ws)) for ws in split]))
        for part in _parts(rest, BATCH):
            for r, e in zip(part, self.tokenizer.encode_batch_fast([r.decode() for r in part], add_special_tokens=False), strict=True):
                self.memo[r] = np.array(e.ids, "<u4").tobytes()

    def _learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MEMO:
            self.words.clear()
            new = list(words)
        for part in _parts(new, 16 * BATCH):
            lines = [" ".join(x) for x in _parts(part, BATCH)]
            ids = np.array([i for e in self.pieces.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
            ends = ((np.flatnonzero(self.closing[ids]) + 1) * 4).tolist()
            data = ids.astype("<u4").tobytes()
            for w, s, e in zip(part, [0, *ends[:-1]], ends, strict=True):
                self.words[w] = data[s:e]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    return kept(f"encoder {path}", lambda: Encoder(path))


BYTES = [bytes([b]) for b in range(256)]


class PieceTransducer:
    """The tokenizer's merges as a deterministic transducer over the bytes of a piece, its states made when first reached.

    The encoding of every prefix of a piece ends in one token, and a token can follow
    another if and only if the two are what their joined bytes are encoded as. So the
    last token of a prefix and its token count follow from those of shorter prefixes,
    as far back as some token may still begin. A state is just that: the bytes that
    may begin a token to come, with the last token of the prefix before each of them
    and how many tokens that prefix has less than the whole. A transition reads a byte,
    emits the change of the token count (which merging may lower) and drops what no
    token can reach any more, so states are finite in number. The last byte of a piece
    is another symbol, with the end-of-word mark, and its transition leads out.
    """

    def __init__(self, config: dict):
        model = config["model"]
        suffix, code = model["end_of_word_suffix"], {c: b for b, c in byte_characters().items()}
        spelled = {}  # token -> its bytes, and whether it ends a word
        for token, number in model["vocab"].items():
            ends = token.endswith(suffix) and token != suffix
            chars = token.removesuffix(suffix) if ends else token
            if all(c in code for c in chars):
                spelled[number] = bytes(code[c] for c in chars), ends
        vocabulary = model["vocab"]
        #: (left, right) -> (rank, token), and of each token the merge that makes it: (rank, left, right), rank -1 for single bytes.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = {i: (-1, i, i) for i in vocabulary.values()}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            left, right, token = vocabulary[x], vocabulary[y], vocabulary[x + y]
            self.merges[left, right] = rank, token
            if self.made[token][0] < 0:
                self.made[token] = rank, left, right
        # a token that earlier merges keep from being made is in no encoding
        spelled = {i: x for i, x in spelled.items() if self.made[i][0] < 0 or self.apart(*self.made[i][1:], self.made[i][0])}
        self.inner = {b: i for i, (b, ends) in spelled.items() if not ends}
        self.final = {b: i for i, (b, ends) in spelled.items() if ends}
        self.heads = {b[:k] for b, _ in spelled.values() for k in range(len(b) + 1)}
        self.follows: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.places = {(b"", (None,), (0,)): 0}
        self.states = [(b"", (None,), (0,))]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.last: list[dict[int, int]] = [{}]

    def may_follow(self, before: int | None, token: int) -> bool:
        """Whether the encoding can have ``token`` after ``before`` (None: at the start).

        Merges happen in the order of their ranks, and of one rank from the left. So the
        two are taken apart again, the later merge first, and no merge across their border
        may come before what is still together there.
        """
        if before is None:
            return True
        key = (before, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            known = self.follows[key] = self.apart(before, token)
        return known

    def apart(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge ranked before ``limit`` crosses the border of two tokens."""
        made, merges = self.made, self.merges
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < limit:
                return False
            one, two = made[left], made[right]
            if one[0] > two[0]:
                limit, left = one[0], one[2]
            elif two[0] >= 0:
                limit, right = two[0] + 1, two[1]  # of one rank, the merge across is the one on the left
            else:
                return True

    def ending(self, state: int, byte: int, tokens: dict[bytes, int]) -> tuple[bytes, int, int]:
        """(bytes of the state and this one, the last token, how many more tokens)."""
        data, lasts, counts = self.states[state]
        data += BYTES[byte]
        follows = self.follows
        for k, before in enumerate(lasts):
            token = tokens.get(data[k:])
            if token is not None and (follows.get((before, token)) or self.may_follow(before, token)):
                return data, token, counts[k] + 1
        raise ValueError(f"no token for byte {byte}")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, emitted)."""
        data, token, emitted = self.ending(state, byte, self.inner)
        _, lasts, counts = self.states[state]
        heads, cut = self.heads, 0
        while data[cut:] not in heads:
            cut += 1
        key = data[cut:], (*lasts[cut:], token), (*[c - emitted for c in counts[cut:]], 0)
        place = self.places.get(key)
        if place is None:
            place = self.places[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.last.append({})
        self.next[state][byte] = made = place, emitted
        return made

    def read(self, state: int, data: bytes) -> tuple[int, int]:
        """(state, emitted) after inner bytes of a piece."""
        total, following = 0, self.next
        for byte in data:
            state, emitted = following[state].get(byte) or self.step(state, byte)
            total += emitted
        return state, total

    def close(self, state: int, byte: int) -> int:
        """What the last byte of a piece emits."""
        emitted = self.last[state].get(byte)
        if emitted is None:
            emitted = self.last[state][byte] = self.ending(state, byte, self.final)[2]
        return emitted

    def count(self, piece: bytes) -> int:
        """Tokens of a piece that is not empty."""
        if len(self.states) > STATES:
            self.restart()
        state, total = self.read(0, piece[:-1])
        return total + self.close(state, piece[-1])

    def kept(self, state: int) -> int:
        """The number of a state after starting afresh, where there are too many."""
        if len(self.states) <= STATES:
            return state
        key = self.states[state]
        self.restart()
        place = self.places.setdefault(key, len(self.states))
        if place == len(self.states):
            self.states.append(key)
            self.next.append({})
            self.last.append({})
        return place


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in vocabularies of bytes: printable Latin-1 for itself, the rest from U+0100 on in order."""
    shown = {b for b in range(256) if chr(b).isprintable() and b != 0x20}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class RunCounter:
    """Tokens of a run of characters without ASCII white space: special strings, normal form, pieces, and their counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        for part, kind in ((config["normalizer"], "Sequence"), (config["pre_tokenizer"], "Sequence"), (config["model"], "BPE")):
            if part["type"] != kind:
                raise ValueError(f"{path}: {part['type']} is not supported")
        steps = [n["type"] for n in config["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or [n["type"] for n in config["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: other normalizing or splitting steps than NFC, white space, lower case and one split into bytes")
        pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in config["added_tokens"]) or r"(?!)")
        self.reach = max((len(t["content"]) for t in config["added_tokens"]), default=1)
        self.machine, self.pieces = PieceTransducer(config), {}

    def piece(self, piece: bytes) -> int:
        if len(piece) > LONG:
            return self.machine.count(piece)
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            n = self.pieces[piece] = self.machine.count(piece)
        return n

    def count(self, run: bytes) -> int:
        if len(run) > LONG:
            return LongRun(self).count(run)
        low = run.lower()
        if low.isalpha():
            return self.piece(low)
        text = run.decode("utf-8")
        parts = self.special.split(text) if "<" in text else [text]
        return len(parts) - 1 + sum([self.piece(p.encode()) for part in parts for p in self.split.findall(normal(part))])


def normal(text: str) -> str:
    return text.lower() if text.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", text)])


def starts_afresh(c: str) -> bool:
    """Whether normalising what stands before a character cannot depend on it: no mark, and no Hangul vowel or final."""
    return c < "\x80" or unicodedata.category(c)[0] != "M" and not "\u1160" <= c <= "\u11ff" and not unicodedata.combining(c)


class LongRun:
    """Counts a run of any length window by window.

    ``raw`` are characters that may still belong to a special string or be composed with
    what follows. ``rest`` are normal characters whose piece may go on. Of a piece that is
    longer than that, all but its end has been read: ``state`` says where the transducer
    stands (None: no piece is open), ``held`` is the last byte read, which may be the
    piece's last, ``context`` its last characters. Only marks without end, which have to
    be sorted as a whole, make ``raw`` long.
    """

    def __init__(self, counter: RunCounter):
        self.counter, self.total = counter, 0
        self.raw, self.rest, self.context = "", "", ""
        self.state: int | None = None
        self.held = b""

    def count(self, run: bytes) -> int:
        decoder = codecs.getincrementaldecoder("utf-8")()
        for i in range(0, len(run), WINDOW):
            self.raw += decoder.decode(run[i : i + WINDOW])
            self.release(False)
        self.release(True)
        self.pieces("", True)
        return self.total

    def release(self, final: bool) -> None:
        """Normalise what nothing that follows can change."""
        cut, specials = len(self.raw), list(self.counter.special.finditer(self.raw)) if "<" in self.raw else []
        if not final:
            cut -= self.counter.reach
            while cut > 0 and not starts_afresh(self.raw[cut]):
                cut -= 1
            cut = next((m.start() for m in specials if m.start() < cut < m.end()), cut)
        if cut <= 0:
            return
        at = 0
        for m in specials:
            if m.end() <= cut:
                self.pieces(normal(self.raw[at : m.start()]), True)
                self.total, at = self.total + 1, m.end()
        self.pieces(normal(self.raw[at:cut]), False)
        self.raw = self.raw[cut:]

    def read(self, text: str) -> None:
        """Characters of the open piece, the last byte of which stays in hand."""
        machine, data = self.counter.machine, self.held + text.encode()
        if data:
            self.state, emitted = machine.read(machine.kept(self.state), data[:-1])
            self.total, self.held = self.total + emitted, data[-1:]

    def pieces(self, more: str, final: bool) -> None:
        """Count the pieces that are whole; with ``final`` the last one is."""
        text = self.context + self.rest + more
        stop, at = len(text) if final else len(text) - AHEAD, len(self.context)
        self.rest = ""
        for m in self.counter.split.finditer(text):
            whole = m.end() <= stop
            if self.state is not None:  # the first piece goes on from its context
                self.read(text[at : m.end() if whole else max(at, m.end() - CONTEXT - AHEAD)])
                if not whole:
                    at = max(at, m.end() - CONTEXT - AHEAD)
                    self.context, self.rest = text[max(0, at - CONTEXT) : at], text[at:]
                    return
                self.total += self.counter.machine.close(self.state, self.held[0])
                self.state, self.held, self.context = None, b"", ""
            elif whole:
                self.total += self.counter.piece(m[0].encode())
            else:
                at = m.start()
                if m.end() - at > 4 * CONTEXT:
                    end = m.end() - CONTEXT - AHEAD
                    self.state = 0
                    self.read(text[at:end])
                    self.context, at = text[end - CONTEXT : end], end
                self.rest = text[at:]
                return


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the transducer: from the state of prefix p to its exit state, and the tokens emitted.

    ``head`` is the run that continues the prefix on entry, ``tail`` the prefix on
    exit, both as places in the text. Without white space inside (``open``) the chunk
    only lengthens the prefix.
    """

    head: tuple[int, int]
    emitted: int
    tail: tuple[int, int]
    open: bool

    def then(self, other: ChunkMap, count) -> ChunkMap:
        """This chunk and the one that follows it; ``count`` counts the run at a place."""
        if self.open:
            return ChunkMap((self.head[0], other.head[1]), other.emitted, other.tail, other.open)
        across = self.tail[0], other.head[1]
        if other.open:
            return ChunkMap(self.head, self.emitted, across, False)
        return ChunkMap(self.head, self.emitted + count(*across) + other.emitted, other.tail, False)


class CountTransducer:
    """The transducer over whole texts, with the paths of known runs from the start state back to it as one transition each."""

    def __init__(self, path: str):
        self.runs, self.transitions = RunCounter(path), {b"": 0}

    def compile(self, found: set[bytes]) -> None:
        if len(self.transitions) > RUNS:
            self.transitions = {b"": 0}
        count = self.runs.count
        self.transitions.update([(r, count(r)) for r in found if r not in self.transitions])

    def count(self, run: bytes) -> int:
        if len(run) > LONG:
            return self.runs.count(run)
        if run not in self.transitions:
            self.compile({run})
        return self.transitions[run]

    def chunk(self, data: bytes, start: int) -> ChunkMap:
        """The state map of the chunk that lies at ``start``."""
        inner, end = data.split(), start + len(data)
        if not data or len(inner) == 1 and len(inner[0]) == len(data):
            return ChunkMap((start, end), 0, (end, end), True)
        head = len(inner.pop(0)) if inner and not data[:1].isspace() else 0
        tail = len(inner.pop()) if inner and not data[-1:].isspace() else 0
        try:
            emitted = sum(map(self.transitions.__getitem__, inner))
        except KeyError:
            self.compile(set(inner))
            emitted = sum(map(self.transitions.__getitem__, inner))
        return ChunkMap((start, start + head), emitted, (end - tail, end), False)

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text: chunk maps, then the up-sweep of a scan over the chunks of each text."""
        out = []
        for t in texts:
            count = lambda i, j, t=t: self.count(t[i:j])
            whole = self.sweep([self.chunk(t[i : i + CHUNK], i) for i in range(0, len(t), CHUNK)] or [self.chunk(t, 0)], count)
            out.append(count(*whole.head) + whole.emitted + count(*whole.tail))
        return out

    def sweep(self, maps: list[ChunkMap], count) -> ChunkMap:
        """The composition of all maps, in log2(n) rounds of independent steps; each border is crossed once."""
        while len(maps) > 1:
            pairs = [a.then(b, count) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[2 * len(pairs) :]
        return maps[0]


def _parts(items: list, n: int) -> Iterator[list]:
    return (items[i : i + n] for i in range(0, len(items), n))


def transducer(path: str) -> CountTransducer:
    return kept(f"transducer {path}", lambda: CountTransducer(path))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; null counts as empty.

    Special strings inside a text are special tokens, as is the library's default.
    Repeated rows stay repeated, null doc_ids stay null, other columns are not read.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            n = np.array(machine.counts(texts), np.int64)
            size = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
