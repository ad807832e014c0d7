"""The flash-card service as tables, over its local JSON interface (version 6)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Where the service listens.
URLS = ("http://127.0.0.1:8765", "http://localhost:8765")
TIMEOUT, BATCH = 10, 500
NOTES = "noteId long, modelName string, cards array<long>, fields map<string,struct<value:string>>"
CARDS = "cardId long, deckName string"


def post(url: str, body: bytes) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=TIMEOUT) as r:
        return r.read()


def invoke(action: str, params: dict, send: Callable[[str, bytes], bytes] = post, urls: tuple[str, ...] = URLS):
    """The result of an action from the first address that answers."""
    body, failure = json.dumps({"action": action, "version": 6, "params": params}).encode(), None
    for url in urls:
        try:
            got = json.loads(send(url, body))
        except (OSError, urllib.error.URLError) as e:
            failure = e
            continue
        if got.get("error"):
            raise RuntimeError(str(got["error"]))
        return got.get("result")
    raise RuntimeError(f"the card service does not answer: {failure}")


def tables(spark: SparkSession, note_ids: Iterator[int], send: Callable[[str, bytes], bytes] = post) -> tuple[DataFrame, DataFrame]:
    """(notes, cards) of the service for the given ids, asked in batches; the service is a person's own collection on one machine."""
    ids = list(note_ids)
    found = [n for i in range(0, len(ids), BATCH) for n in invoke("notesInfo", {"notes": ids[i : i + BATCH]}, send) if isinstance(n.get("noteId"), int)]
    cards = [c for n in found for c in n.get("cards", [])]
    known = [c for i in range(0, len(cards), BATCH) for c in invoke("cardsInfo", {"cards": cards[i : i + BATCH]}, send) if isinstance(c.get("cardId"), int)]
    notes = [(n["noteId"], n.get("modelName"), n.get("cards", []), {k: (v.get("value"),) for k, v in n.get("fields", {}).items()}) for n in found]
    return spark.createDataFrame(notes, NOTES), spark.createDataFrame([(c["cardId"], c.get("deckName")) for c in known], CARDS)
