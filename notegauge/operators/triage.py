"""What to look at next: notes to judge, notes on hold, and facts before a destructive step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.functions.lexer import lexed
from notegauge.operators import anki, scoring

#: Of the apparently clean notes, one in so many is judged as well.
SAMPLE_EVERY = 10
# Findings that hold a note until its owner decides, with what is recommended.
HELD = {"duplicate_overlap": "Compare with the overlapping notes and decide which to keep.", "anki_yagni": "Decide whether the card is worth memorizing."}


def to_judge(rows: DataFrame, exhaustive: bool = False, every: int = SAMPLE_EVERY) -> DataFrame:
    """(note_path, reason): flagged notes, and a sample of clean ones that is the same in every run; all notes if ``exhaustive``."""
    flagged = (F.size("findings") > 0) | F.coalesce(F.col("factual_risk"), F.lit(False)) | F.coalesce(F.col("score") < 100, F.lit(True))
    drawn = F.conv(F.substring(F.sha2(F.col("note_path"), 256), 1, 8), 16, 10).cast("long") % every == 0
    reason = F.when(flagged, "flagged").when(drawn, "sample").when(F.lit(exhaustive), "exhaustive")
    return rows.select("note_path", reason.alias("reason")).filter("reason is not null")


def holds(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(note_path, note_link, reason, recommendation, status, next_action): the queue of decisions.

    ``known`` is the queue so far. What is in it and still found keeps its status; what
    is no longer found is resolved; the queue never loses a note.
    """
    codes = F.array_intersect(scoring.codes(F.col("findings")), F.array(*map(F.lit, HELD)))
    advice = scoring.literal_map(HELD)
    now = rows.select("note_path", "note_link", F.explode(codes).alias("reason"))
    now = now.select("*", F.element_at(advice, F.col("reason")).alias("recommendation"))
    if known is None:
        return now.select("*", F.lit("open").alias("status"), F.lit("Await the owner's decision.").alias("next_action"))
    old = known.select("note_path", "reason", F.col("note_link").alias("__link"), F.col("recommendation").alias("__advice"), "status", "next_action")
    both = now.withColumn("__found", F.lit(True)).join(old, ["note_path", "reason"], "full")
    found = F.col("__found").isNotNull()
    status = F.when(~found, "resolved").when(F.col("status").isNull() | (F.col("status") == "resolved"), "open").otherwise(F.col("status"))
    action = F.when(~found, "None.").otherwise(F.coalesce(F.when(F.col("status") != "resolved", F.col("next_action")), F.lit("Await the owner's decision.")))
    return both.select("note_path", F.coalesce("note_link", "__link").alias("note_link"), "reason", F.coalesce("recommendation", "__advice").alias("recommendation"), status.alias("status"), action.alias("next_action"))


def dry_run_facts(notes: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(note_path, backlinks, outgoing, card_markers, card_ids, card_doubt, stop) of notes (note_path, stem, content): what a person should know before one is deleted, split or moved.

    ``backlinks`` counts the other notes that link to it; a note with cards or a doubt
    about them (``rows`` has the audit's findings) stops the step.
    """
    told = notes.select("note_path", "stem", "content", F.array_distinct(F.filter(F.transform(lexed("content", "links")["links"], X.link_target), lambda x: x != "")).alias("links"))
    # links are summed up by the name they give before they meet the notes, so a hub costs one row; a note's link to itself is taken off
    named = told.select(F.explode("links").alias("stem")).groupBy("stem").agg(F.count("*").alias("__n"))
    own = F.array_contains("links", F.col("stem")).cast("long")
    df = told.join(named, "stem", "left").select(
        "note_path", (F.coalesce("__n", F.lit(0)) - F.coalesce(own, F.lit(0))).alias("backlinks"), F.size("links").alias("outgoing"),
        F.col("content").rlike(anki.CARD_MARK).alias("card_markers"), anki.card_ids(F.col("content")).alias("card_ids"),
    )
    if rows is not None:
        df = df.join(rows.select("note_path", scoring.has(F.col("findings"), "anki_yagni").alias("__doubt")), "note_path", "left")
    doubt: Column = F.coalesce("__doubt", F.lit(False)) if rows is not None else F.lit(False)
    stop = F.col("card_markers") | (F.size("card_ids") > 0) | doubt
    return df.select("note_path", F.col("backlinks").cast("long").alias("backlinks"), "outgoing", "card_markers", "card_ids", doubt.alias("card_doubt"), stop.alias("stop"))
