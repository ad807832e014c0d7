"""Flash-card verification over injected tables: what the notes say against what the card service holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions.html import visible
from notegauge.functions.text import let, stripped_lines
from notegauge.operators.validate import violations
from notegauge.runtime import scratch

ID = r"<!--ID:\s*(\d+)-->"
CARD_MARK = r"(?m)^\s*(?:TARGET DECK:.*|START|END|Basic|Cloze)\s*$"


def normalized(spec: DataFrame) -> DataFrame:
    """Entries with defaults: a Basic card in the deck General, one card, a list of texts to look for.

    ``violations`` lists what is wrong with an entry.
    """
    c = F.col
    df = spec.select(
        "entry", "note_path", F.coalesce("anki", F.lit(True)).alias("anki"), F.coalesce("expected_model", F.lit("Basic")).alias("expected_model"),
        F.coalesce("expected_deck", F.lit("General")).alias("expected_deck"), F.coalesce("expected_card_count", F.lit(1)).alias("expected_card_count"), "representative_text",
    )
    on = c("anki")
    return df.withColumn(
        "violations",
        violations(
            (c("note_path").isNull() | (c("note_path") == ""), "spec entry requires note_path"),
            (c("note_path").startswith("/") | F.array_contains(F.split("note_path", "/"), ".."), "note_path must stay inside vault"),
            (on & (c("expected_model") == ""), "expected_model must be a non-empty string"),
            (on & (c("expected_deck") == ""), "expected_deck must be a non-empty string"),
            (on & (c("expected_card_count") < 1), "expected_card_count must be a positive integer"),
            (on & c("representative_text").isNull(), "representative_text is required for Anki-backed notes"),
            (on & ((F.size("representative_text") == 0) | F.exists("representative_text", lambda t: F.trim(t) == "")), "representative_text must be a string or string list"),
        ),
    )


def marker_violations(text: Column, model: Column, deck: Column) -> Column:
    """One deck line, as expected; one START before one END; the model's name and some content between them."""

    def marked(t: Column) -> Column:
        decks = F.regexp_extract_all(t, F.lit(r"(?m)^\s*TARGET DECK:[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
        return let(F.struct(decks.alias("decks"), stripped_lines(t).alias("rows")), placed)

    def placed(m: Column) -> Column:
        others = lambda mark: F.size(F.array_remove(m["rows"], mark))
        once = (others("START") == F.size(m["rows"]) - 1) & (others("END") == F.size(m["rows"]) - 1)
        start, end = (F.array_position(m["rows"], mark).cast("int") for mark in ("START", "END"))
        return let(F.struct(once.alias("once"), start.alias("start"), end.alias("end")), lambda p: cut(m, p))

    def cut(m: Column, p: Column) -> Column:
        block = p["once"] & (p["start"] < p["end"])
        inside = F.when(block, F.slice(m["rows"], p["start"] + 1, F.greatest(F.lit(0), p["end"] - p["start"] - 1))).otherwise(m["rows"])
        return let(F.struct(block.alias("block"), inside.alias("inside")), lambda b: told(m["decks"], b["block"], b["inside"]))

    def told(decks: Column, block: Column, inside: Column) -> Column:
        has_model = F.array_contains(inside, model)
        return violations(
            (F.size(decks) == 0, "missing TARGET DECK marker"),
            (F.size(decks) > 1, "expected exactly one TARGET DECK marker"),
            ((F.size(decks) == 1) & (F.get(decks, F.lit(0)) != deck), F.concat(F.lit("source deck="), F.coalesce(F.get(decks, F.lit(0)), F.lit("")), F.lit(", expected="), deck)),
            (~block, "expected exactly one START/END block"),
            (~has_model, F.concat(F.lit("missing "), model, F.lit(" model marker"))),
            (block & has_model & (F.size(F.array_remove(F.array_remove(inside, ""), model)) == 0), F.concat(F.lit("missing local "), model, F.lit(" card content"))),
        )

    return let(text, marked)


def source_checks(spec: DataFrame, notes: DataFrame) -> DataFrame:
    """(entry, note_path, anki, note_id, expected..., violations): what the note files alone tell."""
    df = normalized(spec).join(notes.select("note_path", F.col("content").alias("text")), "note_path", "left")
    df = df.withColumn("ids", card_ids(F.col("text"))).withColumn("note_id", F.get("ids", F.lit(0)))
    on = F.col("anki") & F.col("text").isNotNull()
    one = F.size("ids") == 1
    own = F.when(on & one, marker_violations(F.col("text"), F.col("expected_model"), F.col("expected_deck"))).otherwise(
        violations(
            (F.col("text").isNull(), "unable to read note"),
            (on & ~one, F.concat(F.lit("expected exactly one ID, found "), F.size("ids").cast("string"))),
            (~F.col("anki") & F.col("note_id").isNotNull(), F.concat(F.lit("expected no ID, found "), F.col("note_id").cast("string"))),
            (~F.col("anki") & F.col("text").rlike(CARD_MARK), "expected no card markers"),
        )
    )
    columns = ("entry", "note_path", "anki", "expected_model", "expected_deck", "expected_card_count", "representative_text", "violations", "note_id")
    df = df.withColumn("violations", F.concat("violations", own)).select(*columns)
    path = scratch(df.sparkSession)
    df.write.parquet(path)  # two readings follow, and the markers are a pass over all texts
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    # the first entry of each ID, of all that state it, and the first of those without violations
    stated = df.filter("note_id is not null")
    sound = F.col("anki") & (F.size("violations") == 0)
    owners = stated.groupBy(F.col("note_id").alias("__key")).agg(F.min_by("note_path", "entry").alias("__first"), F.min(F.when(sound, F.col("entry"))).alias("__owner"))
    # notes without an ID have keys of their own, which no ID has, so that they do not meet in one task
    df = df.withColumn("__key", F.coalesce("note_id", -F.col("entry").cast("long") - 1)).join(owners, "__key", "left").withColumn("__again", F.coalesce(sound & (F.col("entry") > F.col("__owner")), F.lit(False)))
    again = F.array(F.concat(F.lit("duplicate ID "), F.col("note_id").cast("string"), F.lit(" also appears in "), F.col("__first")))
    df = df.withColumn("violations", F.when(F.col("__again"), again).otherwise(F.col("violations")))
    return df.select(*columns)


def card_ids(text: Column) -> Column:
    """The IDs that a note states, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(ID), F.lit(1)), lambda x: x.cast("bigint"))


def service_checks(checked: DataFrame, anki_notes: DataFrame, anki_cards: DataFrame) -> DataFrame:
    """(entry, note_path, violations) of sound entries against the service's notes and cards."""
    sound = checked.filter(F.col("anki") & (F.size("violations") == 0))
    df = sound.join(anki_notes.select(F.col("noteId").alias("note_id"), "modelName", "cards", "fields"), "note_id", "left")
    owned = df.select("entry", "expected_deck", F.explode("cards").alias("cardId")).join(anki_cards.withColumn("known", F.lit(True)), "cardId", "left")
    decks = owned.groupBy("entry").agg(F.array_sort(F.collect_set("deckName")).alias("decks"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("cardId")))).alias("lost"))
    df = df.join(decks, "entry", "left")
    shown = F.array_join(F.transform(F.map_values("fields"), lambda f: F.coalesce(f["value"], F.lit(""))), "\n")
    field = lambda k: F.trim(visible(F.coalesce(F.col("fields")[k]["value"], F.lit(""))))
    missing = F.filter("representative_text", lambda t: ~F.contains(shown, t))
    here = F.col("modelName").isNotNull() | F.col("cards").isNotNull()
    basic = F.col("expected_model") == "Basic"
    found = violations(
        (~here, F.concat(F.lit("Anki note ID "), F.col("note_id").cast("string"), F.lit(" does not resolve"))),
        (here & ~F.col("modelName").eqNullSafe(F.col("expected_model")), F.concat(F.lit("model="), F.coalesce("modelName", F.lit("none")), F.lit(", expected="), F.col("expected_model"))),
        (here & (F.size("cards") != F.col("expected_card_count")), F.concat(F.lit("card_count="), F.size("cards").cast("string"), F.lit(", expected="), F.col("expected_card_count").cast("string"))),
        (here & (F.size("lost") > 0), "missing card info"),
        (here & ~F.coalesce(F.col("decks") == F.array("expected_deck"), F.lit(False)), F.concat(F.lit("decks="), F.coalesce(F.array_join("decks", ","), F.lit("")), F.lit(", expected="), F.col("expected_deck"))),
        (here & (F.trim(shown) == ""), "rendered Anki fields are empty"),
        (here & basic & (field("Front") == ""), "Basic Front field is empty"),
        (here & basic & (field("Back") == ""), "Basic Back field is empty"),
        (here & (F.size(missing) > 0), F.concat(F.lit("representative text missing: "), F.array_join(missing, ", "))),
    )
    return df.select("entry", "note_path", found.alias("violations"))


def verify(spec: DataFrame, notes: DataFrame, anki_notes: DataFrame, anki_cards: DataFrame) -> DataFrame:
    """(entry, note_path, violations), empty violations for entries that hold; the service is asked only about sound entries."""
    checked = source_checks(spec, notes)
    told = service_checks(checked, anki_notes, anki_cards).select("entry", F.col("violations").alias("more"))
    return checked.join(told, "entry", "left").select("entry", "note_path", F.concat("violations", F.coalesce("more", F.array().cast("array<string>"))).alias("violations"))
