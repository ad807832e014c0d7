"""Naming pairs: filename and first definition sentence, YAML title and H1; and facts about cloze cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegauge.functions import text as X
from notegauge.operators import rules


def visible(sentence: Column) -> Column:
    """As a reader sees it: clozes open, links shown, emphasis and code marks gone, no final period."""
    shown = F.regexp_replace(X.rendered_links(X.uncloze(sentence)), r"[*_`]+", "")
    return F.regexp_replace(X.strip(shown), r"\.\z", "")


def first_sentence(paragraph: Column) -> Column:
    return F.get(F.split(paragraph, r"(?<=[.!?])\s+"), F.lit(0))


def named(stem: Column) -> Column:
    """A stem without its timestamp."""
    return F.regexp_replace(stem, r"^\d{12}\s+", "")


def alignment(notes: DataFrame) -> DataFrame:
    """(note_path, definition, filename_aligned, title_aligned): null where a note has no such pair.

    The definition is the prose's first paragraph, else the section under a definition
    heading, else the first card's.
    """
    df = rules.parsed(notes)
    section = F.get(F.filter("lex.sections", lambda s: s["name"] == "definition"), F.lit(0))["text"]
    card = F.get(F.get("lex.cards", F.lit(0))["front"], F.lit(0))
    source = F.coalesce(X.strip(section), F.get("lex.prose", F.lit(0)), card)
    title = F.nullif(F.regexp_extract("frontmatter", r"(?m)^title:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    top = F.get(F.filter("lex.headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    definition = visible(first_sentence(source))
    return df.select("note_path", definition.alias("definition"), (definition == named(F.col("stem"))).alias("filename_aligned"), (title == top).alias("title_aligned"))


def cloze_cards(text: Column) -> Column:
    """Cards that a cloze text makes: one per distinct ordinal."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{c(\d+)::"), F.lit(1))))


def parent_entry_ok(line: Column, stem: Column) -> Column:
    """A structure note lists a note by a plain link of its full stem."""
    return F.contains(line, F.concat(F.lit("[["), stem, F.lit("]]")))
