"""Text functions over Columns: JVM expressions only, usable in any plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of words, frontmatter and comments, and the phrases of an analogy.
#: A word: letters, digits and underscores, with apostrophes and hyphens inside.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
FRONTMATTER = r"(?s)^---[ \t]*\r?\n(?:(.*?)\r?\n)?---[ \t]*(?:\r?\n|\z)"
COMMENT = r"(?s)<!--.*?-->"
ANALOGY = r"(?U)\b(is|are|was|were) like\b|\blike (a|an|the)\b"
ANALOGY_PHRASES = ("think of ", "consider ", "can be compared to")
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WHITE = r"[\s\x1c-\x1f\x85   -     　]"
#: What LINE has besides \n and \r\n, and the characters of WHITE one by one: those of ASCII and the others.
BREAKS_ASCII, BREAKS_OTHER = r"\r\x0b\x0c\x1c-\x1e", r"\x85\u2028\u2029"
WHITE_ASCII = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f"
WHITE_OTHER = "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normalized(content: Column) -> Column:
    """Line breaks as \\n, which is how files are read as text."""
    return F.regexp_replace(content, r"\r\n?", "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(normalized(content), 256)


def frontmatter(content: Column) -> Column:
    """The block at the very start of a note: null without one, empty for an empty one."""
    return F.when(content.rlike(FRONTMATTER), F.regexp_extract(content, FRONTMATTER, 1))


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def lines(text: Column) -> Column:
    """Lines as an editor shows them: a final break begins no line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE})\\z", ""), LINE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def stripped_lines(text: Column) -> Column:
    """strip() of each of lines(). A break of any kind becomes \\n first; where all is ASCII, only its breaks and blanks are looked for, which is far quicker."""
    ascii_ = lambda t: F.octet_length(t) == F.length(t)
    broken = lambda t: F.when(ascii_(t), F.regexp_replace(t, f"[{BREAKS_ASCII}]", "\n")).otherwise(F.regexp_replace(t, f"[{BREAKS_ASCII}{BREAKS_OTHER}]", "\n"))
    ended = lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)
    rows = F.split(let(let(F.replace(text, F.lit("\r\n"), F.lit("\n")), broken), ended), "\n")
    return F.transform(rows, lambda x: F.btrim(x, F.when(ascii_(x), WHITE_ASCII).otherwise(WHITE_ASCII + WHITE_OTHER)))


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def where(text: Column, hints: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that have one of the hints in them; it leaves the others as they are, so it need not be tried."""
    return let(text, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(h)) for h in hints]), change(t)).otherwise(t))


def rendered_links(text: Column, names: bool = True) -> Column:
    """_rendered_links() where there is a link."""
    return where(text, ("[[",), lambda t: _rendered_links(t, names))


def _rendered_links(text: Column, names: bool) -> Column:
    """Links as a reader sees them: aliases, or the note's name without path, heading, suffix and timestamp; embeds vanish."""
    part = r"[^\[\]\r\n|]*"
    text = F.regexp_replace(text, r"!\[\[[^\[\]\r\n]+\]\]", "")
    text = F.regexp_replace(text, rf"\[\[{part}\|[ \t]*([^\[\]\r\n]*?)[ \t]*\]\]", "$1")
    text = F.regexp_replace(text, r"\[\[[ \t]*([^\[\]\r\n|#]*?)[ \t]*(?:#[^\[\]\r\n|]*)?\]\]", "[[$1]]")
    if names:
        text = F.regexp_replace(text, rf"\[\[({part})\.md\]\]", "[[$1]]")
        text = F.regexp_replace(text, r"\[\[(?:[^\[\]\r\n|]*/)?([^\[\]\r\n|/]+)/*\]\]", "[[$1]]")
        text = F.regexp_replace(text, rf"\[\[\d{{12}}[ \t]+({part})\]\]", "[[$1]]")
    return F.regexp_replace(text, rf"\[\[({part})\]\]", "$1")


def uncloze(text: Column) -> Column:
    return where(text, ("{{c",), lambda t: F.regexp_replace(t, r"(?d)\{\{c\d+::(.*?)(?:::.*?)?\}\}", "$1"))


def rendered_words(text: Column) -> Column:
    """Words of the text as rendered: links shown, clozes opened, comments gone."""
    return words(where(uncloze(rendered_links(text)), ("<!--",), lambda t: F.regexp_replace(t, COMMENT, " ")))


def is_analogy(paragraph: Column) -> Column:
    shown = F.lower(rendered_links(paragraph))
    return shown.rlike(ANALOGY) | F.greatest(*[shown.contains(x) for x in ANALOGY_PHRASES])


def is_example(paragraph: Column) -> Column:
    return paragraph.rlike(rf"(?i)^[ \t]*(?:[-*+][ \t]+)?For example,(?:{WHITE}|\z)")


def link_target(target: Column) -> Column:
    """The note that a link names: no heading, suffix or path; empty if nothing is left."""
    name = F.regexp_replace(strip(F.substring_index(target, "#", 1)), r"\.md\z", "")
    return F.element_at(F.split(F.regexp_replace(name, r"/+\z", ""), "/"), -1)


# What is left out of claims, and where they part.
CODE_BLOCK, MATH_BLOCK, MATH, URL = r"(?ms)^[ \t]{0,3}(`{3,}|~{3,}).*?^[ \t]{0,3}\1[ \t]*$", r"(?ms)^\$\$.*?^\$\$", r"\$[^$\r\n]+\$", r"https?://\S+"
HEADING_LINE, MARKER_LINE = r"(?dm)^[ \t]{0,3}#{1,6}[ \t]+.*$", r"(?dm)^\s*(?:TARGET DECK:.*|START|END|Basic|Cloze)\s*$"
BETWEEN_SENTENCES, SENTENCE_EDGE = r"(?dm)(?<=[.!?])\s+|(?:\r?\n){2,}|^\s*[-*+]\s+", " \t\r\n-*"


def without_trailing_references(text: Column) -> Column:
    """Cut the closing block of reference and source labels and what may stand in it, if it has a label."""
    return let(text, lambda t: F.when(reduce(or_, [F.contains(F.lower(t), F.lit(h)) for h in ("reference", "source")]), _without_trailing_references(t)).otherwise(t))


def _without_trailing_references(text: Column) -> Column:
    rows = F.split(text, "\n")
    label = lambda x: F.regexp_replace(x, r"\r\z", "").rlike(r"(?i)^(?:#{1,6}[ \t]+)?(?:reference|source)s?:?[ \t]*\z")
    inside = lambda x: x.rlike(r"^(?:\s*\z|[ \t]+|[-*+]\s|\d+[.)]\s|!\[\[|\[\[)")
    last = F.coalesce(F.array_max(F.transform(rows, lambda x, i: F.when(~(label(x) | inside(x)), i))), F.lit(-1))  # of other lines
    rest = F.slice(rows, last + 2, F.greatest(F.lit(0), F.size(rows) - last - 1))
    return F.when(F.exists(rest, label), F.array_join(F.slice(rows, 1, last + 1), "\n")).otherwise(text)


def sentences(text: Column) -> Column:
    """The sentences whose claims are judged: references, code, math, comments, URLs, headings and card marks left out."""
    text = without_trailing_references(text)
    blanked = lambda pattern: lambda t: F.regexp_replace(t, pattern, " ")
    for hints, pattern in ((("```", "~~~"), CODE_BLOCK), (("$$",), MATH_BLOCK), (("$",), MATH), (("<!--",), COMMENT), (("http",), URL)):
        text = where(text, hints, blanked(pattern))
    text = uncloze(rendered_links(text, names=False))
    for hints, pattern in ((("#",), HEADING_LINE), (("TARGET DECK:", "START", "END", "Basic", "Cloze"), MARKER_LINE)):
        text = where(text, hints, blanked(pattern))
    return F.filter(F.transform(F.split(text, BETWEEN_SENTENCES), lambda s: F.btrim(s, F.lit(SENTENCE_EDGE))), lambda s: s != "")


def table_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.regexp_replace(text, r"\r?\n", "<br>"), F.lit("|"), F.lit("\\|"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ordered_distinct(values: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """The first of the elements with each key, in order."""
    return let(values, lambda v: let(F.transform(v, key), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, key(x)) == i + 1)))
