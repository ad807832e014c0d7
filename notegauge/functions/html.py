"""HTML to visible text."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegauge.runtime import ship


#: A character reference that ends in a semicolon.
CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[0-9A-Za-z]+);")


def unescape_closed(text: str) -> str:
    """As html.unescape, but of the references that end in a semicolon alone: &amp and &ampx; stay as they are."""
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0]), text)


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_closed, na_action="ignore")


def visible(source: Column, closed: bool = False) -> Column:
    """Character references resolved (all named and numeric ones, once), hard spaces as spaces, tags gone.

    References come first: an escaped tag is a tag by then, and goes. Only texts with
    an ampersand cross to Python, where the table of names is. The old names that
    need no semicolon (&amp, &copy) are references too, as in a browser and for the
    card service, unless only ``closed`` ones are wanted.
    """
    ship()
    escaped = F.contains(source, F.lit("&"))
    unescaped = _unescaped_closed if closed else _unescaped
    text = F.when(escaped, unescaped(F.when(escaped, source))).otherwise(source)
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"(?s)<[^>]*>", "")
