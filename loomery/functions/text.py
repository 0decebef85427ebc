"""Column expressions on text that stay inside Catalyst, and the one that cannot."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One blank character, Unicode separators included.
BLANK = r"[\s\x0B\p{Z}]"
#: A search token: starts with a letter or digit and keeps what holds names like c++ or ci/cd together.
TOKEN = r"[a-z0-9][a-z0-9+#./-]*"


#: The same characters one by one, for trimming without a regular expression.
BLANKS = " \t\n\r\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def all_but(kept: str) -> str:
    """A class of all characters but some, as ranges: Java matches these far faster than a negated class."""
    points = sorted(map(ord, set(kept)))
    spans = zip([0, *[p + 1 for p in points]], [*[p - 1 for p in points], 0x10FFFF])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans if a <= b) + "]"


#: What a fingerprint and a skill's text drop.
NOT_PRINTED = all_but("abcdefghijklmnopqrstuvwxyz0123456789 ")
NOT_NAMED = all_but("abcdefghijklmnopqrstuvwxyz0123456789+#.")


def strip(text: Column) -> Column:
    """The text without outer blanks of any kind (``trim`` only removes spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_default(value: Column, default: str) -> Column:
    """A default for null and empty values alike."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def paragraphs(text: Column, delimiter: str = "\n\n") -> Column:
    """Stripped, non-empty paragraphs of a text; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), delimiter), strip)
    return F.filter(parts, lambda p: p != "")


def fingerprint(paragraph: Column) -> Column:
    """SHA-1 of the paragraph's lower-cased letters a-z, digits and single spaces; other characters are deleted."""
    kept = F.regexp_replace(F.lower(paragraph), f"{NOT_PRINTED}+", "")
    return F.sha1(F.trim(F.regexp_replace(kept, " {2,}", " ")))


def tokens(text: Column) -> Column:
    """Search tokens in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


@F.pandas_udf(StringType())
def unescape(values: pd.Series) -> pd.Series:
    """HTML entities as the characters they stand for; Spark has no such function."""
    return values.map(html.unescape, na_action="ignore")


def html_to_text(raw: Column) -> Column:
    """Readable text of an HTML fragment; empty for null.

    Entities are resolved, ends of blocks become line feeds, list items get a dash, other tags a blank; entities are
    resolved once more (for doubly escaped sources), blanks collapse, lines are stripped, at most one empty line stays.
    The bodies of scripts and styles stay, since only tags are removed.
    """
    text = unescape(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?i)<\s*(?:br|/(?:p|div|li|h[1-6]|tr))\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)<\s*li[^>]*>", "\n- ")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"[ \t\x{a0}]+", " ")
    text = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_lines(text: Column) -> Column:
    """Line ends as line feeds, single blanks, stripped lines, at most one empty line; empty for null."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    lines = F.transform(F.split(F.regexp_replace(unix, r"[ \t\x{a0}]+", " "), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def citation_label(company: Column, title: Column, section: Column | None = None) -> Column:
    """``company - title, section`` with placeholders for missing names; sections that say nothing are left out."""
    head = F.concat(or_default(company, "Unknown company"), F.lit(" - "), or_default(title, "Untitled role"))
    if section is None:
        return head
    told = section.isNotNull() & ~section.isin("", "other", "unknown")
    return F.when(told, F.concat(head, F.lit(", "), F.replace(section, F.lit("_"), F.lit(" ")))).otherwise(head)
