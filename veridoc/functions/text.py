"""Scalar text functions, as column expressions.

Positions and lengths count code points. White space is Unicode white space unless a name says ASCII.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two dashes that comparison keeps apart from the hyphen.
PROTECTED = "–—"
# Calls to action that web text loses.
CALLS = (
    "back to top", "read more", "learn more", "click here", "know more", "view more",
    "book now", "contact us", "get in touch", "follow us", "subscribe", "share this",
)
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "Ltd", "Inc", "Corp", "Co", "vs", "etc", r"i\.e", r"e\.g", "Fig", "No", "Vol",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Rs", "INR",
)
SPACE = r"[\s\p{Z}\x{85}]"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, inside a single expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pytrim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}++$", "")


def split_words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


@cache
def typographic_map() -> tuple[str, str]:
    """Characters whose Unicode names make them quotes or spaces, and what they become, one for one."""
    single, double, space = [], [], []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        name = unicodedata.name(c, "")
        if any(k in name for k in ("APOSTROPHE", "SINGLE QUOTATION", "GRAVE ACCENT", "ACUTE ACCENT")):
            single.append(c)
        elif "DOUBLE QUOTATION" in name:
            double.append(c)
        elif unicodedata.category(c) == "Zs":
            space.append(c)
    pairs = [(a, b) for group, b in ((single, "'"), (double, '"'), (space, " ")) for a in group if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def typographic(c: Column) -> Column:
    """Quotes and spaces in their plain form; never changes the length."""
    return F.translate(c, *typographic_map())


def wide_spaces(c: Column) -> Column:
    """How many spaces other than the plain one a text has."""
    spaces = "".join(a for a, b in zip(*typographic_map(), strict=True) if b == " ")
    return F.length(c) - F.length(F.translate(c, spaces, ""))


def title_case(c: Column) -> Column:
    """A capital after every non-letter, as in brand names derived from hosts."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def runs_of(pattern: str, around: int):
    """All matches of a pattern with the text around them, as an Arrow function, linear in the text:
    array<struct<at (from 0), found, context, before>>; before: characters of the context before the match."""
    find = re.compile(pattern).finditer

    @F.pandas_udf("array<struct<at:int,found:string,context:string,before:int>>")
    def to_runs(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict] | None:
            if t is None:
                return None
            spans = ((m.start(), m.end(), max(0, m.start() - around)) for m in find(t))
            return [{"at": a, "found": t[a:b], "context": t[start : b + around], "before": a - start} for a, b, start in spans]

        return s.map(one)

    return to_runs


def normalise(form: str):
    """A Unicode normal form as an Arrow function."""

    @F.pandas_udf("string")
    def to_form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return to_form


def fold(mapping: dict[str, str]):
    """Compatibility form, look-alike folding of non-ASCII characters that are not protected, compatibility form again."""

    @F.pandas_udf("string")
    def to_folded(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None or t.isascii():
                return t
            t = unicodedata.normalize("NFKC", t)
            if mapping:
                t = unicodedata.normalize("NFKC", "".join(c if c.isascii() or c in PROTECTED else mapping.get(c, c) for c in t))
            return t

        return s.map(one)

    return to_folded


def rejoin_hyphens(c: Column) -> Column:
    """White space after a hyphen between letters goes."""
    return F.regexp_replace(c, rf"([A-Za-z])-{SPACE}+([A-Za-z])", "$1-$2")


def prepare(c: Column) -> Column:
    """Web text before comparison: composed form, trimmed, nothing else."""
    return pytrim(normalise("NFC")(c))


def prepare_for_comparison(c: Column, mapping: dict[str, str]) -> Column:
    return pytrim(rejoin_hyphens(fold(mapping)(c)))
