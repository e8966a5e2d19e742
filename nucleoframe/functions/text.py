"""Text in lines: wrapping at blanks, shortening, common indents."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def one_line(text: Column) -> Column:
    """All blanks and line ends as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def soft_wrap(text: Column, width: int, initial: str = "", subsequent: str = "", break_long: bool = False) -> Column:
    """Lines of at most ``width`` characters that end at blanks; null stays null.

    A word longer than a line stays whole on a line of its own, or is cut with
    ``break_long`` (then in Python, and it begins on the line before it).  The first
    line gets ``initial`` in front, the others ``subsequent``; both count.
    """
    if width <= max(len(initial), len(subsequent)):
        raise ValueError("the width must be greater than the indents")
    if break_long:

        @F.pandas_udf(StringType())
        def cut(s: pd.Series) -> pd.Series:
            make = textwrap.TextWrapper(width, initial, subsequent, break_on_hyphens=False)
            return s.map(lambda t: make.fill(t), na_action="ignore")

        return cut(one_line(text))

    def lines(n: int) -> str:
        return rf"(?:(.{{1,{n}}})(?= |$)|(\S+)) ?"

    t = one_line(text)
    if len(initial) == len(subsequent):
        body = F.regexp_replace(t, lines(width - len(initial)), f"\n{_plain(subsequent)}$1$2")
        return F.when(t == "", "").otherwise(F.concat(F.lit(initial), F.substring(body, 2 + len(subsequent), 1 << 30)))
    first = F.regexp_extract(t, "^" + lines(width - len(initial)), 0)
    rest = F.regexp_replace(F.substr(t, F.length(first) + 1), lines(width - len(subsequent)), f"\n{_plain(subsequent)}$1$2")
    return F.when(t == "", "").otherwise(F.concat(F.lit(initial), F.rtrim(first), rest))


def _plain(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def shortened(text: Column, width: int, placeholder: str = " [...]") -> Column:
    """One line of at most ``width`` characters: whole, or as many words as leave room for the placeholder."""
    if width < len(placeholder.strip()):
        raise ValueError("the placeholder is longer than the width")
    t = one_line(text)
    head = F.regexp_extract(t, rf"^(.{{1,{max(1, width - len(placeholder))}}})(?= )", 1) if width > len(placeholder) else F.lit("")
    return F.when(F.length(t) <= width, t).when(t.isNull(), None).when(head == "", placeholder.strip()).otherwise(F.concat(head, F.lit(placeholder)))


def dedented(text: Column) -> Column:
    """Lines without the blanks and tabs that all lines with other characters begin with; lines of blanks become empty."""
    full = F.regexp_replace(text, r"(?md)^[ \t]+$", "")
    margins = F.transform(F.filter(F.split(full, "\n"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    lo, hi = F.array_min(margins), F.array_max(margins)  # what these two share, all share
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.length(lo)), lambda i: F.left(lo, i) == F.left(hi, i)))
    return F.coalesce(F.regexp_replace(full, F.concat(F.lit(r"(?md)^[ \t]{"), same.cast("string"), F.lit("}")), F.lit("")), full)


def indented(text: Column, prefix: str) -> Column:
    """``prefix`` before every line that has other characters than blanks."""
    return F.regexp_replace(text, r"(?md)^(?=[^\S\n]*\S)", _plain(prefix))
