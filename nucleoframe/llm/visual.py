"""Visually identical text with different characters (problem 8).

Compatibility forms, composition, blanks and invisible characters are brought to
one form, and letters of other scripts with the same shape to the Latin letter.
Compatibility mapping is limited to the forms that look the same (full- and
half-width, ligatures, blanks): superscripts, fractions and circled digits do not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nucleoframe.common import cut_lineage

# Letters of other scripts that have the shape of a Latin letter.
CYRILLIC_SHAPES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK_SHAPES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
}
# The default-ignorable code points (Unicode derived property), as ranges.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Texts of these characters only are their own form: printable ASCII, line feeds, composed Latin letters, common punctuation.
PLAIN = "\\n\\x20-\\x7E\\u00A1-\\u00AC\\u00AE-\\u0131\\u0134-\\u017E\\u2010\\u2012-\\u2015\\u2018-\\u201F"


def _table() -> dict[int, str | None]:
    """What each decomposed character becomes; from the Unicode data of Python."""
    out: dict[int, str | None] = {}
    for code in range(0x80, 0x30000):
        ch = chr(code)
        kind = unicodedata.decomposition(ch).partition(">")[0]
        if kind in ("<wide", "<narrow") or (kind == "<compat" and "LIGATURE" in unicodedata.name(ch, "")):
            out[code] = unicodedata.normalize("NFKD", ch)
        elif unicodedata.category(ch) == "Zs":
            out[code] = " "
    out[0x09] = " "
    for lo, hi in IGNORABLE:
        out.update(dict.fromkeys(range(lo, hi + 1)))
    shapes = {**CYRILLIC_SHAPES, **GREEK_SHAPES}
    out.update({ord(a): b for a, b in shapes.items()})
    return out


_TABLE: dict[int, str | None] = {}
_ODD = re.compile("[^" + re.sub(r"\\u([0-9A-F]{4})|\\x([0-9A-F]{2})", lambda m: re.escape(chr(int(m[1] or m[2], 16))), PLAIN.replace("\\n", "\n")) + "]")


def canonical(text: str) -> str:
    """The one form of all texts that look like ``text``; case, accents, digits and the number of blanks stay."""
    if not _ODD.search(text):
        return text
    if not _TABLE:
        _TABLE.update(_table())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


def _mapped(s: pd.Series, form: Callable[[str], str]) -> pd.Series:
    forms = {t: form(t) for t in s.dropna().unique()}
    return s.map(forms, na_action="ignore").astype(object).where(s.notna(), None)


@F.pandas_udf(StringType())
def _canonical_of_odd(s: pd.Series) -> pd.Series:
    return _mapped(s, canonical)


@F.pandas_udf(StringType())
def _folded_of_odd(s: pd.Series) -> pd.Series:
    return _mapped(s, lambda t: unicodedata.normalize("NFC", canonical(t).casefold()))


def canonical_text(text: Column, fold_case: bool = False) -> Column:
    """The form of a text column; null stays null.

    Texts of plain characters pass by in the JVM; only the others go to Python, each
    distinct value of a batch once.  ``fold_case`` adds full case folding.
    """
    if fold_case:
        return F.coalesce(_folded_of_odd(F.when(text.rlike(r"[^\n\x20-\x7E]"), text)), F.lower(text))
    odd = ((F.octet_length(text) != F.length(text)) | F.contains(text, F.lit("\t"))) & text.rlike(f"[^{PLAIN}]")  # no pattern for plain ASCII
    return F.coalesce(_canonical_of_odd(F.when(odd, text)), text)


def _hashed(df: DataFrame, key: str, text: str, fold_case: bool = False) -> DataFrame:
    """``key, class_a, class_b, raw``; classes are null for texts of none."""
    form = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("raw"), canonical_text(F.col(f"`{text}`"), fold_case).alias("_nf_form")
    )
    seen = F.col("_nf_form").rlike(r"[^\s]")
    return form.select(key, F.when(seen, F.xxhash64("_nf_form")).alias("class_a"), F.when(seen, F.xxhash64(F.lit("second"), F.col("_nf_form"))).alias("class_b"), "raw")


def visual_classes(df: DataFrame, key: str, text: str, fold_case: bool = False) -> DataFrame:
    """``key``, the class of texts that look the same (``class_a, class_b``: 128 bits) and ``raw``, the text's own hash.

    Null texts, and texts without a visible character, belong to no class and are
    left out, as are rows without key; repeated rows stay repeated.
    """
    return _hashed(df, key, text, fold_case).where("class_a is not null")


def visual_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows whose texts differ as strings but look the same: ``<key>_a < <key>_b``.

    Texts leave the scan as three hashes; classes of one spelling are dropped by an
    aggregate before anything is joined, so rows that are only exact copies of each
    other meet no join.  Spellings, not rows, are paired within a class, and the rows of
    each spelling put in last, so no candidate is made that isn't a pair of the result;
    ``visual_members`` gives the same links without their pairs.  An empty table gives no pairs.
    """
    kept = cut_lineage(_of_mixed(_rows(df, key, text)).select(F.col(key).alias("row"), "class_a", "class_b", "raw").distinct())
    one = kept.select("class_a", "class_b", "raw").distinct()
    a, b = (one.withColumnRenamed("raw", f"raw_{s}") for s in "ab")
    spellings = a.join(b, ["class_a", "class_b"]).where("raw_a < raw_b")
    for s in "ab":
        spellings = spellings.join(kept.select("class_a", "class_b", F.col("raw").alias(f"raw_{s}"), F.col("row").alias(f"row_{s}")), ["class_a", "class_b", f"raw_{s}"])
    both = spellings.where("row_a <> row_b").select(F.least("row_a", "row_b").alias(f"{key}_a"), F.greatest("row_a", "row_b").alias(f"{key}_b"))
    return both.distinct()


def visual_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of classes with more than one spelling: ``key, look, spelling, n_spellings``, linear in the rows.

    ``look`` is the smallest key of all texts that look the same, ``spelling`` the
    smallest of those equal as strings; two rows are linked if they have one look and
    two spellings.  Null texts, texts without a visible character and null keys are left
    out, repeated rows count once; an empty table gives none.
    """
    kept = cut_lineage(_of_mixed(_rows(df, key, text)).select(F.col(key).alias("row"), "class_a", "class_b", "raw").distinct())
    spelled = kept.groupBy("class_a", "class_b", "raw").agg(F.min("row").alias("spelling"))
    looks = spelled.groupBy("class_a", "class_b").agg(F.min("spelling").alias("look"), F.count("*").alias("n_spellings"))
    own = kept.join(spelled, ["class_a", "class_b", "raw"]).join(looks, ["class_a", "class_b"])
    return own.select(F.col("row").alias(key), "look", "spelling", "n_spellings")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    # texts of no class are left out behind the cut: a filter before it would be pushed down and find each form twice
    return cut_lineage(_hashed(df, key, text)).where("class_a is not null")


def _of_mixed(rows: DataFrame) -> DataFrame:
    """Rows of classes with more than one spelling."""
    mixed = rows.groupBy("class_a", "class_b").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("class_a", "class_b")
    return rows.join(mixed, ["class_a", "class_b"], "left_semi")
