"""FASTA: reading, checking, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.functions.seq import ALPHABETS, checked, hard_wrap, is_alphabet


def parse_entries(df: DataFrame, entry: str, mode: str = "permissive", alphabet: str | None = None, not_allowed: str = "") -> DataFrame:
    """``id, description, seq`` (and ``bad`` in permissive mode) of texts that hold one entry each, without the ``>``.

    The first word of the header is the id, the whole header the description; blanks
    and line ends in the sequence are dropped, the last line counts with or without a
    line end.  Letters outside the alphabet mark the row (permissive), drop it
    (``drop``) or are an error (``fail``).
    """
    e = F.col(f"`{entry}`")
    head = F.regexp_extract(e, r"^([^\r\n]*)", 1)
    rows = df.where(F.trim(e) != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(head).alias("description"), F.regexp_replace(F.regexp_replace(e, r"^[^\r\n]*", ""), r"\s+", "").alias("seq"))
    if alphabet is None:
        return rows
    letters = ALPHABETS.get(alphabet, alphabet)
    if mode == "fail":
        return rows.withColumn("seq", checked(F.col("seq"), letters, not_allowed))
    good = is_alphabet(F.col("seq"), letters, not_allowed)
    return rows.where(good) if mode == "drop" else rows.withColumn("bad", ~good)


def entries_of(text: Column) -> Column:
    """The entries of a whole FASTA text."""
    return F.slice(F.split(F.concat(F.lit("\n"), text), "\n>"), 2, 1 << 30)


def read_fasta(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Entries of FASTA files; files are split at ``>``, so a large one is read by many tasks."""
    return parse_entries(spark.read.text(path, lineSep=">"), "value", **options)


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    """One entry with the sequence in lines of ``width``."""
    return F.concat(F.lit(">"), name, F.lit("\n"), hard_wrap(seq, width))


def write_fasta(df: DataFrame, name: str, seq: str, path: str, width: int = 60) -> None:
    df.select(fasta_text(F.col(name), F.col(seq), width).alias("value")).write.text(path)
