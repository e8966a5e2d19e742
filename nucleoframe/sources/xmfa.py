"""XMFA alignments: groups that end in a line with ``=`` and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = r"^\s*(\d+):(\d+)-(\d+)\s*([+-])[ \t]*([^\n]*)"


def parse_xmfa(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, group_no, group_notes, seq_num, start_idx, end_idx, strand, notes, seq``: one row per aligned sequence."""
    plain = F.regexp_replace(F.col(f"`{text}`"), r"\r", "")
    groups = df.select(F.col(f"`{key}`").alias(key), F.posexplode(F.split(F.concat(F.lit("\n"), plain), r"\n(?==)")).alias("_i", "_g"))
    # the notes of a group stand at the begin of what follows it
    parts = groups.select(key, "_i", F.regexp_extract("_g", r"^=([^\n]*)", 1).alias("_n"), F.regexp_replace("_g", r"^=[^\n]*", "").alias("_b"))
    notes = parts.where("_i > 0").select(key, F.col("_i").alias("group_no"), F.trim("_n").alias("group_notes"))
    body = parts.select(key, (F.col("_i") + 1).alias("group_no"), F.explode(F.slice(F.split("_b", r"\n>"), 2, 1 << 30)).alias("_a"))
    got = lambda i: F.regexp_extract("_a", _HEAD, i)
    rows = body.select(
        key, "group_no", got(1).try_cast("int").alias("seq_num"), got(2).try_cast("int").alias("start_idx"), got(3).try_cast("int").alias("end_idx"),
        got(4).alias("strand"), F.trim(got(5)).alias("notes"), F.regexp_replace(F.regexp_replace("_a", _HEAD, ""), r"\s+", "").alias("seq"),
    )
    return rows.join(notes, [key, "group_no"])


def read_xmfa(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parse_xmfa(files, "file", "value")
