"""Sequence records, their features and the features' locations.

Bases count from 0 and ends are included, as in the feature model; in location text
they count from 1.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

BETWEEN, PARTIAL_3, PARTIAL_5 = 1, 2, 4
SPAN = StructType([
    StructField("ops", StringType()), StructField("remote", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("flags", IntegerType()),
])
_SPAN = re.compile(r"(?:([^(),:]+):)?(<)?(\d+)(?:(\.\.|\^)(>)?(\d+))?")


def parse_spans(text: str) -> list[tuple[str, str | None, int, int, int]] | None:
    """The spans of a location, each with its operators from outside in; null for text that is no location.

    One pass with a stack of open operators: ``join`` and ``order`` hold lists, ``complement`` one part.
    """
    s = re.sub(r"\s+", "", text)
    out, open_, i, expect = [], [], 0, True
    while i < len(s):
        m = re.match(r"(join|order|complement)\(", s[i:]) if expect else None
        if m:
            open_.append(m[1])
            i += m.end()
        elif expect and (m := _SPAN.match(s, i)):
            a = int(m[3])
            b = int(m[6]) if m[6] else a
            out.append((">".join(open_), m[1], a - 1, b - 1, (PARTIAL_5 if m[2] else 0) | (PARTIAL_3 if m[5] else 0) | (BETWEEN if m[4] == "^" else 0)))
            i, expect = m.end(), False
        elif not expect and s[i] == "," and open_ and "complement" != open_[-1]:
            i, expect = i + 1, True
        elif not expect and s[i] == ")" and open_:
            open_.pop()
            i += 1
        else:
            return None
    return out if out and not open_ and not expect else None


@F.pandas_udf(ArrayType(SPAN))
def _spans(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else parse_spans(t))


def location_spans(location: Column) -> Column:
    """All spans of a location, compound ones too."""
    return _spans(location)


def simple_location(location: Column) -> Column:
    """``is_fwd, start, end, flags, remote`` of a single span or its complement; null for compound locations."""
    s = F.regexp_replace(location, r"\s+", "")
    pattern = r"^(complement\()?(?:([^(),:]+):)?(<)?(\d+)(?:(\.\.|\^)(>)?(\d+))?\)?$"
    g = lambda i: F.regexp_extract(s, pattern, i)
    a = g(4).try_cast("int") - 1
    b = F.coalesce(g(7).try_cast("int") - 1, a)
    flags = F.when(g(3) == "<", PARTIAL_5).otherwise(0) + F.when(g(6) == ">", PARTIAL_3).otherwise(0) + F.when(g(5) == "^", BETWEEN).otherwise(0)
    return F.when(s.rlike(pattern) & (s.startswith("complement(") == s.endswith(")")), F.struct((g(1) == "").alias("is_fwd"), a.alias("start"), b.alias("end"), flags.alias("flags"), F.nullif(g(2), F.lit("")).alias("remote")))


def location_text(start: Column, end: Column, flags: Column, remote: Column, is_fwd: Column) -> Column:
    """The text of a single span."""
    five = F.when(flags.bitwiseAND(PARTIAL_5) > 0, "<").otherwise("")
    three = F.when(flags.bitwiseAND(PARTIAL_3) > 0, ">").otherwise("")
    tail = F.when(start == end, "").when(flags.bitwiseAND(BETWEEN) > 0, F.concat(F.lit("^"), (end + 1).cast("string"))).otherwise(F.concat(F.lit(".."), three, (end + 1).cast("string")))
    body = F.concat(F.coalesce(F.concat(remote, F.lit(":")), F.lit("")), five, (start + 1).cast("string"), tail)
    return F.when(is_fwd, body).otherwise(F.concat(F.lit("complement("), body, F.lit(")")))


def join_text(op: str, parts: Column) -> Column:
    return F.concat(F.lit(f"{op}("), F.array_join(parts, ","), F.lit(")"))


def feature_table(records: DataFrame, key: str, features: str) -> DataFrame:
    """One row per feature: ``key, feature_no, type, is_fwd, start, end, flags, remote, qualifiers, location``; bounds are null for compound locations."""
    f = records.select(F.col(f"`{key}`").alias(key), F.posexplode(F.col(features)).alias("_i", "f")).withColumn("_l", simple_location(F.col("f.location")))
    return f.select(key, (F.col("_i") + 1).alias("feature_no"), "f.type", "_l.is_fwd", "_l.start", "_l.end", "_l.flags", "_l.remote", "f.qualifiers", "f.location")


def shifted(features: DataFrame, offset: int) -> DataFrame:
    """Features of a slice that begins at ``offset``."""
    return features.withColumns({"start": F.col("start") - offset, "end": F.col("end") - offset})


def add_qualifier(qualifiers: Column, name: str, value: Column) -> Column:
    """A further value for a qualifier."""
    old = F.coalesce(F.try_element_at(qualifiers, F.lit(name)), F.array().cast("array<string>"))
    return F.map_concat(F.map_filter(qualifiers, lambda k, v: k != name), F.create_map(F.lit(name), F.concat(old, F.array(value))))


def remove_qualifier(qualifiers: Column, name: str) -> Column:
    return F.map_filter(qualifiers, lambda k, v: k != name)


def slice_records(records: DataFrame, features: DataFrame, key: str, seq: str, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Bases ``start`` up to before ``end`` of every record, and the features that lie in them, in the slice's places."""
    cut = records.withColumn(seq, F.substring(F.col(seq), start + 1, end - start))
    return cut, shifted(features.where((F.col("start") >= start) & (F.col("end") < end)), start)


def concat_records(pairs: DataFrame, features: DataFrame, key: str, left: str, right: str, seqs: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Records joined in pairs (``left``, ``right``: keys), with the right one's features moved behind the left one."""
    l = seqs.select(F.col(key).alias(left), F.col(seq).alias("_l"))
    r = seqs.select(F.col(key).alias(right), F.col(seq).alias("_r"))
    both = pairs.join(l, left).join(r, right)
    joined = both.select(left, right, F.concat("_l", "_r").alias(seq))
    moved = both.select(left, right, F.length("_l").alias("_n"))
    a = moved.join(features.withColumnRenamed(key, left), left).drop("_n")
    b = moved.join(features.withColumnRenamed(key, right), right).withColumns({"start": F.col("start") + F.col("_n"), "end": F.col("end") + F.col("_n")}).drop("_n")
    return joined, a.unionByName(b)


def sequence_hash(seq: Column) -> Column:
    """Equal for records of equal sequence, whatever the case."""
    return F.xxhash64(F.lower(seq))


def feature_types(features: DataFrame) -> DataFrame:
    """``type, type_id``: ids in order of the names.  The distinct names are few; the ids need no grouping of features."""
    names = features.select("type").where("type is not null").distinct()
    return names.withColumn("type_id", F.dense_rank().over(Window.orderBy("type")) - 1)


def collect_features(features: DataFrame, key: str) -> DataFrame:
    """One row per record with its features in order of start and end."""
    return features.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "type", "location"))).alias("features"))


FEATURE = ["start", "end", "type", "location"]


def insert_features(features: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Features of every record with further ones, numbered (``feature_no`` from 1) in order of start, end, type and location.

    Columns that only one side has are null on the other.  A record may have new features only.
    """
    every = features.drop("feature_no").unionByName(new.drop("feature_no"), allowMissingColumns=True)
    return every.withColumn("feature_no", F.row_number().over(Window.partitionBy(key).orderBy(*FEATURE)))


def _numbered(features: DataFrame, key: str) -> DataFrame:
    """Equal features of a record get numbers, so that one of them can be told from the next; nulls become comparable."""
    same = [key, *FEATURE]
    sign = F.to_json(F.struct(*same), {"ignoreNullFields": "false"})
    return features.withColumn("_nf_sign", sign).withColumn("_nf_no", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))))


def remove_features(features: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Features without those of ``gone``: for each row of it one feature with equal key, start, end, type and location."""
    return _numbered(features, key).join(_numbered(gone, key).select("_nf_sign", "_nf_no"), ["_nf_sign", "_nf_no"], "left_anti").drop("_nf_sign", "_nf_no")


def absent_features(features: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``gone`` that ``remove_features`` finds no feature for."""
    return remove_features(gone, features, key)


def features_by_type(features: DataFrame, key: str) -> DataFrame:
    """``key, type, n, places``: the index of each record's features by type, places (start, end) in order."""
    return features.groupBy(key, "type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))
