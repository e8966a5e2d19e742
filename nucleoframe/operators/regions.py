"""Genomic regions: variants left out, permitted stretches and their sequences, range and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.functions.seq import reverse_complement
from nucleoframe.operators.islands import periods_and_gaps


def ordered_bounds(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with their bounds in order; a null bound makes both null."""
    a, b = F.col(f"`{start}`"), F.col(f"`{end}`")
    both = a.isNotNull() & b.isNotNull()
    return df.withColumns({start: F.when(both, F.least(a, b)), end: F.when(both, F.greatest(a, b))})


def _clipped(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Regions with the variants of the same key."""
    r = ordered_bounds(regions, start, end).select(key, F.col(f"`{start}`").alias("r_lo"), F.col(f"`{end}`").alias("r_hi"))
    v = ordered_bounds(variants, start, end).select(key, F.col(f"`{start}`").alias("v_lo"), F.col(f"`{end}`").alias("v_hi"))
    return r.join(v, key, "left").where("r_lo is not null")


def _runs(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, r_lo, r_hi, lo, hi``: the permitted runs of each region."""
    rows = _clipped(regions, variants, key, start, end)
    inside = (F.col("v_lo") <= F.col("r_hi")) & (F.col("v_hi") >= F.col("r_lo"))
    # each region ends with a mark behind its last position
    marks = rows.select(key, "r_lo", "r_hi").distinct().withColumn("v_lo", F.col("r_hi") + 1).withColumn("v_hi", F.col("r_hi") + 1)
    every = rows.where(inside).select(key, "r_lo", "r_hi", "v_lo", "v_hi").unionByName(marks)
    w = Window.partitionBy(key, "r_lo", "r_hi").orderBy("v_lo", "v_hi")
    upto = F.coalesce(F.max("v_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("r_lo"))
    return every.select(key, "r_lo", "r_hi", F.greatest(upto, F.col("r_lo")).alias("lo"), F.col("v_lo").alias("hi")).where("lo < hi").distinct()


def permitted_regions(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, lo, hi``: the half-open runs of each region's positions that no variant of the same key covers.

    Bounds include both ends.  Variants are sorted within a region and compared with
    the furthest end so far, so positions are never expanded.
    """
    return _runs(regions, variants, key, start, end).select(key, "lo", "hi").distinct()


def variant_gaps(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, lo, hi``: half-open gaps between a region's begin, its variants in order, and its end."""
    return permitted_regions(regions, variants, key, start, end)


def variant_positions(variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, position`` of all positions that variants cover."""
    v = ordered_bounds(variants, start, end)
    return v.where(F.col(f"`{start}`").isNotNull()).select(key, F.explode(F.sequence(F.col(f"`{start}`"), F.col(f"`{end}`"))).alias("position")).distinct()


def position_difference(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, lo, hi``: the set of positions of all regions of a key less those of its variants, as maximal half-open runs.

    Like ``permitted_regions`` over the union of a key's regions; positions are never listed.
    """
    union = periods_and_gaps(regions, [key], start, end).where("kind = 'period'")
    return permitted_regions(union.select(key, F.col("start_pos").alias(start), F.col("end_pos").alias(end)), variants, key, start, end)


def sliced_sequence(seq: Column, offset: Column, lo: Column, hi: Column, is_reverse: Column) -> Column:
    """The part of a region's sequence for genomic positions ``lo`` up to before ``hi``; a reverse region's sequence runs from its high end down."""
    n = F.length(seq)
    first = F.when(is_reverse, n - (hi - offset)).otherwise(lo - offset)
    return F.substr(seq, (first + 1).cast("int"), (hi - lo).cast("int"))


def permitted_sequences(regions: DataFrame, variants: DataFrame, key: str, start: str, end: str, seq: str, strand: str) -> DataFrame:
    """``key, lo, hi, seq``: permitted runs with their part of the region's sequence, for every region of a key.

    The sequences are joined by sorting: Spark takes each for 20 bytes as long as it
    hasn't measured them, and would send all of them through the driver to every task.
    """
    runs = _runs(regions, variants, key, start, end)
    own = ordered_bounds(regions, start, end).select(key, F.col(f"`{start}`").alias("r_lo"), F.col(f"`{end}`").alias("r_hi"), F.col(f"`{seq}`").alias("_nf_seq"), (F.col(f"`{strand}`") < 0).alias("_nf_rev"))
    return runs.join(own.hint("merge"), [key, "r_lo", "r_hi"]).select(key, "lo", "hi", sliced_sequence(F.col("_nf_seq"), F.col("r_lo"), F.col("lo"), F.col("hi"), F.col("_nf_rev")).alias("seq")).distinct()


def features_in_range(features: DataFrame, start: str, end: str, lo: int, hi: int) -> DataFrame:
    """Features that lie between two places in the order of (start, end): ``(lo, lo) <= (start, end) <= (hi, hi)``."""
    s, e = F.col(f"`{start}`"), F.col(f"`{end}`")
    return features.where(s.between(lo, hi) & ((s > lo) | (e >= lo)) & ((s < hi) | (e <= hi)))


def range_join(queries: DataFrame, features: DataFrame, key: str, query: tuple[str, str, str], feature: tuple[str, str], width: int = 1 << 14) -> DataFrame:
    """Features that overlap a query's range on the same ``key``: columns of both.

    ``query`` names id, start and end.  Both sides are laid in bins of ``width``; a pair
    counts in the bin where the later of the two begins, so it comes out once without
    a distinct.  Bounds in the wrong order are swapped; a row that lacks one overlaps nothing.
    """
    qid, qs, qe = query
    fs, fe = feature
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    q = ordered_bounds(queries, qs, qe).where(F.col(qs).isNotNull()).select(key, F.col(qid).alias("query_id"), F.col(qs).alias("query_start"), F.col(qe).alias("query_end"), bins(qs, qe).alias("_nf_bin"))
    f = ordered_bounds(features, fs, fe).where(F.col(fs).isNotNull()).withColumn("_nf_bin", bins(fs, fe))
    hit = (F.col(fs) <= F.col("query_end")) & (F.col(fe) >= F.col("query_start")) & (F.col("_nf_bin") == F.floor(F.greatest(F.col(fs), F.col("query_start")) / width))
    return q.join(f, [key, "_nf_bin"]).where(hit).drop("_nf_bin")


def contained(queries: DataFrame, refs: DataFrame, key: str, query: str, strand: str, ref: str, ref_strand: str) -> DataFrame:
    """Queries with ``found`` and ``place``: the query, turned to the reference's strand, as part of the reference of the same key."""
    turned = F.when(F.col(strand) == F.col(ref_strand), F.col(query)).otherwise(reverse_complement(F.col(query)))
    return queries.join(refs, key, "left").withColumn("oriented", turned).withColumn("place", F.instr(F.col(ref), F.col("oriented")) - 1).withColumn("found", F.coalesce(F.col("place") >= 0, F.lit(False)))
