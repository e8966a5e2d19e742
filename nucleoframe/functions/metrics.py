"""Composition, runs, sliding windows and distances of sequence strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, BooleanType

WINDOW_TYPE = StructType([StructField("passed", BooleanType()), StructField("start", IntegerType()), StructField("gc", IntegerType())])


def count_of(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: Column) -> Column:
    """Share of upper-case G and C; null for an empty sequence."""
    return count_of(seq, "GC") / F.nullif(F.length(seq), F.lit(0))


def _longest(seq: Column, letters: str) -> Column:
    runs = F.transform(F.regexp_extract_all(seq, F.lit(f"([{letters}]+)"), F.lit(1)), lambda x: F.length(x))
    return F.when(seq.isNotNull(), F.coalesce(F.array_max(runs), F.lit(0)))


def max_runs(seq: Column) -> Column:
    """Longest runs of A, C, G, T, A or T, G or C; other characters don't break a run."""
    own = F.regexp_replace(seq, "[^ACGT]", "")
    return F.when(seq.isNotNull(), F.array(*[_longest(own, x) for x in ("A", "C", "G", "T", "AT", "GC")]))


def runs_within(seq: Column, a: int, t: int, g: int, c: int, at: int, gc: int) -> Column:
    """Whether no run is longer than its limit."""
    own = F.regexp_replace(seq, "[^ACGT]", "")
    return ~own.rlike("|".join(f"[{x}]{{{n + 1}}}" for x, n in (("A", a), ("T", t), ("G", g), ("C", c), ("AT", at), ("GC", gc))))


def gc_between(seq: Column, low: float, high: float) -> Column:
    return gc_content(seq).between(low, high)


def run_at_most(seq: Column, letters: str, limit: int) -> Column:
    """Whether runs of the given letters stay within the limit; any other character breaks a run."""
    return ~seq.rlike(f"[{letters}]{{{limit + 1}}}")


def homopolymer_at_most(seq: Column, limit: int) -> Column:
    return ~seq.rlike(rf"(?s)(.)\1{{{limit}}}")


def max_run_within(seq: Column, limits: dict[str, int], one_more: bool = False) -> Column:
    """Optional limits by letters (0 is off); ``one_more`` allows runs one longer than the limit."""
    bad = [f"[{x}]{{{n + 1 + one_more}}}" for x, n in limits.items() if n]
    return ~seq.rlike("|".join(bad)) if bad else F.lit(True)


def gc_window(seq: Column, low: int, high: int, window: int, of_window: bool = False) -> Column:
    """The first window whose number of G and C is out of bounds, else the last: ``passed, start, gc``.

    Bounds are percent of the sequence's length, or of the window's with ``of_window``.
    Counted in one pass over each sequence; null where the window is longer than the sequence.
    """
    if window < 1 or not 0 <= low <= high <= 100:
        raise ValueError("bounds must be percent, and the window at least 1")

    @F.pandas_udf(WINDOW_TYPE)
    def scan(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            if t is None or len(t) < window:
                out.append((None, None, None))
                continue
            x = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
            total = np.concatenate(([0], np.cumsum((x == 71) | (x == 67) | (x == 103) | (x == 99))))
            n = total[window:] - total[:-window]
            base = window if of_window else len(t)
            bad = np.flatnonzero((n < low * base // 100) | (n > high * base // 100))
            at = int(bad[0]) if len(bad) else len(n) - 1
            out.append((not len(bad), at, int(n[at])))
        return pd.DataFrame(out, columns=["passed", "start", "gc"]).astype({"passed": "boolean", "start": "Int32", "gc": "Int32"})

    return scan(seq)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two sequences differ; null for unequal lengths."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(places, F.lit(0), lambda s, x: s + x))


def hamming_packed(a: Column, b: Column) -> Column:
    """Places at which two packed sequences of one length differ."""
    x = a.bitwiseXOR(b)
    odd = F.lit(0x555555555555555).cast("bigint")
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(odd)).cast("int")


def rolling_hamming(short: Column, long: Column, overlap: int = 0) -> Column:
    """Distance at each placement of ``short`` along ``long``; ``overlap`` adds placements that hang over by so many places at most."""
    n1, n2 = F.length(short), F.length(long)
    places = F.sequence(F.lit(-overlap), n2 - n1 + overlap)

    def at(o: Column) -> Column:
        skip = F.greatest(-o, F.lit(0))
        width = F.least(n1 - skip, n2 - F.greatest(o, F.lit(0)))
        return hamming(F.substr(short, skip + 1, width), F.substr(long, F.greatest(o, F.lit(0)) + 1, width))

    return F.when(n2 >= n1, F.transform(places, at)).when(n2 < n1, F.array().cast("array<int>"))


def min_hamming(short: Column, long: Column) -> Column:
    """The smallest distance of any placement; 100000 where the second is shorter."""
    return F.coalesce(F.array_min(rolling_hamming(short, long)), F.when(F.length(long) < F.length(short), F.lit(100000)))


def hamming_both_ways(a: Column, b: Column, least: int) -> Column:
    """Whether the distances to the other and to its reversal are both above ``least``."""
    return (hamming(a, b) > least) & (hamming(a, F.reverse(b)) > least)


def hamming_and_3p(a: Column, b: Column, least: int) -> Column:
    """As above, and with a mismatch among the three bases of the 3' end in each orientation."""
    ra, rb = F.reverse(a), F.reverse(b)
    return hamming_both_ways(a, b, least) & (F.right(a, F.lit(3)) != F.right(b, F.lit(3))) & (F.right(a, F.lit(3)) != F.right(rb, F.lit(3))) & (F.right(ra, F.lit(3)) != F.right(b, F.lit(3)))


def right_arm_clamp(arm: Column) -> Column:
    """G and C among the last five bases."""
    return count_of(F.right(arm, F.lit(5)), "GC")


def left_arm_clamp(arm: Column) -> Column:
    return count_of(F.left(arm, F.lit(5)), "GC")


def rolling_gc(seq: Column, width: int) -> Column:
    """The number of G and C in every window of ``width`` letters, in order."""
    every = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))
    return F.transform(every, lambda w: count_of(w, "GC"))
