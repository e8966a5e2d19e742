"""Double-stranded DNA: ends, ligation, circles.

A duplex is a struct ``fwd, rev, overhang, is_circular``: both strands from 5' to 3';
``overhang`` is the place of the forward strand's begin less that of the reverse
strand's end (positive: the reverse strand is longer on the left).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from nucleoframe.functions.metrics import rolling_hamming
from nucleoframe.functions.seq import reverse_complement


def duplex(fwd: Column, rev: Column | None = None, overhang: Column | int = 0, circular: bool = False) -> Column:
    rev = reverse_complement(fwd) if rev is None else rev
    o = F.lit(overhang) if isinstance(overhang, int) else overhang
    return F.struct(fwd.alias("fwd"), rev.alias("rev"), o.cast("int").alias("overhang"), F.lit(circular).alias("is_circular"))


def aligned_overhang(fwd: Column, rev: Column) -> Column:
    """The overhang at which the strands agree best without gaps: the first placement of the shorter with the fewest mismatches."""
    other = reverse_complement(rev)
    long = F.length(fwd) >= F.length(other)
    in_fwd, in_rev = rolling_hamming(other, fwd), rolling_hamming(fwd, other)
    return F.when(long, -(F.array_position(in_fwd, F.array_min(in_fwd)) - 1)).otherwise(F.array_position(in_rev, F.array_min(in_rev)) - 1).cast("int")


def local_alignments(a: list[str], b: list[str], match: int = 2, mismatch: int = -2, gap_open: int = 3, gap_extend: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best score of a local alignment of each pair, and where it begins: place in ``b`` less place in ``a``.

    Affine gaps (the first letter of a gap costs ``gap_open``, each further one
    ``gap_extend``); the cells of all pairs are filled together, so the work is the
    product of the greatest lengths.  Of equal scores the cell that is first in ``a``, then
    in ``b``, wins; in a cell a letter pair goes before a gap in ``b``, this before one in
    ``a``.  Without any equal letter both are 0.
    """
    def coded(texts: list[str], pad: int) -> np.ndarray:
        out = np.full((max(map(len, texts), default=0), len(texts)), pad, np.int32)
        for i, t in enumerate(texts):
            out[: len(t), i] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return out

    x, y = coded(a, -1), coded(b, -2)
    n, low = len(a), -(1 << 20)
    zero = lambda v=0: np.full((len(y) + 1, n), v, np.int32)
    high, high_at, up, up_at = zero(), zero(), zero(low), zero()
    best, best_at = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i, letter in enumerate(x):
        new, new_at = zero(), zero()
        side, side_at = np.full(n, low, np.int32), np.zeros(n, np.int32)
        for j, other in enumerate(y):
            deeper = up[j + 1] - gap_extend > high[j + 1] - gap_open
            up_at[j + 1] = np.where(deeper, up_at[j + 1], high_at[j + 1])
            up[j + 1] = np.where(deeper, up[j + 1] - gap_extend, high[j + 1] - gap_open)
            wider = side - gap_extend > new[j] - gap_open
            side_at = np.where(wider, side_at, new_at[j])
            side = np.where(wider, side - gap_extend, new[j] - gap_open)
            score, at = high[j] + np.where(letter == other, match, mismatch), np.where(high[j] > 0, high_at[j], j - i)
            for gap, gap_at in ((up[j + 1], up_at[j + 1]), (side, side_at)):
                better = gap > score
                score, at = np.where(better, gap, score), np.where(better, gap_at, at)
            new[j + 1], new_at[j + 1] = np.maximum(score, 0), at
            better = new[j + 1] > best
            best, best_at = np.where(better, new[j + 1], best), np.where(better, at, best_at)
        high, high_at = new, new_at
    return best, best_at


@F.pandas_udf(StructType([StructField("score", IntegerType()), StructField("overhang", IntegerType())]))
def _aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    score, at = np.zeros(len(a), object), np.zeros(len(a), object)
    whole = (a.notna() & b.notna()).to_numpy()
    size = a.str.len().fillna(0).to_numpy() * b.str.len().fillna(0).to_numpy()
    order = np.flatnonzero(whole)[np.argsort(size[whole], kind="stable")]
    for part in np.array_split(order, max(1, len(order) // 500)):  # pairs of like size together
        score[part], at[part] = local_alignments(a.iloc[part].tolist(), b.iloc[part].tolist())
    score[~whole] = at[~whole] = None
    return pd.DataFrame({"score": score, "overhang": at})


def gapped_overhang(fwd: Column, rev: Column) -> Column:
    """``score, overhang`` of the best local alignment with gaps of the forward strand and the reverse complement of the other; null for a null strand."""
    return _aligned(fwd, reverse_complement(rev))


def right_overhang(d: Column) -> Column:
    """How far the forward strand reaches beyond the reverse one on the right (negative: falls short)."""
    return F.length(d["fwd"]) + d["overhang"] - F.length(d["rev"])


def total_length(d: Column) -> Column:
    """Places from the first to the last base of either strand."""
    return F.greatest(F.length(d["fwd"]) + d["overhang"], F.length(d["rev"])) + F.greatest(-d["overhang"], F.lit(0))


def _end(kind_of: Column, five: Column, three: Column) -> Column:
    return F.struct(
        F.when(kind_of == 0, "BLUNT").when(kind_of > 0, "THREE").otherwise("FIVE").alias("type"), F.when(kind_of == 0, "").when(kind_of > 0, three).otherwise(five).alias("seq")
    )


def left_end(d: Column) -> Column:
    """``type`` (FIVE, THREE, BLUNT) and ``seq`` of the overhang at the forward strand's 5' end."""
    o = d["overhang"]
    return _end(o, F.left(d["fwd"], -o), F.right(d["rev"], o))


def right_end(d: Column) -> Column:
    """The same at the forward strand's 3' end."""
    o = right_overhang(d)
    return _end(o, F.left(d["rev"], -o), F.right(d["fwd"], o))


def fits(a: Column, b: Column) -> Column:
    """Whether the right end of ``a`` can be joined to the left end of ``b``."""
    x, y = right_end(a), left_end(b)
    return ~a["is_circular"] & ~b["is_circular"] & (x["type"] == y["type"]) & (x["seq"] == reverse_complement(y["seq"]))


def ligate(a: Column, b: Column) -> Column:
    """``a`` followed by ``b``; null where the ends don't fit."""
    return F.when(fits(a, b), duplex(F.concat(a["fwd"], b["fwd"]), F.concat(b["rev"], a["rev"]), a["overhang"]))


def repeated(d: Column, n: int) -> Column:
    """``n`` copies ligated; null where the ends don't fit."""
    if n < 2:
        raise ValueError("at least two copies")
    return F.when(fits(d, d), duplex(F.repeat(d["fwd"], n), F.repeat(d["rev"], n), d["overhang"]))


def can_circularize(d: Column) -> Column:
    return fits(d, d)


def circularize(d: Column) -> Column:
    """The closed circle with the reverse strand turned so that both begin together; null where the ends don't fit."""
    n, o = F.length(d["rev"]), d["overhang"]
    turn = F.pmod(-o, n)
    rev = F.concat(F.right(d["rev"], n - turn), F.left(d["rev"], turn))
    return F.when(can_circularize(d), duplex(d["fwd"], rev, 0, True))


def linearize(d: Column) -> Column:
    """The circle opened where it begins."""
    return duplex(d["fwd"], d["rev"], d["overhang"])


def sliced(d: Column, start: int, end: int) -> Column:
    """Places ``start`` up to before ``end`` of the aligned pair (0 is the first base of either strand)."""
    lead_f, lead_r = F.greatest(d["overhang"], F.lit(0)), F.greatest(-d["overhang"], F.lit(0))

    def part(s: Column, lead: Column) -> tuple[Column, Column]:
        a = F.greatest(F.lit(start) - lead, F.lit(0))
        b = F.least(F.greatest(F.lit(end) - lead, F.lit(0)), F.length(s))
        return F.substr(s, a + 1, F.greatest(b - a, F.lit(0))), F.greatest(lead - start, F.lit(0))

    f, at_f = part(d["fwd"], lead_f)
    r, at_r = part(F.reverse(d["rev"]), lead_r)
    return duplex(f, F.reverse(r), at_f - at_r)


def reverse_index(d: Column, i: Column) -> Column:
    """The reverse strand's index (from its 5' end) opposite to the forward index ``i``; null where there is none."""
    j = F.length(d["rev"]) - 1 - (i + d["overhang"])
    return F.when(j.between(0, F.length(d["rev"]) - 1), j)


def forward_index(d: Column, j: Column) -> Column:
    """The forward strand's index opposite to the reverse index ``j``; null where there is none."""
    i = F.length(d["rev"]) - 1 - j - d["overhang"]
    return F.when(i.between(0, F.length(d["fwd"]) - 1), i)
