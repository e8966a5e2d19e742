"""Spaced seeds: masks of mismatches, what a seed finds, and the search for seeds.

All of this happens when a plan is made and is about words of at most 20 letters.
``#`` must agree, ``-`` may differ; a mask has 1 for agreement and 0 for a mismatch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 20


def masks(spark: SparkSession, m: int, k: int) -> DataFrame:
    """``mask, bits``: all words of ``m`` places with ``k`` mismatches (0)."""
    if not 0 <= k <= m <= MOST:
        raise ValueError("0 <= k <= m <= 20")
    rows = spark.range(1 << m).where(F.bit_count("id") == m - k)
    return rows.select(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), m, "0").alias("mask") if m else F.lit("").alias("mask"), F.col("id").alias("bits"))


def seeds(spark: SparkSession, n: int, weight: int) -> DataFrame:
    """``seed``: all seeds of ``n`` places and so many ``#``."""
    return masks(spark, n, n - weight).select(F.translate("mask", "10", "#-").alias("seed"))


def seed_bits(seed: str, m: int) -> list[int]:
    """The seed at every shift within ``m`` places, as bits."""
    core = seed.rstrip("-")
    width = len(core)
    value = int("0" + core.replace("#", "1").replace("-", "0"), 2)
    return [value << (m - width - s) for s in range(m - width + 1)]


def shift_hits(mask_bits: int, seed: str, m: int) -> list[int]:
    """For each shift, 1 if the seed looks at a mismatch."""
    return [int(mask_bits & b != b) for b in seed_bits(seed, m)]


def failing_masks(spark: SparkSession, family: list[str], m: int, k: int) -> DataFrame:
    """``mask``: the mismatch patterns that no seed of the family passes at any shift."""
    clean = F.lit(False)
    for b in {b for s in family for b in seed_bits(s, m)}:
        clean = clean | (F.col("bits").bitwiseAND(F.lit(b)) == b)
    return masks(spark, m, k).where(~clean).select("mask")


def _fails(family: list[str], m: int, k: int) -> Iterator[int]:
    bits = {b for s in family for b in seed_bits(s, m)}
    everything = (1 << m) - 1
    for off in combinations(range(m), k):
        mask = everything
        for i in off:
            mask &= ~(1 << i)
        if all(mask & b != b for b in bits):
            yield mask


def check_seeds(family: list[str], m: int, k_min: int = 1, k_max: int = 3) -> int:
    """The most mismatches with which the family finds every word of ``m`` places, up to ``k_max``; -1 below ``k_min``."""
    best = -1
    for k in range(k_min, k_max + 1):
        if next(_fails(family, m, k), None) is not None:
            break
        best = k
    return best


def check_seed(seed: str, m: int, k_min: int = 1, k_max: int = 3) -> int:
    return check_seeds([seed], m, k_min, k_max)


def check_seed_at(seed: str, m: int, k: int, limit: int | None = None) -> tuple[bool, list[int] | None]:
    """Whether a seed finds all words with ``k`` mismatches, else the patterns it misses (none if there are more than ``limit``)."""
    missed: list[int] = []
    for mask in _fails([seed], m, k):
        missed.append(mask)
        if limit is not None and len(missed) > limit:
            return False, None
    return not missed, missed


def _candidates(m: int, weight: int) -> Iterator[str]:
    for n in range(weight, m + 1):
        for on in combinations(range(1, n - 1), weight - 2) if weight > 1 else [()]:
            if weight == 1 and n > 1:
                return
            places = {0, n - 1, *on}
            yield "".join("#" if i in places else "-" for i in range(n))


def find_seeds(m: int, k: int, min_weight: int = 2) -> dict[int, str]:
    """By weight, the first seed that finds all words of ``m`` places with ``k`` mismatches but not all with more."""
    out = {}
    for weight in range(m - k, min_weight - 1, -1):
        for seed in _candidates(m, weight):
            if check_seed(seed, m, 1, k + 1) == k:
                out[weight] = seed
                break
    return out


def find_seed_pairs(m: int, k: int, weight: int, limit: int = 200) -> list[tuple[str, ...]]:
    """Single seeds of a weight that find everything, and pairs whose missed patterns have none in common."""
    partial: list[tuple[str, set[int]]] = []
    out: list[tuple[str, ...]] = []
    for seed in _candidates(m, weight):
        passed, missed = check_seed_at(seed, m, k, limit)
        if passed:
            out.append((seed,))
        elif missed is not None:
            own = set(missed)
            out += [(other, seed) for other, theirs in partial if not own & theirs]
            partial.append((seed, own))
    return out
