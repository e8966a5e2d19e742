"""Cliques of compatible sequences and barcode sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.functions import bits
from nucleoframe.functions.metrics import count_of
from nucleoframe.operators.similarity import full_graph

MOST_NODES = 5000


def maximal_cliques(neighbours: dict[object, set[object]]) -> Iterator[list[object]]:
    """All maximal cliques: in each step the candidates beside a pivot with the most neighbours are tried."""
    stack: list[tuple[list[object], set[object], set[object]]] = [([], set(neighbours), set())]
    while stack:
        own, may, done = stack.pop()
        if not may:
            if not done:
                yield sorted(own)
            continue
        pivot = max(sorted(may | done), key=lambda v: len(neighbours[v] & may))
        for v in sorted(may - neighbours[pivot]):
            stack.append(([*own, v], may & neighbours[v], done & neighbours[v]))
            may = may - {v}
            done = done | {v}


def find_cliques(edges: DataFrame, i: str, j: str, need: int = 2, cutoff: int | None = None) -> DataFrame:
    """``clique_no, size, members``: maximal cliques of at least ``need`` nodes, at most ``cutoff`` of them.

    Cliques are a matter of one small graph (their number grows exponentially): more
    than ``MOST_NODES`` nodes are refused.  Order: by size, then by members.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)[i]
    pairs = edges.select(F.col(i).alias("i"), F.col(j).alias("j")).where("i <> j").distinct()
    nodes = pairs.select(F.explode(F.array("i", "j")).alias("n")).distinct().limit(MOST_NODES + 1).count()
    if nodes > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[object, set[object]] = {}
        for a, b in zip(g["i"].tolist(), g["j"].tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found = []
        for c in maximal_cliques(near):
            if len(c) >= need:
                found.append(c)
                if cutoff is not None and len(found) == cutoff:
                    break
        found.sort(key=lambda c: (-len(c), c))
        return pd.DataFrame({"clique_no": range(1, len(found) + 1), "size": [len(c) for c in found], "members": found})

    if not nodes:
        return spark.createDataFrame([], f"clique_no int, size int, members array<{kind}>")
    return pairs.groupBy(F.lit(1).alias("one")).applyInPandas(search, f"clique_no int, size int, members array<{kind}>")


def triangles(edges: DataFrame, i: str, j: str) -> DataFrame:
    """``a, b, c`` (a < b < c): all three linked to each other."""
    e = edges.select(F.least(i, j).alias("a"), F.greatest(i, j).alias("b")).where("a < b").distinct()
    return e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi").select("a", "b", "c")


def barcode_pool(spark: SparkSession, n: int) -> DataFrame:
    """``barcode``: all words of ``n`` bases without four equal ones running and with fewer than ``n - 1`` G or C."""
    if not 1 <= n <= 12:
        raise ValueError("1 <= n <= 12")
    words = spark.range(1 << (2 * n)).select(bits.int_to_seq(F.col("id"), n).alias("barcode"))
    return words.where(~F.col("barcode").rlike("AAAA|CCCC|GGGG|TTTT") & (count_of(F.col("barcode"), "GC") < n - 1))


def cliques_of(seqs: DataFrame, key: str, seq: str, need: int, min_distance: int, cutoff: int | None = None) -> DataFrame:
    """``clique_no, size, members``: maximal sets of at least ``need`` sequences that all differ in ``min_distance`` places or more."""
    far = full_graph(seqs, key, seq, "placed").where(F.col("distance") >= min_distance)
    return find_cliques(far, "i", "j", need, cutoff)


def barcode_set(pool: DataFrame, barcode: str, min_distance: int, size: int, cutoff: int = 1) -> DataFrame:
    """The first set of ``size`` barcodes that differ in at least ``min_distance`` places from each other; an error if there is none."""
    sets = cliques_of(pool, barcode, barcode, size, min_distance, cutoff)
    first = sets.where("clique_no = 1").select(F.explode(F.slice("members", 1, size)).alias(barcode))
    if first.isEmpty():
        raise RuntimeError(f"no {size} barcodes differ in {min_distance} places")
    return first


def drawn(pool: DataFrame, barcode: str, seed: int = 0) -> DataFrame:
    """One barcode of the pool, the same for a seed on every run."""
    return pool.orderBy(F.xxhash64(F.lit(seed), barcode), barcode).limit(1)


def without(pool: DataFrame, barcode: str, used: DataFrame) -> DataFrame:
    """The pool without the used barcodes."""
    return pool.join(used.select(F.col(barcode)), barcode, "left_anti")
