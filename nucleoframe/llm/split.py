"""Splitting oversized items at natural boundaries (problem 2).

``bisect_oversized`` is recursive bisection: it cuts at the strongest boundary near the
midpoint and goes on with both halves.  The pieces that ``p2_found`` requires are
defined from left to right (each ends at the last natural cut within the limit, and
the next start depends on that end), which cuts chosen near a midpoint can't
reproduce, so ``split_oversized`` places those in one pass from the left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.common import latest_rows

PIECES = "piece_no int, start_pos int, end_pos int"


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Disjoint runs of positions after which no cut is natural, from spans ``(first, last)``."""
    lo: list[int] = []
    hi: list[int] = []
    for a, b in sorted((a, b - 1) for a, b in spans if b > a):
        if lo and a <= hi[-1] + 1:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    return lo, hi


def pieces(length: int, spans: list[tuple[int, int]], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First and last position of each piece, 1-based, ends included."""
    lo, hi = merged(spans)
    start = 1
    while length - start + 1 > limit:
        end = start + limit - 1
        k = bisect_right(lo, end) - 1
        if k >= 0 and hi[k] >= end and lo[k] - 1 >= start + overlap:
            end = lo[k] - 1
        yield start, end
        start = end - overlap + 1
    yield start, length


def halves(length: int, spans: list[tuple[int, int]], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces of recursive bisection, each with ``overlap`` positions of the one before it.

    The strength of a cut is minus the number of spans it goes through.  A stretch above
    ``limit - overlap`` is cut in its middle third, where the cut is strongest, of
    equal ones nearest to the midpoint, then leftmost.
    """
    at, step = np.unique([x for a, b in spans if b > a for x in (a, b)], return_inverse=True)
    depth = np.zeros(len(at), np.int64)
    np.add.at(depth, step, [s for a, b in spans if b > a for s in (1, -1)])
    # runs of cuts of one strength: run i goes from edges[i] up to before edges[i + 1]; the cut p lies behind position p
    edges, depth = np.concatenate(([-1], at)), np.concatenate(([0], np.cumsum(depth)))
    todo = [(1, length)]
    while todo:
        a, b = todo.pop()
        size = b - a + 1
        if size <= limit - overlap:
            yield max(1, a - overlap), b
            continue
        lo, hi, mid = a - 1 + max(1, size // 3), b - max(1, size // 3), a - 1 + size // 2
        i, j = np.searchsorted(edges, (lo, hi), "right")
        own = np.arange(i - 1, j)
        own = own[depth[own] == depth[own].min()]
        left = np.maximum(edges[own], lo)
        right = np.minimum(np.append(edges, length)[own + 1] - 1, hi)
        best = np.clip(mid, left, right)
        cut = int(best[np.argmin(np.abs(best - mid))])
        todo += [(cut + 1, b), (a, cut)]


def split_oversized(df: DataFrame, key: str, length: str, first: str, last: str, limit: int = 2000, overlap: int = 100) -> DataFrame:
    """Consecutive pieces of every row longer than ``limit``: ``key, piece_no, start_pos, end_pos``.

    ``first`` and ``last`` are arrays of equal size with the spans that shouldn't be
    cut.  One row is one unit of work and costs time in its spans and pieces, not
    in its letters; its text isn't read here (``piece_texts`` adds it).

    * a null length or one up to the limit gives no pieces;
    * null arrays, null entries and spans of one position protect nothing; spans
      may overlap, nest, repeat or leave the item;
    * where no natural cut leaves ``overlap + 1`` to ``limit`` positions, the piece is ``limit`` long;
    * repeated rows give repeated pieces; an empty table gives none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    return _cut(df, key, length, first, last, limit, lambda n, spans: pieces(n, spans, limit, overlap))


def bisect_oversized(df: DataFrame, key: str, length: str, first: str, last: str, limit: int = 2000, overlap: int = 100) -> DataFrame:
    """Like ``split_oversized``, by recursive bisection: pieces of about equal size, the cuts through the fewest spans.

    Every piece is at most ``limit`` long and shares ``overlap`` positions with the one before; awkward input as there.
    """
    if not 0 <= overlap <= limit - 3:
        raise ValueError("overlap must be at least 0 and 3 less than limit")
    return _cut(df, key, length, first, last, limit, lambda n, spans: halves(n, spans, limit, overlap))


def _cut(df: DataFrame, key: str, length: str, first: str, last: str, limit: int, places: Callable[[int, list[tuple[int, int]]], Iterator[tuple[int, int]]]) -> DataFrame:
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(f"`{length}`") > limit).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{length}`").cast("int").alias("n"), F.col(f"`{first}`").alias("first"), F.col(f"`{last}`").alias("last")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, no, start, end = [], [], [], []
            for k, n, f, t in zip(b["key"], b["n"], b["first"], b["last"]):
                spans = [(int(x), int(y)) for x, y in zip(f, t) if x == x and y == y and x is not None and y is not None] if f is not None and t is not None else []
                for i, (s, e) in enumerate(places(int(n), spans), 1):
                    keys.append(k)
                    no.append(i)
                    start.append(s)
                    end.append(e)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=b["key"].dtype), "piece_no": no, "start_pos": start, "end_pos": end})

    return rows.mapInPandas(cut, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def piece_texts(parts: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``parts`` with the piece of ``text`` that belongs to each row, as ``piece``."""
    own = texts.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_nf_text"))
    return parts.join(own, key).withColumn("piece", F.substring(F.col("_nf_text"), F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1)).drop("_nf_text")


def sequence_letters(seq: Column) -> Column:
    """A sequence without blanks, line ends and digits."""
    return F.regexp_replace(seq, r"[\s\d]+", "")


def location_bases(location: Column) -> Column:
    """All base numbers that a location names in its own record."""
    own = F.regexp_replace(F.regexp_replace(location, r"\s+", ""), r"[^(),:]+:[^(),]*", "")
    return F.regexp_extract_all(own, F.lit(r"(\d+)"), F.lit(1)).cast("array<bigint>")


def split_records(genbank: DataFrame, limit: int = 2000, overlap: int = 100, bisect: bool = False) -> DataFrame:
    """Pieces of the current row of every record, cut outside its features where possible.

    Input: ``rec_id, features, seq, loaded_at``.  Lengths and spans are taken from
    each row where it lies, so the exchange that finds the current rows carries no
    sequence.  A feature other than ``source`` covers everything from its lowest to
    its highest base; without a location, or with parts in other records only, nothing.
    Records without sequence have no pieces.  ``bisect`` cuts by recursive bisection.
    """
    covering = F.filter(
        F.transform(
            F.filter(F.col("features"), lambda f: f["location"].isNotNull() & (F.coalesce(f["type"], F.lit("")) != "source")),
            lambda f: location_bases(f["location"]),
        ),
        lambda x: F.size(x) > 1,
    )
    flat = genbank.select(
        "rec_id", "loaded_at", F.length(sequence_letters(F.col("seq"))).alias("n"),
        F.transform(covering, lambda x: F.array_min(x)).alias("first"), F.transform(covering, lambda x: F.array_max(x)).alias("last"),
    )
    cut = bisect_oversized if bisect else split_oversized
    return cut(latest_rows(flat, ["rec_id"], "loaded_at", ["n", "first", "last"]), "rec_id", "n", "first", "last", limit, overlap)
