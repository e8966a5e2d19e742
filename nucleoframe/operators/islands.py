"""Overlapping and gapped intervals (problem 3): periods and gaps of every entity.

Intervals are sorted globally by entity and start.  Each partition reports its last
entity and that entity's open period; the summaries, one a partition, are combined
in order, and a second pass over the same partitions starts each from the state
that the ones before it leave.  An entity with a third of all rows spreads over
many partitions and is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.common import bare_id, cut_lineage, latest_rows


def _periods(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of rows in order of (key, start): index of each one's first row, and its end; ``key`` counts up."""
    top = pd.Series(end).groupby(key).cummax().to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > top[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(key) - 1]))
    return first, last, top


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """``entity..., kind, start_pos, end_pos``: the maximal covered stretches ('period') and the uncovered ones between them ('gap').

    Whole numbers, both ends included; intervals without a free number between them
    belong to one period.

    * ends in the wrong order are swapped; a row without both ends is left out;
    * null is an entity value like any other; nested, touching and repeated intervals join their period;
    * an entity of one period has no gap; an empty table gives nothing; other columns don't matter.
    """
    spark = df.sparkSession
    names = [f"_nf_e{i}" for i in range(len(entity))]
    kinds = [dict(df.dtypes)[e] for e in entity]
    rows = df.select(
        *[F.col(f"`{e}`").alias(n) for e, n in zip(entity, names)],
        F.least(F.col(f"`{start}`"), F.col(f"`{end}`")).cast("bigint").alias("lo"), F.greatest(F.col(f"`{start}`"), F.col(f"`{end}`")).cast("bigint").alias("hi"),
    ).where(F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(rows.repartitionByRange(n, *names, "lo").sortWithinPartitions(*names, "lo", "hi").withColumn("part", F.spark_partition_id()))

    def entity_of(b: pd.DataFrame, i: int) -> tuple:
        return tuple(None if pd.isna(x := b[c].iloc[i]) else x for c in names)

    def numbered(b: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(b), bool)
        for c in names:
            codes = pd.factorize(b[c], use_na_sentinel=True)[0]
            change[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(change)

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each partition: whether it has one entity only, its last entity's last period."""
        state: dict[int, list] = {}
        for whole in batches:
            for part, b in whole.groupby("part", sort=False):
                key = numbered(b)
                lo, hi = b["lo"].to_numpy(), b["hi"].to_numpy()
                first, _, top = _periods(key, lo, hi)
                head, tail = entity_of(b, 0), entity_of(b, len(b) - 1)
                begin, stop = int(lo[first[-1]]), int(top[-1])
                old = state.get(part)
                alone = key[-1] == 0 and (old is None or (old[0] and old[1] == head))
                if old is not None and key[-1] == 0 and old[1] == head:
                    if begin <= old[3] + 1:
                        begin = old[2]
                    stop = max(stop, old[3])
                state[part] = [alone, tail, begin, stop]
        for part, (alone, tail, begin, stop) in state.items():
            yield pd.DataFrame([{"part": part, "alone": bool(alone), "begin": begin, "stop": stop, **dict(zip(names, tail))}])

    fields = ", ".join(f"{c} {k}" for c, k in zip(names, kinds))
    found = ordered.mapInPandas(summary, f"part int, alone boolean, begin bigint, stop bigint, {fields}").collect()  # one row a partition
    carried: dict[int, tuple | None] = {}
    open_: tuple | None = None
    for r in sorted(found, key=lambda r: r["part"]):
        carried[r["part"]] = open_
        tail, begin, stop = tuple(r[c] for c in names), r["begin"], r["stop"]
        if r["alone"] and open_ is not None and open_[0] == tail:
            if begin <= open_[2] + 1:
                begin = open_[1]
            stop = max(stop, open_[2])
        open_ = (tail, begin, stop)
    final = max(carried, default=None)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Periods that end in the partition and gaps before periods that begin in it; the open one goes on to the next."""
        now: tuple | None = None
        part = None
        last_out: tuple | None = None
        for whole in batches:
            for p, b in whole.groupby("part", sort=False):
                if p != part:
                    now, part = carried[p], p
                key = numbered(b)
                lo, hi = b["lo"].to_numpy(), b["hi"].to_numpy()
                cols = {c: b[c].to_numpy(object) for c in names}
                if now is not None:  # the open period takes part as a first row
                    same = now[0] == entity_of(b, 0)
                    key = np.concatenate(([0], key + (0 if same else 1)))
                    lo, hi = np.concatenate(([now[1]], lo)), np.concatenate(([now[2]], hi))
                    cols = {c: np.concatenate((np.array([v], object), cols[c])) for c, v in zip(names, now[0])}
                first, last, top = _periods(key, lo, hi)
                begin, stop, owner = lo[first], top[last], key[first]
                gap = np.flatnonzero(owner[1:] == owner[:-1])
                out = [
                    pd.DataFrame({**{c: cols[c][first[:-1]] for c in names}, "kind": "period", "start_pos": begin[:-1], "end_pos": stop[:-1]}),
                    pd.DataFrame({**{c: cols[c][first[gap]] for c in names}, "kind": "gap", "start_pos": stop[gap] + 1, "end_pos": begin[gap + 1] - 1}),
                ]
                now = (tuple(None if pd.isna(x := cols[c][first[-1]]) else x for c in names), int(begin[-1]), int(stop[-1]))
                last_out = now if p == final else None
                yield from (x for x in out if len(x))
        if last_out is not None:
            yield pd.DataFrame([{**dict(zip(names, last_out[0])), "kind": "period", "start_pos": last_out[1], "end_pos": last_out[2]}])

    result = ordered.mapInPandas(scan, f"{fields}, kind string, start_pos bigint, end_pos bigint")
    return result.select(*[F.col(c).alias(e) for c, e in zip(names, entity)], "kind", "start_pos", "end_pos")


def exon_periods(exons: DataFrame) -> DataFrame:
    """``parent, seq_region_name, kind, start_pos, end_pos`` of the current exons of every transcript on each region.

    The latest row per bare ``Parent`` and ``id`` counts, if it has both ends; rows
    with a null ``Parent`` don't count.
    """
    flat = exons.where(F.col("Parent").isNotNull()).select(
        bare_id(F.col("Parent")).alias("parent"), F.col("id").alias("exon"), "loaded_at", "seq_region_name", F.col("start").alias("first"), F.col("end").alias("last")
    )
    current = latest_rows(flat, ["parent", "exon"], "loaded_at", ["seq_region_name", "first", "last"])
    return periods_and_gaps(current, ["parent", "seq_region_name"], "first", "last")
