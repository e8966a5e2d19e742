"""Joins of short targets with references: exact, by spaced seeds, by blocks, and brute force; distance graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.functions.metrics import hamming
from nucleoframe.plans import strategy

BLOCK_TARGETS = 4096
#: The bit filter of targets has two to this power bits: 8 MB.
FILTER_BITS = 26


def seed_keys(word: Column, seed: str, m: int) -> Column:
    """For every shift of a seed within ``m`` letters: shift and the letters it looks at."""
    looks = [i for i, c in enumerate(seed) if c == "#"]
    return F.array(*[F.struct(F.lit(s).alias("shift"), F.concat(*[F.substring(word, s + i + 1, 1) for i in looks]).alias("look")) for s in range(m - len(seed.rstrip("-")) + 1)])


def _keyed(rows: DataFrame, m: int, k: int, how: str) -> DataFrame:
    if how == "blocks":
        keys = F.array(*[F.struct(F.lit(i).alias("plan"), F.lit(0).alias("shift"), F.substring("word", a + 1, n).alias("look")) for i, (a, n) in enumerate(strategy.blocks(m, k))])
    else:
        keys = F.flatten(F.array(*[F.transform(seed_keys(F.col("word"), s, m), lambda x, i=i: F.struct(F.lit(i).alias("plan"), x["shift"], x["look"])) for i, s in enumerate(strategy.SEEDS[m, k])]))
    return rows.select("*", F.explode(keys).alias("_k")).select("*", "_k.plan", "_k.shift", "_k.look").drop("_k")


def _looks(m: int, k: int, how: str) -> list[list[int]]:
    """Places of a word that each key is made of: all of them, those of a block, or those of a seed at each shift."""
    if how == "exact":
        return [list(range(m))]
    if how == "blocks":
        return [list(range(a, a + n)) for a, n in strategy.blocks(m, k)]
    seeds_ = [([i for i, c in enumerate(s) if c == "#"], len(s.rstrip("-"))) for s in strategy.SEEDS[m, k]]
    return [[shift + i for i in at] for at, n in seeds_ for shift in range(m - n + 1)]


def _hashes(letters: list[np.ndarray], looks: list[int]) -> np.ndarray:
    """The key of each placement, from the letters at some places of it; ``letters`` has those of all placements by place."""
    h = np.full(len(letters[0]), len(looks) + looks[0], np.uint64)
    for j in looks:
        h ^= letters[j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _keys(targets: DataFrame, target_id: str, target: str, m: int, looks: list[list[int]]) -> DataFrame:
    """``plan, key, target_id, target``: every distinct target of ``m`` letters under each of its keys."""
    kind = dict(targets.dtypes)[target_id]
    own = targets.where(F.length(F.col(f"`{target}`")) == m).select(F.col(f"`{target_id}`").alias("target_id"), F.col(f"`{target}`").alias("target")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer("".join(b.column(1).to_pylist()).encode("latin-1", "replace"), np.uint8).astype(np.uint64).reshape(-1, m)
            for plan, at in enumerate(looks):
                key = _hashes(list(x.T), at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), plan, np.int32)), pa.array(key), b.column(0), b.column(1)], ["plan", "key", "target_id", "target"])

    return own.mapInArrow(run, f"plan int, key bigint, target_id {kind}, target string")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each possible first ``FILTER_BITS`` bits of a key, set where a target has it: always of the same size."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    words = keys.select(F.shiftright(place, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = words.toArrow()  # at most as many rows as the filter has words of 64 bits
    out[found["i"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def keyed_join(targets: DataFrame, target_id: str, target: str, refs: DataFrame, ref_id: str, seq: str, m: int, k: int, how: str) -> DataFrame:
    """Candidates that agree in a key at the same placement, then those within ``k`` mismatches.

    Every placement's keys are looked up in a bit filter of fixed size where the reference
    lies, so only placements that some target may match leave the scan, whatever the
    number of targets; these meet the targets by key in an exchange, whose hot keys the
    skew join splits.
    """
    looks = _looks(m, k, how)
    keys = _keys(targets, target_id, target, m, looks)
    kind = dict(refs.dtypes)[ref_id]
    rows = refs.select(F.col(f"`{ref_id}`").alias("ref_id"), F.col(f"`{seq}`").alias("seq")).where(F.length("seq") >= m)
    sent = refs.sparkSession.sparkContext.broadcast(_filter_of(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            for r, text in enumerate(b.column(1).to_pylist()):
                x = np.frombuffer(text.encode("latin-1", "replace"), np.uint8).astype(np.uint64)
                every = [x[j : len(x) - m + 1 + j] for j in range(m)]
                for plan, at in enumerate(looks):
                    key = _hashes(every, at)
                    place = key >> np.uint64(64 - FILTER_BITS)
                    hit = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    if len(hit):
                        n = len(hit)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, plan, np.int32)), pa.array(key[hit].view(np.int64)), b.column(0).take(pa.array(np.full(n, r))), pa.array(hit.astype(np.int32)), pa.array([text[o : o + m] for o in hit.tolist()])],
                            ["plan", "key", "ref_id", "offset", "word"],
                        )

    right = rows.mapInArrow(run, f"plan int, key bigint, ref_id {kind}, offset int, word string")
    hits = right.join(keys, ["plan", "key"]).withColumn("hd", hamming(F.col("target"), F.col("word"))).where(F.col("hd") <= k)
    return hits.groupBy("target_id", "ref_id", "offset").agg(F.min("hd").alias("hd"))


def brute_join(targets: DataFrame, target_id: str, target: str, refs: DataFrame, ref_id: str, seq: str, k: int, overhang: int = 0) -> DataFrame:
    """All placements within ``k`` mismatches, up to ``overhang`` letters beyond either end; only the overlap counts.

    The stated targets are taken in blocks of fixed size, each held against all references.
    """
    kinds = dict(targets.dtypes)[target_id], dict(refs.dtypes)[ref_id]
    rows = refs.select(F.col(f"`{ref_id}`").alias("ref_id"), F.col(f"`{seq}`").alias("seq")).where("seq is not null")
    wanted = targets.select(F.col(f"`{target_id}`").alias("k"), F.col(f"`{target}`").alias("t")).where("t is not null and t <> ''").distinct()
    out = None

    def search(block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded = [(i, np.frombuffer(t.encode("latin-1", "replace"), np.uint8)) for i, t in block]
            for b in batches:
                ids, own, off, hd = [], [], [], []
                for r, text in enumerate(b.column(1).to_pylist()):
                    x = np.concatenate((np.zeros(overhang, np.uint8), np.frombuffer(text.encode("latin-1", "replace"), np.uint8), np.zeros(overhang, np.uint8)))
                    for i, t in coded:
                        n = len(x) - len(t) + 1
                        if n < 1 or len(x) - 2 * overhang < 1:
                            continue
                        d = np.zeros(n, np.int64)
                        for j, c in enumerate(t):
                            w = x[j : j + n]
                            d += (w != c) & (w != 0)
                        for o in np.flatnonzero(d <= k).tolist():
                            ids.append(i)
                            own.append(r)
                            off.append(o - overhang)
                            hd.append(int(d[o]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind_t), b.column(0).take(pa.array(own, pa.int64())), pa.array(off, pa.int32()), pa.array(hd, pa.int32())], ["target_id", "ref_id", "offset", "hd"])

        return rows.mapInArrow(run, f"target_id {kinds[0]}, ref_id {kinds[1]}, offset int, hd int")

    from pyspark.sql.pandas.types import to_arrow_type

    kind_t = to_arrow_type(targets.schema[target_id].dataType)
    block: list[tuple[object, str]] = []
    for r in wanted.toLocalIterator():
        block.append((r["k"], r["t"]))
        if len(block) == BLOCK_TARGETS:
            x = search(block)
            out = x if out is None else out.unionByName(x)
            block = []
    if block or out is None:
        x = search(block)
        out = x if out is None else out.unionByName(x)
    return out


def similarity_join(
    targets: DataFrame, target_id: str, target: str, refs: DataFrame, ref_id: str, seq: str, m: int, k: int, how: str = "auto", overhang: int = 0,
) -> DataFrame:
    """``target_id, ref_id, offset, hd``: placements of targets of ``m`` letters with at most ``k`` mismatches.

    All plans give the same rows: ``exact`` joins words, ``seed`` the letters under a
    spaced seed, ``blocks`` one of ``k + 1`` disjoint blocks, ``brute`` compares all
    placements and is the only one to look beyond the ends.  Null and shorter
    sequences match nothing; repeated targets count once.
    """
    how = strategy.choose(m, k, overhang) if how == "auto" else how
    if how == "exact":
        if k:
            raise ValueError("the exact plan has no mismatches")
    if how == "brute":
        return brute_join(targets.where(F.length(F.col(f"`{target}`")) == m), target_id, target, refs, ref_id, seq, k, overhang)
    return keyed_join(targets, target_id, target, refs, ref_id, seq, m, k, how)


def nearest(queries: DataFrame, query_id: str, query: str, pool: list[str]) -> DataFrame:
    """``query_id, hd``: the smallest distance to a stated pool; the query's length for an empty pool, an error for unequal lengths.

    The pool is a constant of the plan, so the queries aren't joined with anything.
    """
    q = F.col(f"`{query}`")
    best = F.array_min(F.transform(F.array(*[F.lit(p) for p in pool]), lambda p: F.when(F.length(p) == F.length(q), hamming(q, p)).otherwise(F.raise_error(F.lit("sequences of unequal length")).cast("int")))) if pool else F.length(q)
    return queries.select(F.col(f"`{query_id}`").alias(query_id), best.alias("hd"))


def misprimes(primers: DataFrame, primer_id: str, primer: str, refs: DataFrame, ref_id: str, seq: str, m: int, threshold: int) -> DataFrame:
    """``primer_id`` of all primers of ``m`` letters that lie somewhere on a reference with fewer than ``threshold`` mismatches."""
    hits = similarity_join(primers, primer_id, primer, refs, ref_id, seq, m, threshold - 1)
    return hits.select(F.col("target_id").alias(primer_id)).distinct()


def distance_graph(seqs: DataFrame, key: str, seq: str, within: int, m: int) -> DataFrame:
    """``i, j, distance`` (i < j) of all pairs of sequences of ``m`` letters at most ``within`` apart.

    Pairs meet in one of ``within + 1`` disjoint blocks; with ``within = m`` there is
    nothing to meet in, and all pairs are asked for, use ``full_graph``.
    """
    rows = seqs.where(F.length(F.col(f"`{seq}`")) == m).select(F.col(f"`{key}`").alias("id"), F.col(f"`{seq}`").alias("word"))
    a, b = (_keyed(rows, m, within, "blocks").withColumnRenamed("id", n).withColumnRenamed("word", f"w{n}") for n in "ij")
    pairs = a.join(b, ["plan", "shift", "look"]).where("i < j").withColumn("distance", hamming(F.col("wi"), F.col("wj"))).where(F.col("distance") <= within)
    return pairs.groupBy("i", "j").agg(F.min("distance").alias("distance"))


def full_graph(seqs: DataFrame, key: str, seq: str, kind: str = "equal", least: int = 2, block: int = 2000) -> DataFrame:
    """``i, j, distance`` (or ``linked`` for the compatibility kinds) of all pairs (i < j) of a set.

    A matrix of all pairs is quadratic by definition.  The rows are taken in blocks of
    fixed size, each a constant of the plan that is held against all rows.

    kinds: ``equal`` (Hamming distance), ``placed`` (smallest over all placements of the
    shorter), ``both_ways`` and ``both_ways_3p`` (1 if the pair is compatible).
    """
    from nucleoframe.functions import metrics

    rows = seqs.select(F.col(f"`{key}`").alias("i"), F.col(f"`{seq}`").alias("a")).where("a is not null")
    a, b = F.col("a"), F.col("b")
    if kind == "equal":
        value = hamming(a, b).alias("distance")
    elif kind == "placed":
        value = F.when(F.length(a) <= F.length(b), metrics.min_hamming(a, b)).otherwise(metrics.min_hamming(b, a)).alias("distance")
    else:
        value = (metrics.hamming_both_ways(a, b, least) if kind == "both_ways" else metrics.hamming_and_3p(a, b, least)).cast("int").alias("linked")
    out, pool = None, rows.toLocalIterator()
    while (some := list(islice(pool, block))) or out is None:
        every = F.array(*[F.struct(F.lit(r["i"]).alias("j"), F.lit(r["a"]).alias("b")) for r in some]) if some else F.array().cast(f"array<struct<j:{dict(rows.dtypes)['i']},b:string>>")
        part = rows.select("i", "a", F.explode(every).alias("x")).select("i", "a", "x.j", "x.b").where("i < j").select("i", "j", value)
        out = part if out is None else out.unionByName(part)
    return out


def agreement_check(df: DataFrame, key: str, seq: str, pool: list[str], max_run: int) -> DataFrame:
    """``key, ok``: whether no stored sequence agrees with the row in more than ``max_run`` places running."""
    s = F.col(f"`{seq}`")
    marks = F.transform(F.array(*[F.lit(p) for p in pool]), lambda p: F.array_join(F.zip_with(F.split(s, ""), F.split(p, ""), lambda x, y: F.when(x == y, "1").otherwise("0")), "")) if pool else F.array().cast("array<string>")
    return df.select(F.col(f"`{key}`").alias(key), (~F.exists(marks, lambda x: x.rlike(f"1{{{max_run + 1}}}"))).alias("ok"))
