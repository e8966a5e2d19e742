"""Padlock probes: scaffolds, screening of arms, sessions of starts, the best probe of each, whole design."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from nucleoframe.common import cut_lineage
from nucleoframe.functions.metrics import gc_content, left_arm_clamp, right_arm_clamp
from nucleoframe.functions.thermo import _DISORDER, _HEAT, GAS, KELVIN, heterodimer_proxy, melting_temperature, tm_of
from nucleoframe.operators.genes import transcripts_of
from nucleoframe.operators.kmers import CODES, per_record
from nucleoframe.operators.regions import permitted_sequences



@dataclass(frozen=True)
class Screen:
    """Limits of a probe's arms."""

    arm: int = 20
    spacing: int = 20
    gap: int = 0
    gc_min: float = 0.4
    gc_max: float = 0.6
    clamp_max: int = 3
    tm_min: float = 50.0
    structure_max: float = 30.0
    exclude: tuple[str, ...] = ("GGGGG",)
    window_exclude: str = "GGGG"


def scaffold(template: str, barcode: Column) -> Column:
    """A scaffold with its barcode: ``{barcode}`` in the template is replaced, other marks are removed."""
    return F.regexp_replace(F.replace(F.lit(template), F.lit("{barcode}"), barcode), r"\{\w+\}", "")


def screen_arms(left: Column, right: Column, loop: Column, p: Screen = Screen()) -> Column:
    """``ok`` and the figures it rests on."""
    gc_l, gc_r = gc_content(left), gc_content(right)
    tm_l, tm_r = melting_temperature(left), melting_temperature(right)
    dimers = [heterodimer_proxy(left, right), heterodimer_proxy(left, loop), heterodimer_proxy(loop, right)]
    clamp = (left_arm_clamp(left) <= p.clamp_max) & (right_arm_clamp(right) <= p.clamp_max)
    clear = F.lit(True)
    for x in p.exclude:
        clear = clear & ~F.contains(left, F.lit(x)) & ~F.contains(right, F.lit(x))
    ok = gc_l.between(p.gc_min, p.gc_max) & gc_r.between(p.gc_min, p.gc_max) & clamp & (tm_l >= p.tm_min) & (tm_r >= p.tm_min) & clear
    for d in dimers:
        ok = ok & (d <= p.structure_max)
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"), gc_l.alias("gc_l"), gc_r.alias("gc_r"), clamp.alias("l_clamp"), tm_l.alias("tm_l"), tm_r.alias("tm_r"),
        *[d.alias(f"tm_hetero_{i}") for i, d in enumerate(dimers)],
    )


def anchored_groups(starts: Column, reach: int) -> Column:
    """For sorted starts, the anchor of each: a group holds all starts up to ``reach`` beyond its first one."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            if x is None:
                out.append(None)
                continue
            x, own, i = np.asarray(x), [], 0
            while i < len(x):
                j = int(np.searchsorted(x, x[i] + reach, "right"))
                own += [int(x[i])] * (j - i)
                i = j
            out.append(own)
        return pd.Series(out)

    return run(starts)


def _codes(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)].astype(np.int64)


def _word(codes: np.ndarray) -> int | None:
    """A short word as an integer, none with a foreign letter."""
    return None if len(codes) and not 0 <= codes.min() <= codes.max() < 4 else sum(int(c) << 2 * (len(codes) - 1 - j) for j, c in enumerate(codes))


@lru_cache(maxsize=512)
def _scaffold_words(scaffold_seq: str, size: int) -> tuple[np.ndarray, int | None, float]:
    """Which words the reverse complement of a scaffold has, its first one (none with a foreign letter) and the temperature of that."""
    back = 3 - _codes(scaffold_seq)[::-1]
    known = np.zeros(1 << 2 * size, bool)
    known[[w for i in range(len(back) - size + 1) if (w := _word(back[i : i + size])) is not None]] = True
    mine = _word(back[:size]) if len(back) >= size else None
    return known, mine, 0.0 if mine is None else tm_of(scaffold_seq[-size:].upper())


def _word_at(text: str, word: str) -> np.ndarray:
    """Where a word begins, overlapping ones too."""
    x, w = (np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in (text, word))
    out = np.zeros(len(x), bool)
    if len(x) >= len(w):
        out[: len(x) - len(w) + 1] = np.all([x[j : len(x) - len(w) + 1 + j] == c for j, c in enumerate(w)], 0)
    return out


def _scan(text: str, scaffold_seq: str, p: Screen) -> dict[str, list]:
    """The best probe of each group of one record, from running sums over its bases."""
    names = ("idx", "group_start", "seq_l", "seq_r", "gc_l", "gc_r", "tm_l", "tm_r", "score")
    width, n = 2 * p.arm + p.gap, len(text) - (2 * p.arm + p.gap) + 1
    if n < 1:
        return {k: [] for k in names}
    code = _codes(text)
    base = np.minimum(code, 3)
    pair = base[:-1] * 4 + base[1:]
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    foreign, gc, weak = total(code > 3), total((code == 1) | (code == 2)), (base == 0) | (base == 3)
    heat, disorder = total(_HEAT[pair]), total(_DISORDER[pair])
    weak = weak.astype(np.int8)

    def melting(a: np.ndarray, size: int) -> np.ndarray:
        z = a + size
        ends = weak[a] + weak[z - 1]
        same = np.ones(len(a), bool)
        for i in range((size + 1) // 2):
            same &= base[a + i] == 3 - base[z - 1 - i]
        dh = -100.0 * (heat[z - 1] - heat[a] - 23 * ends - (2 - ends))
        ds = -0.1 * (disorder[z - 1] - disorder[a] - 41 * ends + 28 * (2 - ends) + 14 * same) + 0.368 * (size - 1) * np.log(0.05)
        return dh / (ds + GAS * np.log(50 / np.where(same, 1e9, 4e9))) - KELVIN

    def arm(at: int) -> tuple[np.ndarray, ...]:
        a = np.arange(n) + at
        return a, a + p.arm, (gc[a + p.arm] - gc[a]) / p.arm, melting(a, p.arm)

    l, lz, gc_l, tm_l = arm(0)
    r, rz, gc_r, tm_r = arm(p.arm + p.gap)
    ok = (foreign[lz] == foreign[l]) & (foreign[rz] == foreign[r])
    for x in (gc_l, gc_r):
        ok &= (x >= p.gc_min) & (x <= p.gc_max)
    ok &= (gc[l + 5] - gc[l] <= p.clamp_max) & (gc[rz] - gc[rz - 5] <= p.clamp_max) & (tm_l >= p.tm_min) & (tm_r >= p.tm_min)
    for word, spans in ((p.window_exclude, [(0, width)]), *((x, [(0, p.arm), (p.arm + p.gap, width)]) for x in p.exclude)):
        found = total(_word_at(text, word))  # begins of the word
        for lo, hi in spans:
            if hi - lo >= len(word):
                ok &= found[np.arange(n) + hi - len(word) + 1] == found[np.arange(n) + lo]
    at = np.flatnonzero(ok)
    worst = np.zeros(len(at))
    # of the arms' and the scaffold's last 4 to 8 bases those that the other strand can pair with, as in dimer_tm
    forth, turned = np.zeros(len(base), np.int32), np.zeros(len(base), np.int32)  # the word from each place on, and its reverse complement
    for size in range(1, min(8, p.arm) + 1 if len(at) else 0):
        here = base[size - 1 :].astype(np.int32)
        forth, turned = forth[: len(here)] << 2 | here, turned[: len(here)] | (3 - here) << 2 * (size - 1)
        if size < 4:
            continue
        tail = at + p.arm - size
        places = [forth[at + p.arm + p.gap + q] for q in range(p.arm - size + 1)]
        own, met = turned[tail], np.zeros(len(at), bool)
        for x in places:
            met |= x == own
        known, mine, tm = _scaffold_words(scaffold_seq, size)
        met |= known[forth[tail]]
        hit = np.flatnonzero(met)
        worst[hit] = np.maximum(worst[hit], melting(tail[hit], size))
        if mine is not None:
            met = np.zeros(len(at), bool)
            for x in places:
                met |= x == mine
            worst[met] = np.maximum(worst[met], tm)
    keep = at[worst <= p.structure_max].tolist()
    out = {k: [] for k in names}
    reach, k = 2 * p.arm + p.spacing, 0
    while k < len(keep):
        anchor, best = keep[k], None
        while k < len(keep) and keep[k] <= anchor + reach:
            i = keep[k]
            score = round(float(tm_l[i] + 0.9 * tm_r[i]), 6)
            if best is None or score > best[0]:
                best = (score, i)
            k += 1
        score, i = best
        row = (i, anchor, text[i : i + p.arm], text[i + p.arm + p.gap : i + width], gc_l[i], gc_r[i], tm_l[i], tm_r[i], score)
        for name, v in zip(names, row):
            out[name].append(v)
    return out


def generate_padlocks(records: DataFrame, key: str, seq: str, scaffold_seq: str, p: Screen = Screen()) -> DataFrame:
    """The best probe of each group of neighbouring starts: ``key, idx, group_start, seq_l, seq_r, padlock_seq, score`` and the arms' figures.

    Every start is tried.  The left arm lies first in the target, the right arm
    behind it and the gap; the probe is right arm, scaffold, left arm.  Score: left
    temperature plus 0.9 of the right one, then the smaller start.  A record is one
    unit of work in time linear to its length; nothing is shuffled.
    """
    fields = "idx int, group_start int, seq_l string, seq_r string, gc_l double, gc_r double, tm_l double, tm_r double, score double"
    rows = per_record(records, key, seq, lambda t: _scan(t, scaffold_seq, p), fields)
    return rows.withColumn("padlock_seq", F.concat("seq_r", F.lit(scaffold_seq), "seq_l"))


def design(records: DataFrame, key: str, seq: str, scaffold_seq: str, p: Screen = Screen(), relaxed_gc: float = 0.65) -> DataFrame:
    """Probes of every record; records without any are tried once more with a higher limit of G and C (``relaxed``)."""
    first = generate_padlocks(records, key, seq, scaffold_seq, p).withColumn("relaxed", F.lit(False))
    rest = records.join(first.select(key).distinct(), key, "left_anti")
    again = Screen(**{**p.__dict__, "gc_max": relaxed_gc})
    return first.unionByName(generate_padlocks(rest, key, seq, scaffold_seq, again).withColumn("relaxed", F.lit(True)))


def target_segments(genes: DataFrame, variants: DataFrame, variant_key: str, sequences: DataFrame, arm: int = 20, three_prime: int = 10) -> DataFrame:
    """``gene_id, transcript_id, exon_id, strand_dir, genome_idx, seq``: where the probes of each gene may lie.

    Of the gene's canonical transcript (the first listed) the last exon is taken, without the
    variants of the transcript, as segments from 5' to 3'.  Segments of up to two arms
    are left out, the last ``three_prime`` permitted bases too: a segment that reaches
    into them is trimmed, or left out if less than two arms remain.  ``genome_idx`` is the
    lowest place of a segment.  ``sequences``: ``exon_id, seq`` in the direction of the strand;
    they are joined by sorting, as in ``permitted_sequences``.  The chosen exons with their
    sequences are written once, since several steps start from them.
    """
    t = transcripts_of(genes).where("t.is_canonical = 1").groupBy("gene_id").agg(F.min(F.struct("t.id", "t.strand", F.try_element_at(F.col("t.Exon"), F.lit(-1)).alias("e"))).alias("x"))
    exons = t.select("gene_id", F.col("x.id").alias("transcript_id"), F.col("x.strand").alias("strand"), F.col("x.e.id").alias("exon_id"), F.col("x.e.start").alias("start"), F.col("x.e.end").alias("end"))
    whole = cut_lineage(exons.join(sequences.hint("merge"), "exon_id").select("gene_id", "transcript_id", "exon_id", "strand", "start", "end", "seq"))
    v = variants.select(F.col(variant_key).alias("transcript_id"), "start", "end")
    runs = permitted_sequences(whole, v, "transcript_id", "start", "end", "seq", "strand")
    own = whole.select("gene_id", "transcript_id", "exon_id", "strand", F.least("start", "end").alias("_lo"), F.greatest("start", "end").alias("_hi"))
    rows = runs.join(own.hint("merge"), "transcript_id").where("lo >= _lo and hi <= _hi + 1").withColumn("n", F.length("seq"))
    along = Window.partitionBy("gene_id").orderBy(F.when(F.col("strand") < 0, -F.col("lo")).otherwise(F.col("lo")))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.sum("n").over(Window.partitionBy("gene_id")) - three_prime - before
    kept = rows.withColumn("keep", F.least(F.col("n"), room).cast("int")).where((F.col("n") > 2 * arm) & ((F.col("keep") == F.col("n")) | (F.col("keep") >= 2 * arm)))
    return kept.select(
        "gene_id", "transcript_id", "exon_id", F.when(F.col("strand") == 1, "fwd").otherwise("rev").alias("strand_dir"),
        F.when(F.col("strand") < 0, F.col("lo") + F.col("n") - F.col("keep")).otherwise(F.col("lo")).alias("genome_idx"), F.substr("seq", F.lit(1), F.col("keep")).alias("seq"),
    )


def design_for_genes(segments: DataFrame, template: str, barcodes: list[str], p: Screen = Screen(), relaxed_gc: float = 0.65) -> DataFrame:
    """The probes of every gene's segments; genes without any are tried once more with a higher limit of G and C (``relaxed``).

    Every gene has one of the barcodes (a constant list), by a hash of its id, in its scaffold.  ``idx`` counts within the segment.
    Segments are read once: one without probes is tried again at its place, and what that gives counts if its whole gene had none.
    """
    bar = F.get(F.array(*[F.lit(b) for b in barcodes]), F.pmod(F.xxhash64("gene_id"), F.lit(len(barcodes))).cast("int"))
    rows = segments.withColumn("barcode", bar).withColumn("scaffold", scaffold(template, F.col("barcode")))
    key = F.struct("gene_id", "transcript_id", "exon_id", "strand_dir", "genome_idx", "barcode", "scaffold")
    rows = rows.select("gene_id", key.alias("k"), F.concat("scaffold", F.lit("|"), "seq").alias("both"))
    fields = "idx int, group_start int, seq_l string, seq_r string, gc_l double, gc_r double, tm_l double, tm_r double, score double, relaxed boolean"
    again = Screen(**{**p.__dict__, "gc_max": relaxed_gc})

    def work(t: str) -> dict[str, list]:
        s, _, seq = t.partition("|")
        first = _scan(seq, s, p)
        out = first if first["idx"] else _scan(seq, s, again)
        return out | {"relaxed": [out is not first] * len(out["idx"])}

    probes = per_record(rows, "k", "both", work, fields).select("k.*", "idx", "group_start", "seq_l", "seq_r", "tm_l", "tm_r", "score", F.concat("seq_r", "k.scaffold", "seq_l").alias("padlock_seq"), "relaxed")
    least = F.min("relaxed").over(Window.partitionBy("gene_id"))
    return probes.withColumn("_nf_least", least).where(F.col("relaxed") == F.col("_nf_least")).drop("_nf_least")


def padlock_table(hits: DataFrame) -> DataFrame:
    """The 14 columns of a padlock file, the arms' temperatures computed from their sequences, to three decimals."""
    names = {"gene": "gene_name", "idx": "index", "padlock_seq": "sequence", "seq_r": "right_arm", "seq_l": "left_arm"}
    cols = ["gene", "name0", "name1", "strand_dir", "genome_idx", "idx", "gap_size", "padlock_seq", "barcode", "seq_r", "scaffold", "seq_l"]
    tms = [F.round(melting_temperature(F.col(c)), 3).alias(n) for c, n in (("seq_r", "right_tm"), ("seq_l", "left_tm"))]
    return hits.select(*[F.col(c).alias(names.get(c, c)) for c in cols], *tms)
