"""The genetic code, translation and reverse translation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The standard code, for codons in the order of TCAG at each place.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), STANDARD_CODE)}


def _lookup(rna: bool) -> Column:
    return F.create_map(*[F.lit(x) for c, a in CODONS.items() for x in (c.replace("T", "U") if rna else c, a)])


def translate(seq: Column, rna: bool = False, strict: bool = False) -> Column:
    """Amino acids of frame 0.  An unknown or partial codon gives null, or an error with ``strict``."""
    table = _lookup(rna)
    codons = F.regexp_extract_all(seq, F.lit("(?s)(.{1,3})"), F.lit(1))
    letters = F.transform(codons, lambda c: F.try_element_at(table, c))
    bad = F.exists(letters, lambda x: x.isNull())
    error = F.raise_error(F.concat(F.lit("unknown codon in "), F.substring(seq, 1, 40))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(seq.isNull(), None).when(bad, error).otherwise(F.array_join(letters, ""))


def codon_table(spark: SparkSession, rna: bool = False) -> DataFrame:
    """``codon, aa``: the 64 codons."""
    return spark.createDataFrame([(c.replace("T", "U") if rna else c, a) for c, a in CODONS.items()], "codon string, aa string")


def reverse_translate(aa: Column, key: Column, seed: int = 0, rna: bool = False) -> Column:
    """A codon for each amino acid, drawn by a hash of seed, key and place; null for an unknown letter."""
    groups: dict[str, list[str]] = {}
    for c, a in CODONS.items():
        groups.setdefault(a, []).append(c.replace("T", "U") if rna else c)
    table = F.create_map(*[x for a, cs in groups.items() for x in (F.lit(a), F.array(*[F.lit(c) for c in cs]))])

    def draw(a: Column, i: Column) -> Column:
        choices = F.try_element_at(table, a)
        return F.get(choices, F.pmod(F.xxhash64(F.lit(seed), key, i), F.size(choices)).cast("int"))

    codons = F.transform(F.regexp_extract_all(aa, F.lit("(?s)(.)"), F.lit(1)), draw)
    return F.when(~F.exists(codons, lambda c: c.isNull()), F.array_join(codons, ""))


def codon_frequencies(counts: DataFrame, by: list[str], count: str = "n") -> DataFrame:
    """Share of each codon among those of its amino acid: adds ``freq``, null where none of them occurs."""
    return counts.withColumn("freq", F.try_divide(F.col(count), F.sum(count).over(Window.partitionBy(*by))))


def codon_usage(coding: DataFrame, key: str, seq: str, group: str) -> DataFrame:
    """``group, aa, codon, n, freq`` over all whole codons of a table of coding sequences."""
    codons = coding.select(F.col(group), F.explode(F.regexp_extract_all(F.col(seq), F.lit("([ACGT]{3})"), F.lit(1))).alias("codon"))
    counted = codons.groupBy(group, "codon").agg(F.count("*").alias("n"))
    own = counted.withColumn("aa", F.try_element_at(_lookup(False), F.col("codon")))
    return codon_frequencies(own, [group, "aa"])


def frequent_codons(usage: DataFrame, group: str) -> DataFrame:
    """The most frequent codon of each amino acid; of equal ones the first by name."""
    best = F.max(F.struct(F.col("freq"), F.expr("-rank").alias("r"), F.col("codon")))
    ranked = usage.withColumn("rank", F.row_number().over(Window.partitionBy(group, "aa").orderBy("codon")))
    return ranked.groupBy(group, "aa").agg(best.alias("b")).select(group, "aa", F.col("b.codon").alias("codon"), F.col("b.freq").alias("freq"))


def above_threshold(usage: DataFrame, group: str, threshold: float) -> DataFrame:
    """Codons more frequent than the threshold, and whether each amino acid keeps one (``lost``: amino acids without)."""
    kept = usage.where(F.col("freq") > threshold)
    lost = usage.select(group, "aa").distinct().join(kept.select(group, "aa").distinct(), [group, "aa"], "left_anti").withColumn("codon", F.lit(None).cast("string")).withColumn("freq", F.lit(None).cast("double"))
    return kept.select(group, "aa", "codon", "freq").unionByName(lost)


def weighted_reverse_translate(aa: Column, key: Column, usage: DataFrame, group: str, name: str, threshold: float = 0.0, seed: int = 0, best_only: bool = False) -> Column:
    """Reverse translation by the codon usage of one group; null for a residue without a codon above the threshold.

    The usage of a group is a table of at most 64 rows, read when the plan is made and
    folded into it as a constant; each residue draws from the cumulative shares by a hash.
    """
    kept = usage.where((F.col(group) == name) & (F.col("freq") > threshold))
    if best_only:
        kept = frequent_codons(kept, group)
    rows = kept.select("aa", "codon", "freq").limit(65).collect()
    if len(rows) > 64:
        raise ValueError("a codon usage table has at most 64 rows a group")
    if not rows:
        return F.lit(None).cast("string")
    entries: list[Column] = []
    for a in sorted({r["aa"] for r in rows}):
        own = sorted((r["codon"], r["freq"]) for r in rows if r["aa"] == a)
        total, upto, steps = sum(f for _, f in own), 0.0, []
        for i, (c, f) in enumerate(own):
            upto += f / total
            steps.append(F.struct(F.lit(2.0 if i == len(own) - 1 else upto).alias("upto"), F.lit(c).alias("codon")))
        entries += [F.lit(a), F.array(*steps)]
    table = F.create_map(*entries)

    def draw(a: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return F.get(F.filter(F.try_element_at(table, a), lambda c: c["upto"] > u), F.lit(0))["codon"]

    codons = F.transform(F.regexp_extract_all(aa, F.lit("(?s)(.)"), F.lit(1)), draw)
    return F.when(~F.exists(codons, lambda c: c.isNull()), F.array_join(codons, ""))
