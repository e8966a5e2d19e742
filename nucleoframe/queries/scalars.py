"""Queries of column functions: strings, packed integers, metrics, thermodynamics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.functions import bits, codon, metrics, seq, thermo
from nucleoframe.operators import kmers, similarity
from nucleoframe.queries import base
from nucleoframe.queries.base import code_sql, query, rc_sql


def scalar(name: str, source: Callable[[SparkSession, str], DataFrame], columns: Callable[[], dict[str, Column]], sql: str | None) -> None:
    """A query of the source's id and some columns; ``sql`` is the select list in DuckDB."""

    @query(name, f"SELECT id, {sql} FROM {source.__name__}" if sql else None)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return source(spark, d).select("id", *[c.alias(n) for n, c in columns().items()])


S, L, R = (lambda: F.col("seq")), (lambda: F.col("seq_l")), (lambda: F.col("seq_r"))
_COMP = f"translate(regexp_replace(seq, '[^{seq.IUPAC}\\n]', '?', 'g'), '{seq.IUPAC}', '{seq.IUPAC_COMPLEMENT}')"

scalar("s1_reverse", base.raws, lambda: {"out": seq.reverse(S())}, "reverse(seq) AS out")
scalar("s2_complement", base.raws, lambda: {"out": seq.complement(S())}, f"{_COMP} AS out")
scalar("s3_reverse_complement", base.raws, lambda: {"out": seq.reverse_complement(S())}, f"reverse({_COMP}) AS out")
scalar("s5_simple_reverse_complement", base.raws, lambda: {"c": seq.simple_complement(S()), "rc": seq.simple_reverse_complement(S())}, "translate(seq, 'ACGTacgt', 'TGCATGCA') AS c, reverse(translate(seq, 'ACGTacgt', 'TGCATGCA')) AS rc")
scalar("s6_random_sequence", base.oligos_of(), lambda: {"out": seq.random_sequence(F.col("id"), 30, 7), "n": F.length(seq.random_duplex(F.col("id"), 30, 7)["rev"])}, None)
scalar("s7_weighted_random_sequence", base.oligos_of(), lambda: {"out": seq.random_sequence(F.col("id"), 30, 7, {"A": 0.4, "C": 0.1, "G": 0.1, "T": 0.4})}, None)
scalar("s15_wrap", base.contigs, lambda: {"out": seq.hard_wrap(S(), 60)}, r"regexp_replace(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), '\n$', '') AS out")


@query("s8_random_avoiding_words", "SELECT id, 20 AS n, TRUE AS ok FROM oligos")
def s8(spark: SparkSession, d: str) -> DataFrame:
    made = base.oligos(spark, d, "seq_l").select("id", "seq_l", seq.random_avoiding(F.col("id"), L(), 20, 8, 3).alias("out"))
    clear = ~F.arrays_overlap(kmers.word_list(F.col("out"), 8), kmers.word_list(L(), 8, True))
    return made.select("id", F.length("out").alias("n"), (metrics.homopolymer_at_most(F.col("out"), 3) & clear).alias("ok"))


_CODON_MAP = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in codon.CODONS.items()) + "}"
_AA = f"list_transform(list_transform(range(0, length(seq) // 3), lambda i: substr(seq, i * 3 + 1, 3)), lambda c: {_CODON_MAP}[c])"
_AA_SQL = f"CASE WHEN len(list_filter({_AA}, lambda x: x IS NULL)) = 0 THEN array_to_string({_AA}, '') END AS aa"
scalar("s10_translate_dna", base.coding, lambda: {"aa": codon.translate(S())}, _AA_SQL)
scalar("s11_translate_rna", base.coding, lambda: {"aa": codon.translate(F.translate(S(), "T", "U"), rna=True)}, _AA_SQL)
_VALID = "regexp_full_match(aa, '[ACDEFGHIKLMNPQRSTVWY]+')"
scalar("s12_reverse_translate", base.proteins, lambda: {"ok": F.coalesce(codon.translate(codon.reverse_translate(F.col("aa"), F.col("id"))) == F.col("aa"), F.lit(False)), "n": F.length(codon.reverse_translate(F.col("aa"), F.col("id"), 1, True))}, f"{_VALID} AS ok, CASE WHEN {_VALID} THEN 3 * length(aa) END AS n")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    own = base.records(spark, d).where("seq is not null and info.gb_division is not null").select("id", F.col("info.gb_division").alias("division"), F.translate(F.upper(F.regexp_replace("seq", r"[\s\d]+", "")), "U", "T").alias("seq"))
    phased = own.withColumn("seq", F.regexp_replace(F.regexp_replace("seq", "(...)", "$1."), "[^.]*[^ACGT.][^.]*|[^.]{1,2}$", ""))
    return codon.codon_usage(phased.withColumn("seq", F.replace("seq", F.lit("."), F.lit(""))), "id", "seq", "division")


_USAGE = f"""
, frames AS (SELECT info.gb_division AS division, replace(upper(regexp_replace(seq, '[\\s\\d]', '', 'g')), 'U', 'T') AS s FROM recs WHERE seq IS NOT NULL AND info.gb_division IS NOT NULL),
codons AS (SELECT division, substr(s, (i * 3 + 1)::INT, 3) AS codon FROM frames, unnest(range(0, length(s) // 3)) AS r(i)),
counted AS (SELECT division, codon, {_CODON_MAP}[codon] AS aa, count(*) AS n FROM codons WHERE regexp_full_match(codon, '[ACGT]{{3}}') GROUP BY ALL),
usage AS (SELECT *, n / sum(n) OVER (PARTITION BY division, aa) AS freq FROM counted)
"""


@query("a6_codon_frequencies", _USAGE + "SELECT division, codon, aa, n, round(freq, 6) AS freq FROM usage")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).withColumn("freq", F.round("freq", 6))


@query("a7_frequent_codons", _USAGE + "SELECT division, aa, codon, round(freq, 6) AS freq FROM usage QUALIFY row_number() OVER (PARTITION BY division, aa ORDER BY freq DESC, codon) = 1")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return codon.frequent_codons(_usage(spark, d), "division").withColumn("freq", F.round("freq", 6))


@query("a8_codons_above_threshold", _USAGE + "SELECT division, aa, codon, round(freq, 6) AS freq FROM usage WHERE freq > 0.3 UNION ALL SELECT division, aa, NULL, NULL FROM usage GROUP BY division, aa HAVING max(freq) <= 0.3")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return codon.above_threshold(_usage(spark, d), "division", 0.3).withColumn("freq", F.round("freq", 6))


@query("s13_weighted_reverse_translate", f"SELECT id, {_VALID} AS ok FROM proteins")
def s13(spark: SparkSession, d: str) -> DataFrame:
    out = codon.weighted_reverse_translate(F.col("aa"), F.col("id"), _usage(spark, d), "division", "BCT")
    return base.proteins(spark, d).select("id", F.coalesce(codon.translate(out) == F.col("aa"), F.lit(False)).alias("ok"))


@query("s14_frequent_reverse_translate", _USAGE + f"""
, best AS (SELECT aa, codon FROM usage WHERE division = 'BCT' QUALIFY row_number() OVER (PARTITION BY aa ORDER BY freq DESC, codon) = 1),
spelled AS (SELECT p.id, i, b.codon FROM proteins p, unnest(range(1, length(aa) + 1)) AS r(i) LEFT JOIN best b ON b.aa = substr(p.aa, i::INT, 1))
SELECT id, CASE WHEN count(codon) = count(*) THEN string_agg(codon, '' ORDER BY i) END AS dna FROM spelled GROUP BY id""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return base.proteins(spark, d).select("id", codon.weighted_reverse_translate(F.col("aa"), F.col("id"), _usage(spark, d), "division", "BCT", best_only=True).alias("dna"))


V = lambda: bits.seq_to_int(R())
scalar("b1_seq_to_int", base.oligos_of("seq_r"), lambda: {"v": V()}, f"{code_sql('seq_r')} AS v")
scalar("b2_int_to_seq", base.oligos_of("seq_r"), lambda: {"s": bits.int_to_seq(V(), F.length(R()))}, "seq_r AS s")
scalar("b3_int_complement", base.oligos_of("seq_r"), lambda: {"v": bits.int_complement(V(), F.length(R()))}, f"{code_sql(chr(116) + 'ranslate(seq_r, ' + repr('ACGT') + ', ' + repr('TGCA') + ')')} AS v")
scalar("b4_int_reverse_complement", base.oligos_of("seq_r"), lambda: {"v": bits.int_reverse_complement(V(), F.length(R()))}, f"{code_sql(rc_sql('seq_r'))} AS v")
scalar("b5_int_reverse", base.oligos_of("seq_r"), lambda: {"v": bits.int_reverse(V(), F.length(R()))}, f"{code_sql('reverse(seq_r)')} AS v")
scalar("b6_add_base", base.oligos_of("seq_r"), lambda: {"v": bits.add_base(V(), F.lit("G"))}, f"{code_sql('(seq_r || ' + repr('G') + ')')} AS v")
scalar("b7_remove_base", base.oligos_of("seq_r"), lambda: {"v": bits.remove_base(V())}, f"{code_sql('left(seq_r, length(seq_r) - 1)')} AS v")
scalar("b8_add_to_window", base.oligos_of("seq_r"), lambda: {"v": bits.add_to_window(V(), F.lit("G"), F.length(R()))}, f"{code_sql('(substr(seq_r, 2) || ' + repr('G') + ')')} AS v")
scalar("b9_int_substring", base.oligos_of("seq_r"), lambda: {"v": bits.int_substring(V(), 5, 15, F.length(R())), "wide": bits.int_substring(V(), 5, 15, F.length(R()), True)}, f"{code_sql('substr(seq_r, 6, 10)')} AS v, {code_sql('left(seq_r, 15)')} AS wide")

_GC = "length(regexp_replace(seq, '[^GC]', '', 'g'))"
_OWN = "regexp_replace(seq, '[^ACGT]', '', 'g')"


def _run(x: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({_OWN}, '[{x}]+'), lambda y: length(y))), 0)"


scalar("pm1_gc_content", base.contigs, lambda: {"gc": F.round(metrics.gc_content(S()), 6)}, f"round({_GC} / nullif(length(seq), 0), 6) AS gc")
scalar("pm2_max_runs", base.contigs, lambda: {"runs": metrics.max_runs(S())}, "[" + ", ".join(_run(x) for x in ("A", "C", "G", "T", "AT", "GC")) + "] AS runs")
scalar("pm3_runs_within", base.oligos_of("seq"), lambda: {"ok": metrics.runs_within(S(), 3, 3, 3, 3, 7, 7)}, " AND ".join(f"{_run(x)} <= {n}" for x, n in (("A", 3), ("T", 3), ("G", 3), ("C", 3), ("AT", 7), ("GC", 7))) + " AS ok")


@query("pm4_gc_window", """, gw AS (SELECT id, length(seq) AS n, o, length(regexp_replace(substr(seq, o::INT + 1, 20), '[^GC]', '', 'g')) AS gc FROM oligos, unnest(range(0, length(seq) - 19)) AS r(o)),
bad AS (SELECT id, min(o) AS o FROM gw WHERE gc < 30 * n // 100 // 1 - 19 OR gc > 18 GROUP BY id)
SELECT g.id, b.o IS NULL AS passed, g.o::INT AS start, g.gc::INT AS gc FROM gw g LEFT JOIN bad b ON b.id = g.id WHERE g.o = coalesce(b.o, g.n - 20)""")
def pm4(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of a 90-letter probe: 30 percent less what the window lacks, so that windows of 20 can meet them."""
    w = metrics.gc_window(S(), 9, 20, 20)
    return base.oligos(spark, d, "seq").select("id", w.alias("w")).select("id", "w.passed", "w.start", "w.gc")


scalar("pm5_gc_between", base.oligos_of("seq"), lambda: {"ok": metrics.gc_between(S(), 0.4, 0.5)}, f"({_GC} / length(seq)) BETWEEN 0.4 AND 0.5 AS ok")
scalar("pm6_gc_at_run", base.oligos_of("seq"), lambda: {"gc": metrics.run_at_most(S(), "GC", 6), "at": metrics.run_at_most(S(), "AT", 6)}, "NOT regexp_matches(seq, '[GC]{7}') AS gc, NOT regexp_matches(seq, '[AT]{7}') AS at")
scalar("pm7_homopolymer", base.oligos_of("seq"), lambda: {"ok": metrics.homopolymer_at_most(S(), 3)}, "NOT regexp_matches(seq, 'A{4}|C{4}|G{4}|T{4}|N{4}') AS ok")
scalar("pm8_max_run", base.oligos_of("seq"), lambda: {"ok": metrics.max_run_within(S(), {"A": 3, "C": 2, "G": 0, "GC": 7}), "compat": metrics.max_run_within(S(), {"A": 3, "C": 2, "G": 0, "GC": 7}, True)}, "NOT regexp_matches(seq, 'A{4}|C{3}|[GC]{8}') AS ok, NOT regexp_matches(seq, 'A{5}|C{4}|[GC]{9}') AS compat")


@query("pm9_agreement_check", """, agree AS (SELECT o.id, list_max(list_transform(regexp_extract_all(array_to_string(list_transform(range(1, 6), lambda i: CASE WHEN substr(o.barcode, i, 1) = substr(b.barcode, i, 1) THEN '1' ELSE '0' END), ''), '1+'), lambda x: length(x))) AS m FROM oligos o, bars b)
SELECT id, max(coalesce(m, 0)) <= 4 AS ok FROM agree GROUP BY id""")
def pm9(spark: SparkSession, d: str) -> DataFrame:
    return similarity.agreement_check(base.oligos(spark, d, "barcode"), "id", "barcode", base.barcodes(spark, d), 4)


scalar("pm13_hamming", base.oligos_of("seq_l", "seq_r"), lambda: {"hd": metrics.hamming(L(), R()), "packed": metrics.hamming_packed(bits.seq_to_int(L()), bits.seq_to_int(R()))}, "hamming(seq_l, seq_r)::INT AS hd, hamming(seq_l, seq_r)::INT AS packed")


@query("pm14_min_hamming", "SELECT o.id, min(hamming(o.barcode, b.barcode))::INT AS hd FROM oligos o, bars b GROUP BY o.id")
def pm14(spark: SparkSession, d: str) -> DataFrame:
    return similarity.nearest(base.oligos(spark, d, "barcode"), "id", "barcode", base.barcodes(spark, d))


_ROLL = "list_transform(range(0, length(seq) - length(barcode) + 1), lambda o: hamming(barcode, substr(seq, o + 1, length(barcode)))::INT)"
scalar("pm15_rolling_hamming", base.oligos_of("seq", "barcode"), lambda: {"hds": metrics.rolling_hamming(F.col("barcode"), S())}, f"{_ROLL} AS hds")
scalar("pm16_min_placed_hamming", base.oligos_of("seq", "barcode"), lambda: {"hd": metrics.min_hamming(F.col("barcode"), S())}, f"list_min({_ROLL}) AS hd")
_BOTH = "hamming(seq_l, seq_r) > 12 AND hamming(seq_l, reverse(seq_r)) > 12"
scalar("pm18_hamming_both_ways", base.oligos_of("seq_l", "seq_r"), lambda: {"ok": metrics.hamming_both_ways(L(), R(), 12)}, f"{_BOTH} AS ok")
scalar("pm19_hamming_3p", base.oligos_of("seq_l", "seq_r"), lambda: {"ok": metrics.hamming_and_3p(L(), R(), 12)}, f"{_BOTH} AND right(seq_l, 3) <> right(seq_r, 3) AND right(seq_l, 3) <> reverse(left(seq_r, 3)) AND reverse(left(seq_l, 3)) <> right(seq_r, 3) AS ok")
scalar("pm20_gc_clamps", base.oligos_of("seq_l", "seq_r"), lambda: {"r": metrics.right_arm_clamp(R()), "l": metrics.left_arm_clamp(L())}, "length(regexp_replace(right(seq_r, 5), '[^GC]', '', 'g')) AS r, length(regexp_replace(left(seq_l, 5), '[^GC]', '', 'g')) AS l")

_H = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in thermo.ENTHALPY.items()) + "}"
_E = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in thermo.ENTROPY.items()) + "}"


def tm_sql(c: str) -> str:
    """The melting temperature of an A, C, G, T string."""
    pairs = lambda table: f"list_sum(list_transform(range(1, length({c})), lambda i: {table}[substr({c}, i, 2)]))"
    ends, sym = f"((left({c}, 1) IN ('A', 'T'))::INT + (right({c}, 1) IN ('A', 'T'))::INT)", f"({c} = {rc_sql(c)})"
    dh = f"(-100.0 * ({pairs(_H)} - 23 * {ends} - (2 - {ends})))"
    ds = f"(-0.1 * ({pairs(_E)} - 41 * {ends} + 28 * (2 - {ends}) + CASE WHEN {sym} THEN 14 ELSE 0 END) + 0.368 * (length({c}) - 1) * ln(0.05))"
    return f"({dh} / ({ds} + 1.987 * ln(50 / CASE WHEN {sym} THEN 1e9 ELSE 4e9 END)) - 273.15)"


@query("t1_kelvin", "SELECT hit_id AS id, loaded_at, round(left_tm + 273.15, 6) AS k, round(left_tm, 6) AS c FROM padlock_hits WHERE isfinite(left_tm)")
def t1(spark: SparkSession, d: str) -> DataFrame:
    h = base.table(spark, d, "padlock_hits").where("not isnan(left_tm) and abs(left_tm) < double('Infinity')")
    return h.select(F.col("hit_id").alias("id"), "loaded_at", F.round(thermo.c_to_k(F.col("left_tm")), 6).alias("k"), F.round(thermo.k_to_c(thermo.c_to_k(F.col("left_tm"))), 6).alias("c"))


_DG = "SELECT id, {x} FROM (SELECT hit_id AS id, loaded_at, report.tm_hetero_0 * 100 AS dg, report.tm_hetero_1 AS ds, report.tm_hetero_2 AS dh FROM padlock_hits WHERE isfinite(report.tm_hetero_0) AND isfinite(report.tm_hetero_1) AND isfinite(report.tm_hetero_2))"


def _energies(spark: SparkSession, d: str) -> DataFrame:
    h = base.table(spark, d, "padlock_hits").select(F.col("hit_id").alias("id"), (F.col("report.tm_hetero_0") * 100).alias("dg"), F.col("report.tm_hetero_1").alias("ds"), F.col("report.tm_hetero_2").alias("dh"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return h.where(finite(F.col("dg")) & finite(F.col("ds")) & finite(F.col("dh")))


@query("t2_association", _DG.format(x="round(ln(exp(-dg / (1.987 * (37 + 273.15)))), 6) AS ln_ka"))
def t2(spark: SparkSession, d: str) -> DataFrame:
    return _energies(spark, d).select("id", F.round(F.log(thermo.association(F.col("dg"), F.lit(37.0))), 6).alias("ln_ka"))


@query("t3_free_energy", _DG.format(x="round(dh - ds * (37 + 273.15), 6) AS dg"))
def t3(spark: SparkSession, d: str) -> DataFrame:
    return _energies(spark, d).select("id", F.round(thermo.free_energy(F.col("ds"), F.col("dh"), F.lit(37.0)), 6).alias("dg"))


@query("t4_random_coil", _DG.format(x="round(1 / (exp(-dg / (1.987 * (37 + 273.15))) + 1), 6) AS p"))
def t4(spark: SparkSession, d: str) -> DataFrame:
    return _energies(spark, d).select("id", F.round(thermo.random_coil(F.col("dg"), F.lit(37.0)), 6).alias("p"))


@query("t5_divalent_to_monovalent", _DG.format(x="round(CASE WHEN abs(ds) = 0 OR abs(ds) < 0.8 THEN 0 ELSE 120 * sqrt(abs(ds) - 0.8) END, 6) AS mono"))
def t5(spark: SparkSession, d: str) -> DataFrame:
    return _energies(spark, d).select("id", F.round(thermo.divalent_to_monovalent(F.abs("ds"), F.lit(0.8)), 6).alias("mono"))


_NN = f"""SELECT id, seq_l, list_sum(list_transform(range(1, length(seq_l)), lambda i: {_H}[substr(seq_l, i, 2)])) AS h, list_sum(list_transform(range(1, length(seq_l)), lambda i: {_E}[substr(seq_l, i, 2)])) AS e,
  (left(seq_l, 1) IN ('A', 'T'))::INT + (right(seq_l, 1) IN ('A', 'T'))::INT AS ends, seq_l = {rc_sql('seq_l')} AS sym FROM oligos WHERE regexp_full_match(seq_l, '[ACGT]+')"""
_TH = f"""SELECT id, seq_l, -100.0 * (h - 23 * ends - (2 - ends)) AS dh, -0.1 * (e - 41 * ends + 28 * (2 - ends) + CASE WHEN sym THEN 14 ELSE 0 END) + 0.368 * (length(seq_l) - 1) * ln(0.05) AS ds, sym FROM ({_NN})"""


@query("t6_thermo", f"SELECT id, round(dh, 4) AS dh, round(ds, 4) AS ds, round(dh / (ds + 1.987 * ln(50 / CASE WHEN sym THEN 1e9 ELSE 4e9 END)) - 273.15, 4) AS tm FROM ({_TH})")
def t6(spark: SparkSession, d: str) -> DataFrame:
    t = base.oligos(spark, d, "seq_l").select("id", thermo.thermo(F.col("seq_l")).alias("t")).where("t is not null")
    return t.select("id", *[F.round(f"t.{c}", 4).alias(c) for c in ("dh", "ds", "tm")])


@query("t7_melting_temperature", f"SELECT id, round(dh / (ds + 1.987 * ln(50 / CASE WHEN sym THEN 1e9 ELSE 4e9 END)) - 273.15, 4) AS tm FROM ({_TH})")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq_l").select("id", F.round(thermo.melting_temperature(F.col("seq_l")), 4).alias("tm")).where("tm is not null")


_TAILS = f"""tails AS (SELECT DISTINCT id, right(seq_l, n::INT) AS t FROM oligos, unnest(range(4, 9)) AS r(n) WHERE length(seq_l) >= n AND contains({rc_sql("seq_r")}, right(seq_l, n::INT))),
one AS (SELECT t, {tm_sql("t")} AS tm FROM (SELECT DISTINCT t FROM tails WHERE regexp_full_match(t, '[ACGT]+')))"""


@query("t8_heterodimer_proxy", f", {_TAILS} SELECT o.id, round(greatest(0, coalesce(max(tm), 0)), 4) AS tm FROM oligos o LEFT JOIN tails t ON t.id = o.id LEFT JOIN one USING (t) GROUP BY o.id")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq_l", "seq_r").select("id", F.round(thermo.heterodimer_proxy(L(), R()), 4).alias("tm"))
