"""Column functions against plain Python and known values."""

import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.functions import bits, codon, metrics, seq, thermo

RC = str.maketrans("ACGT", "TGCA")


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}").select("i", expr.alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choices("ACGT", k=rng.randint(2, 30))) for _ in range(200)]


def test_strings(spark):
    s = ["ATGCRYKMBVDHNatgcryU\n", "", None, "A!x"]
    assert column(spark, s, seq.complement(F.col("s"))) == ["TACGYRMKVBHDNtacgyrA\n", "", None, "T??"]
    assert column(spark, ["acgTN"], seq.simple_reverse_complement(F.col("s"))) == ["NACGT"]
    assert column(spark, ["ACGTACGTAC", "", None, "ACGT"], seq.hard_wrap(F.col("s"), 4)) == ["ACGT\nACGT\nAC", "", None, "ACGT"]


def test_random_sequences_are_stable(spark):
    a = column(spark, ["x", "y"], seq.random_sequence(F.col("s"), 40, 3, {"A": 0.5, "T": 0.5}))
    assert a == column(spark, ["x", "y"], seq.random_sequence(F.col("s"), 40, 3, {"A": 0.5, "T": 0.5}))
    assert a[0] != a[1] and set("".join(a)) == {"A", "T"}


def test_packed_integers(spark, words):
    code = lambda w: int("0" + w.translate(str.maketrans("ACGT", "0123")), 4)
    v = bits.seq_to_int(F.col("s"))
    n = F.length("s")
    assert column(spark, ["ATGGC", "atggc", ""], v) == [233, 233, 0]
    assert column(spark, words, v) == [code(w) for w in words]
    assert column(spark, words, bits.int_to_seq(v, n)) == words
    assert column(spark, words, bits.int_reverse(v, n)) == [code(w[::-1]) for w in words]
    assert column(spark, words, bits.int_reverse_complement(v, n)) == [code(w.translate(RC)[::-1]) for w in words]
    assert column(spark, words, bits.int_substring(v, 1, 2, n)) == [code(w[1:2]) for w in words]
    assert column(spark, words, bits.add_to_window(v, F.lit("t"), n)) == [code(w[1:] + "T") for w in words]
    with pytest.raises(Exception, match="more than 30"):
        column(spark, ["A" * 31], v)


def test_translation(spark):
    assert column(spark, ["TTTTTCAGT", "", None, "TTTT", "NNN"], codon.translate(F.col("s"))) == ["FFS", "", None, None, None]
    assert column(spark, ["UUUUUCAGU"], codon.translate(F.col("s"), rna=True)) == ["FFS"]
    with pytest.raises(Exception, match="unknown codon"):
        column(spark, ["TTTT"], codon.translate(F.col("s"), strict=True))
    every = "ACDEFGHIKLMNPQRSTVWY*"
    assert column(spark, [every], codon.translate(codon.reverse_translate(F.col("s"), F.col("i")))) == [every]


def test_metrics(spark):
    ok = lambda s, *a: column(spark, [s], metrics.runs_within(F.col("s"), *a))[0]
    assert ok("AATTGGCC", 2, 2, 2, 2, 4, 4) and not ok("AAATGC", 2, 9, 9, 9, 9, 9)
    assert column(spark, ["AANAAT", "", None], metrics.max_runs(F.col("s"))) == [[4, 0, 0, 1, 5, 0], [0] * 6, None]
    assert column(spark, ["GGCC", "", None], metrics.gc_content(F.col("s"))) == [1.0, None, None]
    assert column(spark, ["ATAT", "ACGT"], metrics.hamming(F.col("s"), F.lit("ATAA"))) == [1, 3]
    assert column(spark, ["ATA"], metrics.hamming(F.col("s"), F.lit("AT"))) == [None]
    assert column(spark, ["AC"], metrics.rolling_hamming(F.col("s"), F.lit("GACG"))) == [[2, 0, 2]]
    assert column(spark, ["AC"], metrics.rolling_hamming(F.col("s"), F.lit("GACG"), 1)) == [[1, 2, 0, 2, 1]]
    assert column(spark, ["ACGTA"], metrics.min_hamming(F.col("s"), F.lit("AC"))) == [100000]


def test_gc_window_against_counting(spark, words):
    got = column(spark, words, metrics.gc_window(F.col("s"), 10, 40, 5))
    for w, g in zip(words, got):
        if len(w) < 5:
            assert g["passed"] is None
            continue
        n = [sum(c in "GC" for c in w[i : i + 5]) for i in range(len(w) - 4)]
        bad = [i for i, x in enumerate(n) if not 10 * len(w) // 100 <= x <= 40 * len(w) // 100]
        at = bad[0] if bad else len(n) - 1
        assert (g["passed"], g["start"], g["gc"]) == (not bad, at, n[at])


def test_thermo_agrees_with_python(spark, words):
    got = column(spark, words, F.round(thermo.melting_temperature(F.col("s")), 6))
    assert got == [round(thermo.tm_of(w), 6) for w in words]
    assert column(spark, ["ACGN", "A", None], thermo.melting_temperature(F.col("s"))) == [None, None, None]


def test_weighted_codons_follow_the_usage(spark):
    """Of 4,000 draws for one residue each codon has its share, within four standard deviations; a rare codon below the threshold none."""
    usage = spark.createDataFrame([("x", "L", "CTG", 0.6), ("x", "L", "TTA", 0.3), ("x", "L", "CTC", 0.1), ("x", "M", "ATG", 1.0), ("y", "L", "CTT", 1.0)], "g string, aa string, codon string, freq double")
    df = spark.createDataFrame([(i, "LM" * 100) for i in range(40)] + [(99, "LW"), (98, None)], "id int, aa string")

    def drawn(threshold):
        out = codon.weighted_reverse_translate(F.col("aa"), F.col("id"), usage, "g", "x", threshold)
        return {r["id"]: r["d"] for r in df.select("id", out.alias("d")).collect()}

    got = drawn(0.0)
    assert got[99] is None and got[98] is None
    words = [got[i][a : a + 3] for i in range(40) for a in range(0, 600, 3)]
    n = {c: words.count(c) for c in set(words)}
    assert n.pop("ATG") == 4000 and set(n) == {"CTG", "TTA", "CTC"}
    for c, p in (("CTG", 0.6), ("TTA", 0.3), ("CTC", 0.1)):
        assert abs(n[c] - 4000 * p) < 4 * (4000 * p * (1 - p)) ** 0.5
    assert len({got[i] for i in range(40)}) == 40
    some = "".join(drawn(0.2)[i] for i in range(40))
    assert {some[a : a + 3] for a in range(0, len(some), 3)} == {"CTG", "TTA", "ATG"}


def test_functions_in_sql(spark):
    from nucleoframe.common import bare_id
    from nucleoframe.functions import bits, metrics, sql
    from nucleoframe.operators import kmers

    assert len(sql.register(spark)) == len(sql.register(spark)) == len(sql.FUNCTIONS)
    df = spark.createDataFrame([("ACGTTGCA", "ACGATGCC"), ("ac 1gn", "acgt"), ("", ""), (None, "A"), (" x:ENST1.2 ", "q")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        F.expr("seq_reverse_complement(a)"), F.expr("seq_gc_content(a)"), F.expr("seq_to_int(a)"), F.expr("seq_words(a, 3)"), F.expr("bare_transcript_id(a)"), F.expr("seq_letters(a)"),
        seq.simple_reverse_complement(a), metrics.gc_content(a), bits.seq_to_int(a), kmers.word_list(a, 3), bare_id(a), F.regexp_replace(a, r"[\s\d]+", ""),
    ).collect()
    for r in got:
        x, y = tuple(r)[:6], tuple(r)[6:]
        assert x[0] == y[0] and x[1] == y[1] and x[2] == y[2] and x[4:] == y[4:] and [w.upper() for w in x[3] or []] == (y[3] or [])
    assert [r[0] for r in df.select(F.expr("seq_hamming(a, b)")).collect()] == [2, None, 0, None, None]
