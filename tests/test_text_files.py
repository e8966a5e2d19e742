"""Text layout, feature lists, position sets, gene-wise design, data sets: against brute force and known values."""

import json
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from nucleoframe.functions import text
from nucleoframe.operators import genes, padlock, records, regions, restriction
from nucleoframe.sources import genbank, tables


def test_lines_against_the_standard_library(spark):
    rng = random.Random(1)
    pool = ["a", "bb", " ", "  ", "\n", "\t", "longword", "x$\\y", "é"]
    ts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(300)] + ["", " ", "\n", "a" * 50, "a " + "b" * 50]
    df = spark.createDataFrame([*enumerate(ts), (999, None)], "i int, t string")
    t = F.col("t")
    got = df.select(
        "t", text.soft_wrap(t, 12).alias("a"), text.soft_wrap(t, 12, "* ", "    ").alias("b"), text.soft_wrap(t, 12, "$ ", "$ ").alias("c"), text.soft_wrap(t, 12, break_long=True).alias("d"),
        text.shortened(t, 15).alias("e"), text.dedented(t).alias("f"), text.indented(t, "$> ").alias("g"),
    )
    for r in got.collect():
        if r["t"] is None:
            assert all(x is None for x in r[1:])
            continue
        line = " ".join(r["t"].split())
        fill = lambda **kw: textwrap.fill(line, 12, break_on_hyphens=False, **kw)
        want = (
            fill(break_long_words=False), fill(break_long_words=False, initial_indent="* ", subsequent_indent="    "), fill(break_long_words=False, initial_indent="$ ", subsequent_indent="$ "),
            fill(), textwrap.shorten(line, 15, break_long_words=False, break_on_hyphens=False), textwrap.dedent(r["t"]), textwrap.indent(r["t"], "$> "),
        )
        assert tuple(r[1:]) == want, r["t"]
    with pytest.raises(ValueError):
        text.soft_wrap(t, 2, "  ")


def test_features_are_inserted_and_removed(spark):
    f = spark.createDataFrame([(1, 5, 9, "gene", "a"), (1, 5, 9, "gene", "a"), (1, 2, 3, None, "b"), (2, None, None, "x", None)], "id int, start int, end int, type string, location string")
    new = spark.createDataFrame([(1, 5, 8, "new", "c"), (3, 1, 1, "new", "d")], "id int, start int, end int, type string, location string")
    got = {(r["id"], r["feature_no"]): (r["start"], r["type"]) for r in records.insert_features(f, new, "id").collect()}
    assert got == {(1, 1): (2, None), (1, 2): (5, "new"), (1, 3): (5, "gene"), (1, 4): (5, "gene"), (2, 1): (None, "x"), (3, 1): (1, "new")}
    gone = spark.createDataFrame([(1, 5, 9, "gene", "a"), (1, 2, 3, None, "b"), (2, None, None, "x", None), (9, 1, 1, "gene", "a")], f.schema)
    assert [tuple(r) for r in records.remove_features(f, gone, "id").collect()] == [(1, 5, 9, "gene", "a")]
    assert [r["id"] for r in records.absent_features(f, gone, "id").collect()] == [9]
    assert {(r["id"], r["type"]): r["n"] for r in records.features_by_type(f, "id").collect()} == {(1, "gene"): 2, (1, None): 1, (2, "x"): 1}
    assert records.remove_features(f.limit(0), gone, "id").count() == 0


def test_position_difference_against_sets(spark):
    rng = random.Random(4)
    have = [(rng.choice("ab"), a, a + rng.randint(-9, 9)) for a in (rng.randint(0, 60) for _ in range(12))]
    gone = [(rng.choice("abc"), a, a + rng.randint(-3, 3)) for a in (rng.randint(0, 60) for _ in range(15))]
    schema = "k string, s long, e long"
    got = regions.position_difference(spark.createDataFrame([*have, ("a", None, 3)], schema), spark.createDataFrame([*gone, ("a", 5, None)], schema), "k", "s", "e").collect()
    for k in "ab":
        want = {p for x, s, e in have if x == k for p in range(min(s, e), max(s, e) + 1)} - {p for x, s, e in gone if x == k for p in range(min(s, e), max(s, e) + 1)}
        runs = [(r["lo"], r["hi"]) for r in got if r["k"] == k]
        assert sorted(p for lo, hi in runs for p in range(lo, hi)) == sorted(want)
        assert not {lo for lo, _ in runs} & {hi for _, hi in runs}


GENES = "id string, display_name string, strand int, start long, end long, Transcript array<struct<id: string, is_canonical: int, strand: int, start: long, end: long, Exon: array<struct<id: string, start: long, end: long>>>>"


def test_segments_and_probes_of_genes(spark):
    rng = random.Random(7)
    seqs = {e: "".join(rng.choices("ACGT", weights=(3, 2, 2, 3), k=n)) for e, n in (("e1", 30), ("e2", 400), ("e4", 400), ("e5", 400))}
    seqs["e6"] = "GGCTACAGCA" * 30  # too much G and C at first
    exon = lambda e, a: (e, a, a + len(seqs[e]) - 1)
    rows = [
        ("g1", "G1", 1, 1, 2000, [("t0", 0, 1, 1, 900, [exon("e1", 1)]), ("t1", 1, 1, 1, 2000, [exon("e1", 1), exon("e2", 1001)])]),
        ("g2", "G2", -1, 1, 2000, [("t2", 1, -1, 1, 2000, [exon("e1", 1501), exon("e4", 1001)])]),
        ("g3", "G3", 1, 1, 9, None), ("g4", "G4", 1, 1, 9, [("t4", 1, 1, 1, 9, [])]), ("g5", "G5", 1, 1, 9, [("t5", 0, 1, 1, 9, [exon("e5", 1)])]),
        ("g6", "G6", 1, 1, 400, [("t6", 1, 1, 1, 400, [exon("e6", 1)])]),
    ]
    gone = {"t1": [(1101, 1102), (1130, 1130)], "t2": [(1341, 1350), (1030, 1020)]}
    G = spark.createDataFrame(rows, GENES)
    V = spark.createDataFrame([(t, a, b) for t, v in gone.items() for a, b in v], "parent string, start long, end long")
    S = spark.createDataFrame([*seqs.items()], "exon_id string, seq string")

    def brute(t, e, start, forward):
        n = len(seqs[e])
        place = [start + i for i in range(n)] if forward else [start + n - 1 - i for i in range(n)]
        out = {p for a, b in gone.get(t, []) for p in range(min(a, b), max(a, b) + 1)}
        runs, now = [], []
        for i, p in enumerate(place):
            if p in out:
                runs, now = runs + [now], []
            else:
                now.append((p, seqs[e][i]))
        runs = [r for r in [*runs, now] if r]
        bound, at, kept = sum(map(len, runs)) - 10, 0, []
        for r in runs:
            own = r if at + len(r) <= bound else r[: max(0, bound - at)]
            if len(r) > 40 and len(own) >= 40:
                kept.append((min(p for p, _ in own), "".join(c for _, c in own)))
            at += len(r)
        return kept

    segments = padlock.target_segments(G, V, "parent", S)
    got = {(r["gene_id"], r["transcript_id"], r["exon_id"], r["strand_dir"], r["genome_idx"], r["seq"]) for r in segments.collect()}
    want = {(g, t, e, d, *x) for g, t, e, d, a in (("g1", "t1", "e2", "fwd", 1001), ("g2", "t2", "e4", "rev", 1001), ("g6", "t6", "e6", "fwd", 1)) for x in brute(t, e, a, d == "fwd")}
    assert got == want and len(want) > 4
    screen = padlock.Screen(tm_min=40, gc_min=0.3, gc_max=0.55, structure_max=60)
    probes = padlock.design_for_genes(segments, "TCTAC{barcode}ACC", ["AACCA", "ACCGG"], screen).collect()
    by_gene = {g: [p for p in probes if p["gene_id"] == g] for g in ("g1", "g2", "g6")}
    assert all(by_gene.values()) and {p["relaxed"] for p in by_gene["g6"]} == {True} and not any(p["relaxed"] for g in ("g1", "g2") for p in by_gene[g])
    for p in probes:
        own = next(x for x in want if x[0] == p["gene_id"] and x[4] == p["genome_idx"])
        at = own[5][p["idx"] : p["idx"] + 40]
        assert at == p["seq_l"] + p["seq_r"] and p["padlock_seq"] == p["seq_r"] + p["scaffold"] + p["seq_l"] and p["barcode"] in p["scaffold"]
    assert padlock.design_for_genes(segments.limit(0), "A{barcode}", ["A"]).count() == 0


def test_typed_views(spark):
    r = genes.typed(spark.createDataFrame([("a", 5, 2, -1, "X"), ("b", 1, 2, 1, "7"), ("c", None, None, None, None)], "id string, start long, end long, strand int, seq_region_name string")).collect()
    assert [(tuple(x["idxs"]), x["is_fwd"], x["is_rev"], x["chromosome"]) for x in r] == [((5, 2), False, True, None), ((1, 2), True, False, 7), ((None, None), None, None, None)]


def test_enzyme_data_set(spark, tmp_path):
    text_ = "".join(f"<1>{n}\n<2>\n<3>x\n<4>y\n<5>{s}\n<6>\n<7>{a}\n<8>1,2\n\n" for n, s, a in (("EcoRI", "G^AATTC", "BC"), ("BsaI", "GGTCTC(1/5)", "N"), ("BaeI", "(10/15)ACNNNNGTAYC(12/7)", ""), ("Odd", "?", "N"), ("Two", "A^T,GGATG(9/13)", "N")))
    rows = tables.parse_enzyme_records(spark.createDataFrame([(text_,)], "t string"), "t")
    assert rows.where("name = 'Two'").select("sites").first()[0] == "A^T,GGATG(9/13)"
    built = restriction.build_enzyme_dataset(rows, "name", "sites", "availability", str(tmp_path / "d"))
    assert {(r["enzyme"], r["cutsite_no"]): r["cut_fwd"] for r in built.collect()} == {("EcoRI", 0): [1], ("BsaI", 0): [7], ("BaeI", 0): [5, 38], ("Odd", 0): [], ("Two", 0): [1], ("Two", 1): [14]}
    assert {r["name"]: (r["organism"], r["availability"]) for r in rows.collect()}["EcoRI"] == ("x", "BC")


def test_codon_usage_files(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"one": {"F": {"TTT": 0.25, "TTC": 0.75}, "M": {"ATG": 1.0}}, "two": {"M": {"ATG": 1.0}}}))
    got = {(r["organism"], r["aa"], r["codon"]): r["freq"] for r in tables.read_codon_usage(spark, str(tmp_path / "u.json")).collect()}
    assert got == {("one", "F", "TTT"): 0.25, ("one", "F", "TTC"): 0.75, ("one", "M", "ATG"): 1.0, ("two", "M", "ATG"): 1.0}
    counts = spark.createDataFrame([("83333:Inventa coli K-12: 137\n1 3 0 5 \n4:Other: 1\n0 0 2 2 \n",)], "t string")
    rows = {(r["organism_id"], r["codon"]): (r["organism"], r["aa"], r["n"], r["freq"]) for r in tables.parse_codon_counts(counts, "t", ["UUU", "UUC", "AUG", "UAA"]).collect()}
    assert rows[83333, "TTC"] == ("Inventa coli K-12", "F", 3, 0.75) and rows[4, "ATG"] == ("Other", "M", 2, 1.0) and len(rows) == 8


def test_first_sequences_and_record_files(spark, tmp_path):
    fa = ">a b\nAC\nGT\n>c\nTT\n"
    df = spark.createDataFrame([("x/a.fa", fa), ("b.FASTA", ">q\r\nAC\r\nG"), ("c.txt", fa), ("d.gb", "no record"), ("e.fa", ""), ("f.fa", None)], "path string, t string")
    got = {r["path"]: r["seq"] for r in tables.first_sequences(df, "path", "t").collect()}
    assert got == {"x/a.fa": "ACGT", "b.FASTA": "ACG", "c.txt": None, "e.fa": None, "f.fa": None}
    rec = spark.createDataFrame([], genbank.SCHEMA)
    tables.to_json(rec, str(tmp_path / "e.json"))
    assert tables.from_genbank_like(spark, str(tmp_path / "e.json")).count() == 0
    with pytest.raises(ValueError):
        tables.from_genbank_like(spark, "a.txt")


def test_wrong_enzymes_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("EcoRI", "G^AATTC", "N"), ("BsaI", "GGTCTC(2/6)", "N"), ("BaeI", restriction.ENZYMES["BaeI"], None), ("None", None, None), ("Blank", " ", None)], "n string, s string, a string")
    with pytest.raises(ValueError, match="BsaI"):
        restriction.build_enzyme_dataset(rows, "n", "s", "a", str(tmp_path / "d"))
    good = restriction.build_enzyme_dataset(rows.where("n <> 'BsaI'").unionByName(spark.createDataFrame([("BsaI", "GGTCTC(1/5)", "N")], rows.schema)), "n", "s", "a", str(tmp_path / "d"))
    assert {r["enzyme"]: r["availability"] for r in good.collect()} == {"EcoRI": "N", "BsaI": "N", "BaeI": None}
    assert [s.core for s in restriction.sites_of_table(good, ["BsaI", "EcoRI"])] == ["GGTCTC", "GAATTC"]
    with pytest.raises(ValueError):
        restriction.sites_of_table(good, ["Nope"])
    assert all(restriction.parse_site(s, n).patterns() for n, s in restriction.ENZYMES.items())
