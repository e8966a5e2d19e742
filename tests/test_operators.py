"""Operators against known values and brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nucleoframe.functions.seq import reverse_complement
from nucleoframe.operators import duplex, genes, graph, kmers, padlock, records, regions, restriction, seeds, similarity
from nucleoframe.plans import strategy


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")


def test_repeats(spark):
    key = "CATTACTCTAAGTAAGCTGGTCTGTCGCCA"
    mid = "CCTTATAGTTTACGAACCAGTTATGTGATATTGCCTGATCT"
    df = frame(spark, [key + mid + key, "AAACCCCGC" + key + mid + key, "AAACCCCGC" + key + mid + key + "GGGAACCTTTA", key + mid + key + "GGGAACCTTTA", "", None])
    ends = {r["id"]: (r["five"], r["three"]) for r in kmers.screen_ends(df, "id", "seq", 8, 8).collect()}
    assert [ends[i] for i in range(4)] == [(True, True), (False, True), (False, False), (True, False)]
    got = {r["repeat"]: r["places"] for r in kmers.all_repeats(df.where("id = 0"), "id", "seq", 8).collect()}
    assert got[key] == [0, 71]
    one = frame(spark, ["GGGGAAAATGGGGAAAA"])
    assert [(r["start"], r["n"]) for r in kmers.window_counts(one, "id", "seq", 8, 17).collect()] == [(0, 1)]
    assert [r["word"] for r in kmers.window_words(one, "id", "seq", 8, 0, 17).collect()] == ["GGGGAAAA"]
    with pytest.raises(ValueError):
        kmers.repeat_index(one, "id", "seq", 32)


def maximal_repeats(s, k):
    """Brute force: all strings of a pair of occurrences that can't be lengthened on either side, with all their places."""
    same = lambda i, j: 0 <= i < len(s) > j >= 0 and s[i] == s[j] and s[i] in "ACGT"
    found = set()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            m = 0
            while same(i + m, j + m):
                m += 1
            if m >= k and not same(i - 1, j - 1):
                found.add(s[i : i + m])
    return {r: [i for i in range(len(s)) if s.startswith(r, i)] for r in found}


def test_repeats_of_words_that_occur_often(spark):
    rng = random.Random(11)
    x = "".join(rng.choices("ACGT", k=40))
    far = "T" + x + "GG" + x[:8] + "TT" + x[20:29] + "AC" + x + "C"  # parts of x lie between its two occurrences
    seqs = [far, "A" * 30, "ACG" * 15, "ACGTN" * 6, "acgtACGTacgtu" * 3, "", "AC", None]
    seqs += ["".join(rng.choices(letters, k=n)) for letters, n in (("AC", 70), ("ACGT", 300), ("AAAAACGTN", 200), ("AN", 60))]
    seqs += [x * 3 + "N" + x * 2 + far + x[5:] + "G" + x[3:30]]
    for k in (1, 3, 8, 17):
        got = {}
        for r in kmers.all_repeats(frame(spark, seqs), "id", "seq", k).collect():
            assert r["repeat"] not in got.setdefault(r["id"], {})
            got[r["id"]][r["repeat"]] = r["places"]
        for i, s in enumerate(seqs):
            assert got.get(i, {}) == maximal_repeats((s or "").upper(), k), (i, k)
    many = kmers.all_repeats(frame(spark, [far]), "id", "seq", 8).where(F.col("repeat") == x)
    assert [r["places"] for r in many.collect()] == [[1, far.rindex(x)]]


def test_word_counts_against_counting(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGTN", k=n)) for n in (0, 3, 4, 50, 300)]
    got = {(r["id"], r["word"]): r["n"] for r in kmers.word_counts(frame(spark, seqs), "id", "seq", 4).collect()}
    want = Counter((i, s[j : j + 4]) for i, s in enumerate(seqs) for j in range(len(s) - 3))
    assert got == dict(want)


def test_join_plans_agree(spark):
    rng = random.Random(5)
    refs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 9, 60, 300)]
    pick = [refs[3][i : i + 10] for i in (0, 100, 290)]
    targets = spark.createDataFrame([(str(i), t) for i, t in enumerate([*pick, "ACGTACGTAC", "ACGT", None, pick[0]])], "t string, s string")
    args = (targets, "t", "s", frame(spark, refs), "id", "seq", 10)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for k in (1, 2):
        plans = [rows(similarity.similarity_join(*args, k, how)) for how in ("blocks", "seed", "brute")]
        want = sorted(
            (str(i), j, o, d) for i, t in enumerate([*pick, "ACGTACGTAC", "", "", pick[0]]) if t for j, r in enumerate(refs) for o in range(len(r) - 9)
            if (d := sum(a != b for a, b in zip(t, r[o : o + 10]))) <= k
        )
        assert plans == [want] * 3
    assert rows(similarity.similarity_join(*args, 0)) == [x for x in rows(similarity.similarity_join(*args, 1)) if x[3] == 0]


def test_placements_beyond_the_ends(spark):
    refs = frame(spark, ["CGTACC", "A"])
    t = spark.createDataFrame([(1, "ACGT")], "t int, s string")
    got = {(r["ref_id"], r["offset"]) for r in similarity.similarity_join(t, "t", "s", refs, "id", "seq", 4, 0, overhang=3).collect()}
    assert got == {(0, -1), (1, 0)} or (0, -1) in got


def test_seeds():
    assert seeds.check_seed("#-##--#-##", 15) == 2
    assert seeds.check_seed("#-##-##-##", 15) == 1
    for (m, k), family in strategy.SEEDS.items():
        assert seeds.check_seeds(family, m, k, k) == k
    for weight, s in seeds.find_seeds(8, 1).items():
        assert s.count("#") == weight and seeds.check_seed(s, 8, 1, 2) == 1


def test_restriction_known_sites(spark):
    sites = restriction.sites_of(["EcoRI", "BsaI", "BaeI"])
    df = frame(spark, ["GAATTC", "GGTCTC", "GGTCTCGAATTC"])
    n = {(r["id"], r["enzyme"]): r["n"] for r in restriction.count_sites(df, "id", "seq", sites).collect()}
    assert [n[2, e] for e in ("EcoRI", "BsaI", "BaeI")] == [2, 1, 0] and n[0, "EcoRI"] == 2 and n[1, "BsaI"] == 0
    core = {(r["id"], r["enzyme"]): r["n"] for r in restriction.count_sites(df, "id", "seq", sites, full=False).collect()}
    assert core[1, "BsaI"] == 1
    hits = {(r["enzyme"], r["strand"], r["start_idx"], r["end_idx"]) for r in restriction.find_sites(df.where("id = 2"), "id", "seq", sites).collect()}
    assert hits == {("EcoRI", 1, 6, 12), ("EcoRI", -1, 6, 12), ("BsaI", 1, 0, 11)}
    assert restriction.site_regex("ACNNNNGTAYC", compat=True) == "AC[ATGC]{4}GTA[CG]C"
    assert restriction.parse_site("CACGAG(-5/-1)").cut_fwd == (1,) and restriction.parse_site("?").core is None
    with pytest.raises(ValueError):
        restriction.sites_of(["Nope"])
    with pytest.raises(ValueError):
        restriction.parse_site("G^A^TC")


def test_digestion(spark):
    bsai = restriction.sites_of(["BsaI"])
    df = frame(spark, ["GGTCTCGAATTCAAA", "AAAA", ""])
    got = [(r["id"], r["fragment"], r["overhang"]) for r in restriction.digest(df, "id", "seq", bsai).orderBy("id", "frag_no").collect()]
    assert got == [(0, "GGTCTCG", 0), (0, "AATTCAAA", -4), (1, "AAAA", 0), (2, "", 0)]
    ring = restriction.digest(frame(spark, ["TTTGGTCTCGAATTCAAA"]), "id", "seq", bsai, circular=True).collect()
    assert [r["fragment"] for r in ring] == ["AATTCAAATTTGGTCTCG"]


def test_duplexes(spark):
    one = spark.createDataFrame([("GGATCCAAAG", "TTTGGATCCC", 1), ("GGATCCAAA", "TTTGGATCC", 0), ("GGTCTCG", "AATTCGAGACCAAA", 3)], "f string, r string, o int")
    d = duplex.duplex(F.col("f"), F.col("r"), F.col("o"))
    rows = one.select(duplex.left_end(d).alias("l"), duplex.right_end(d).alias("e"), duplex.fits(d, d).alias("ok"), duplex.circularize(d)["fwd"].alias("c"), duplex.total_length(d).alias("n")).collect()
    assert rows[0]["l"] == ("THREE", "C") and rows[0]["e"] == ("THREE", "G") and rows[0]["ok"]
    assert rows[1]["l"][0] == "BLUNT" and rows[1]["ok"] and rows[1]["c"] == "GGATCCAAA"
    assert rows[2]["l"] == ("THREE", "AAA") and rows[2]["e"] == ("FIVE", "AATT") and not rows[2]["ok"] and rows[2]["n"] == 14


def test_locations(spark):
    parse = records.parse_spans
    assert parse("join(<4116..4193 ,\ncomplement(4204..>4274))") == [("join", None, 4115, 4192, 4), ("join>complement", None, 4203, 4273, 2)]
    assert parse("9^10") == [("", None, 8, 9, 1)] and parse("J1.2:5") == [("", "J1.2", 4, 4, 0)]
    assert parse("join(1..2") is None and parse("") is None and parse("x") is None
    loc = ["<1..206", "complement(3300..4037)", "7", "9^10", "A1.1:3..>5"]
    df = spark.createDataFrame([(x,) for x in [*loc, "join(1..2,3)", None]], "l string").withColumn("p", records.simple_location(F.col("l")))
    back = [r["t"] for r in df.select(records.location_text(F.col("p.start"), F.col("p.end"), F.col("p.flags"), F.col("p.remote"), F.col("p.is_fwd")).alias("t")).collect()]
    assert back[:5] == loc and back[5:] == [None, None]


def test_regions(spark):
    r = spark.createDataFrame([("a", 1, 20), ("b", 9, 1), ("c", 1, 5)], "k string, start long, end long")
    v = spark.createDataFrame([("a", 4, 6), ("a", 8, 5), ("a", 15, 15), ("a", 30, 40), ("c", 0, 9), ("a", None, 3)], "k string, start long, end long")
    got = sorted(tuple(x) for x in regions.permitted_regions(r, v, "k", "start", "end").collect())
    assert got == [("a", 1, 4), ("a", 9, 15), ("a", 16, 21), ("b", 1, 10)]


def test_range_join_against_brute_force(spark):
    rng = random.Random(9)
    make = lambda n: [(rng.choice("xy"), i, a := rng.randint(0, 300), a + rng.randint(0, 90)) for i in range(n)]
    q, f = make(40), make(60)
    a = spark.createDataFrame(q, "k string, q long, qs long, qe long")
    b = spark.createDataFrame(f, "k string, f long, s long, e long")
    got = sorted((r["query_id"], r["f"]) for r in regions.range_join(a, b, "k", ("q", "qs", "qe"), ("s", "e"), width=32).collect())
    assert got == sorted((x[1], y[1]) for x in q for y in f if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])


def test_cliques(spark):
    rng = random.Random(2)
    edges = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.5]
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(12)}
    found = sorted(map(tuple, graph.maximal_cliques({k: v for k, v in near.items() if v})))
    sets = [{i for i in range(12) if m >> i & 1} for m in range(1, 1 << 12)]
    full = [s for s in sets if all(b in near[a] for a in s for b in s if a < b)]
    assert found == sorted(tuple(sorted(s)) for s in full if not any(s < t for t in full))
    df = spark.createDataFrame(edges, "i long, j long")
    assert graph.triangles(df, "i", "j").count() == sum(len(s) == 3 for s in full)
    assert graph.find_cliques(df, "i", "j", 3, 2).count() == 2


def test_barcodes(spark):
    pool = graph.barcode_pool(spark, 4)
    assert pool.count() == sum(not any(b * 4 == w for b in "ACGT") and sum(c in "GC" for c in w) < 3 for w in (a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT"))
    some = graph.barcode_set(pool.orderBy("barcode").limit(40), "barcode", 3, 3)
    words = [r["barcode"] for r in some.collect()]
    assert len(words) == 3 and all(sum(x != y for x, y in zip(a, b)) >= 3 for a in words for b in words if a != b)
    with pytest.raises(RuntimeError):
        graph.barcode_set(pool.limit(2), "barcode", 4, 3)


def test_anchored_groups(spark):
    df = spark.createDataFrame([([0, 50, 61, 100, 200],), ([],), (None,)], "s array<int>").select(padlock.anchored_groups(F.col("s"), 60).alias("a"))
    assert [r["a"] for r in df.collect()] == [[0, 0, 61, 61, 200], [], None]


def test_padlocks_keep_the_best_of_each_group(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("ACGT", k=1500))
    p = padlock.Screen(tm_min=45)
    rows = padlock.generate_padlocks(frame(spark, [text, "ACGT", None]), "id", "seq", "TCTACGATT", p).collect()
    assert rows and all(r["seq_l"] == text[r["idx"] : r["idx"] + 20] and r["seq_r"] == text[r["idx"] + 20 : r["idx"] + 40] for r in rows)
    df = spark.createDataFrame([(r["idx"], r["seq_l"], r["seq_r"], r["tm_l"]) for r in rows], "i int, l string, r string, t double")
    report = df.select("t", padlock.screen_arms(F.col("l"), F.col("r"), F.lit("TCTACGATT"), p).alias("s")).collect()
    assert all(r["s"]["ok"] and abs(r["s"]["tm_l"] - r["t"]) < 1e-9 for r in report)


def test_probes(spark):
    row = ("p1", 1, 10, 10, "t", "s", "1", 1, "a")
    df = spark.createDataFrame([row, row, ("p1", 1, 10, 10, "t", "s", "1", 1, "b"), ("p2", 5, 9, 6, "t", "s", "1", 1, "a")], "probe_name string, start long, end long, probe_length int, feature_type string, probe_set string, seq_region_name string, strand int, microarray string")
    assert genes.unique_probes(df).count() == 3
    assert {r["probe_name"]: r["microarrays"] for r in genes.probes_by_name(df).collect()} == {"p1": ["a", "b"], "p2": ["a"]}
    assert [(r["probe_name"], r["array_freq"]) for r in genes.frequent_probes(df, 5).collect()] == [("p1", 3)]


def test_contained(spark):
    q = spark.createDataFrame([("t", "ACG", -1), ("u", "AAA", 1)], "k string, q string, s int")
    r = spark.createDataFrame([("t", "TTCGTT", 1)], "k string, ref string, rs int")
    got = {x["k"]: (x["found"], x["place"]) for x in regions.contained(q, r, "k", "q", "s", "ref", "rs").collect()}
    assert got == {"t": (True, 2), "u": (False, None)}
    assert reverse_complement is not None


def test_sequences_of_a_key_with_two_regions(spark):
    """Each region of a key has its own offset and sequence."""
    r = spark.createDataFrame([("t", 10, 14, "ACGTA", 1), ("t", 114, 110, "GGCCT", -1), ("u", None, 5, "AC", 1)], "k string, s long, e long, seq string, strand int")
    v = spark.createDataFrame([("t", 12, 12), ("t", 111, 111), ("t", None, 3)], "k string, s long, e long")
    got = sorted(map(tuple, regions.permitted_sequences(r, v, "k", "s", "e", "seq", "strand").collect()))
    assert got == [("t", 10, 12, "AC"), ("t", 13, 15, "TA"), ("t", 110, 111, "T"), ("t", 112, 115, "GGC")]


def test_range_join_swaps_bounds(spark):
    q = spark.createDataFrame([("g", "1", 100, 200), ("h", "1", 300, 250), ("n", "1", None, 9)], "id string, c string, s long, e long")
    f = spark.createDataFrame([("x", "1", 210, 190), ("y", "1", 260, 255), ("z", "1", 5, None)], "fid string, c string, a long, b long")
    j = regions.range_join(q, f, "c", ("id", "s", "e"), ("a", "b"))
    assert sorted((r["query_id"], r["fid"]) for r in j.collect()) == [("g", "x"), ("h", "y")]


def local_brute(a, b):
    """Best local score by the three recurrences, cell by cell."""
    low, best = -(10**6), 0
    H = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    E, G = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in "ab")
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            E[i][j] = max(E[i - 1][j] - 1, H[i - 1][j] - 3)
            G[i][j] = max(G[i][j - 1] - 1, H[i][j - 1] - 3)
            H[i][j] = max(0, H[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -2), E[i][j], G[i][j])
            best = max(best, H[i][j])
    return best


def test_local_alignments(spark):
    rng = random.Random(11)
    pairs = [("".join(rng.choices("ACGT", k=rng.randint(0, 12))), "".join(rng.choices("ACGT", k=rng.randint(0, 12)))) for _ in range(200)]
    score, at = duplex.local_alignments([a for a, _ in pairs], [b for _, b in pairs])
    assert score.tolist() == [local_brute(a, b) for a, b in pairs]
    core = "ACGTTGCATTAGCCATGG"
    cases = [(core, core), ("TT" + core, core), (core, "GGA" + core), (core, core[:9] + core[11:]), ("AAA", "CCC"), (core[4:], core)]
    score, at = duplex.local_alignments(*map(list, zip(*cases)))
    assert at.tolist()[:4] == [0, -2, 3, 0] and at.tolist()[5] == 4 and score.tolist() == [36, 36, 36, 32 - 4, 0, 28]
    df = spark.createDataFrame([(core, reverse_complement_of(core[2:])), (core, None), ("", "")], "f string, r string")
    got = df.select(duplex.gapped_overhang(F.col("f"), F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(32, -2), (None, None), (0, 0)]


def reverse_complement_of(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
