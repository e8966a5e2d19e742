"""The operators of the subpackage llm against brute force, with awkward input."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from nucleoframe.llm import leak, packing, queries, shared, split, topn, visual

DATA = "/root/testdata/sf0.001"
VOCABULARY = Path(packing.VOCABULARY)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    sql = queries.oracle_sql().get(name)
    if sql:
        assert oracle.difference(df, oracle.connect(DATA), sql) == ""
    else:
        assert df.count() > 0


# 1


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i % 90, rng.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, s int").withColumn("_rank", F.lit("clash"))
    got = sorted((r["g"], r["rank"], r["s"], r["i"]) for r in topn.top_n_per_group(df, "g", "i", 3, [F.col("s").desc()], salts=4).collect())
    want = []
    for g in ("hot", "a", "b"):
        own = sorted((-s, i) for k, i, s in rows if k == g)[:3]
        want += [(g, n, -s, i) for n, (s, i) in enumerate(own, 1)]
    assert got == sorted(want)
    assert topn.top_n_per_group(df.limit(0), "g", "i", 3, [F.col("s").desc()]).count() == 0


def test_best_padlocks(spark):
    schema = "hit_id long, name0 string, idx int, report struct<tm_arm_min_l:double,tm_arm_min_r:double>, t string"
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "T1.2", 5, (50.0, 50.0), "2024-01-01"), (1, "T1.2", 5, (10.0, 10.0), "2024-01-02"), (2, " t1", 4, (50.0, 40.0), "2024-01-01"), (3, "tr:T1", 4, (50.0, 40.0), "2024-01-01"),
        (3, "tr:T1", 4, (50.0, 40.0), "2024-01-01"), (4, "T1", 3, (50.0, 40.0), "2024-01-01"), (5, "T1", 1, (nan, 40.0), "2024-01-01"), (6, "T1", 1, (inf, 40.0), "2024-01-01"),
        (7, "T1", 1, (0.0, 90.0), "2024-01-01"), (8, "T1", 1, None, "2024-01-01"), (9, None, 1, (60.0, 60.0), "2024-01-01"), (None, "T1", 1, (60.0, 60.0), "2024-01-01"), (10, "T2", None, (1.0, 1.0), "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("loaded_at", F.to_timestamp("t"))
    assert sorted((r["name0"], r["rank"], r["hit_id"]) for r in topn.best_padlocks(df).collect()) == [("T1", 1, 4), ("T1", 2, 2), ("T1", 3, 3), ("T2", 1, 10)]


# 2


def natural(length, spans, limit, overlap):
    """Pieces by trying every cut."""
    out, s = [], 1
    while length - s + 1 > limit:
        ends = [e for e in range(s + overlap, s + limit) if not any(a <= e and e + 1 <= b for a, b in spans)]
        e = ends[-1] if ends else s + limit - 1
        out.append((s, e))
        s = e - overlap + 1
    return [*out, (s, length)]


def test_pieces_against_trying_every_cut():
    rng = random.Random(2)
    for _ in range(300):
        n, limit = rng.randint(1, 300), rng.randint(12, 60)
        overlap = rng.randint(0, limit - 2)
        spans = [(a := rng.randint(1, n), a + rng.randint(-2, 70)) for _ in range(rng.randint(0, 8))]
        assert list(split.pieces(n, spans, limit, overlap)) == natural(n, spans, limit, overlap)


def test_split_rows(spark):
    rows = [(1, 25, [1, None], [5, 7]), (2, 5, [1], [3]), (3, None, None, None), (4, 12, None, None), (None, 12, [], [])]
    df = spark.createDataFrame(rows, "id long, n int, a array<int>, b array<int>").withColumn("piece_no", F.lit("clash"))
    got = sorted((r["id"] or 0, r["piece_no"], r["start_pos"], r["end_pos"]) for r in split.split_oversized(df, "id", "n", "a", "b", 10, 2).collect())
    assert got == [(0, 1, 1, 10), (0, 2, 9, 12), (1, 1, 1, 10), (1, 2, 9, 18), (1, 3, 17, 25), (4, 1, 1, 10), (4, 2, 9, 12)]
    texts = spark.createDataFrame([(4, "abcdefghijkl")], "id long, t string")
    parts = split.piece_texts(split.split_oversized(df.where("id = 4"), "id", "n", "a", "b", 10, 2), texts, "id", "t")
    assert sorted(r["piece"] for r in parts.collect()) == ["abcdefghij", "ijkl"]
    assert split.split_oversized(df.limit(0), "id", "n", "a", "b").count() == 0


def halves_brute(n, spans, limit, overlap):
    """The same rule, with every cut tried."""
    def go(a, b):
        size = b - a + 1
        if size <= limit - overlap:
            return [(max(1, a - overlap), b)]
        mid = a - 1 + size // 2
        cut = min(range(a - 1 + max(1, size // 3), b - max(1, size // 3) + 1), key=lambda p: (sum(x <= p < y for x, y in spans), abs(p - mid), p))
        return go(a, cut) + go(cut + 1, b)

    return go(1, n)


def test_halves_against_trying_every_cut():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(10, 160)
        spans = [(a, a + rng.randint(-2, 30)) for a in (rng.randint(-5, n + 5) for _ in range(rng.randint(0, 8)))]
        limit, overlap = rng.choice([(20, 4), (9, 0), (12, 9)])
        got = list(split.halves(n, spans, limit, overlap))
        assert got == halves_brute(n, spans, limit, overlap), (n, spans, limit, overlap)
        assert got[0][0] == 1 and got[-1][1] == n and all(b - a < limit for a, b in got) and all(y[0] == max(1, x[1] + 1 - overlap) for x, y in zip(got, got[1:]))


def test_bisected_rows(spark):
    df = spark.createDataFrame([(1, 100, [10, None], [60, 5]), (2, 20, [], []), (3, None, None, None), (None, 50, None, None), (1, 100, [10, None], [60, 5])], "id long, n int, a array<int>, b array<int>").withColumn("piece_no", F.lit(7))
    rows = [tuple(r) for r in split.bisect_oversized(df, "id", "n", "a", "b", 20, 5).collect()]
    want = halves_brute(100, [(10, 60)], 20, 5)
    assert sorted(r[2:] for r in rows if r[0] == 1) == sorted(want * 2) and {r[0] for r in rows} == {1, None}
    assert split.bisect_oversized(df.limit(0), "id", "n", "a", "b").count() == 0


# 5


def shared_brute(seqs, n):
    out = {}
    for i, s in seqs.items():
        hit = set()
        for p in range(len(s) - n + 1):
            w = s[p : p + n]
            if not set(w) - set("acgt") and any(w in t for j, t in seqs.items() if j != i):
                hit |= set(range(p, p + n))
        if hit:
            out[i] = len(hit)
    return out


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices("acgt", k=n))
    core, low = make(120), "a" * 60
    seqs = {1: make(50) + core + make(40), 2: core[10:70] + make(30), 3: make(20) + low, 4: low + make(9), 5: core[:35] + "n" + core[36:], 6: "", 7: make(200), 8: core[30:61], 9: make(30) * 3}
    seqs[10] = seqs[1]
    seqs[11] = seqs[12] = make(40) + "nn" + make(20) + "n" + make(33)
    df = spark.createDataFrame([*seqs.items(), (13, None), (None, core), (1, seqs[1].upper())], "id long, s string").withColumns({"token": F.lit(1), "tid": F.lit(2), "letters": F.lit("x")})
    runs = shared.shared_runs(df, "id", "s", 32, token=12)
    got = {r["id"]: r["shared_bp"] for r in shared.covered(runs, "id", 32).collect()}
    assert got == shared_brute(seqs, 32)
    assert shared.shared_runs(df.limit(0), "id", "s", 32, token=12).count() == 0


def test_many_near_copies_of_a_passage(spark):
    """One token with many contents, each cut at another place or with another letter, and copies of each."""
    rng = random.Random(8)
    core, seqs = "".join(rng.choices("acgt", k=90)), {}
    for i in range(60):
        a, b = sorted(rng.sample(range(91), 2))
        s = core[a:b]
        if s and i % 3 == 0:
            at = rng.randrange(len(s))
            s = s[:at] + rng.choice("acgt") + s[at + 1 :]
        seqs[i] = s + "".join(rng.choices("acgt", k=rng.choice([0, 5])))
    df = spark.createDataFrame([*seqs.items()], "id int, s string")
    got = {r["id"]: r["shared_bp"] for r in shared.covered(shared.shared_runs(df, "id", "s", 20, token=6), "id", 20).collect()}
    assert got == shared_brute(seqs, 20)


def test_deliveries_at_the_same_time_count_as_one(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choices("acgt", k=100)) for _ in "ab")
    rows = [(1, a, "2026-01-02"), (1, b[:90], "2026-01-02"), (2, b, "2026-01-01"), (3, a, "2026-01-01"), (3, b, "2026-01-03"), (4, b, "2026-01-01"), (4, None, "2026-01-02"), (None, b, "2026-01-01")]
    df = spark.createDataFrame(rows, "rec_id long, seq string, t string").withColumn("loaded_at", F.to_timestamp("t"))
    got = {r["rec_id"]: r["shared_bp"] for r in shared.shared_bases(df).collect()}
    assert got == {2: 100, 3: 100}


def test_compact_windows_are_nodes_of_the_cartesian_tree():
    codes = np.random.default_rng(5).integers(0, 4, 400).astype(np.uint8)
    min_len, token = 40, 8
    kmer = shared._packed(codes, token)
    order, w = shared.token_hashes(kmer).tolist(), min_len - token + 1

    def nodes(lo, hi):
        """Place, first and last window start of all nodes whose range holds a window of w tokens."""
        if hi - lo < w:
            return []
        at = min(range(lo, hi), key=lambda i: order[i])
        return [(at, max(lo, at - w + 1), min(at, hi - w)), *nodes(lo, at), *nodes(at + 1, hi)]

    want = sorted((a, b, int(kmer[at])) for at, a, b in nodes(0, len(order)))
    assert [(int(a), int(b), int(t)) for t, a, b in zip(*shared.compact_windows(codes, min_len, token))] == want


def test_overlapping_runs_are_counted_once(spark):
    pos = [*range(0, 100), 65530, 65535, 65536, 65600, 65600, 131071, 131072]
    df = spark.createDataFrame([(1, p, 1) for p in pos] + [(1, 10, 300), (1, 20, 5)], "id long, first long, spans int")
    want = len({q for p in [*pos, *range(10, 310)] for q in range(p, p + 50)})
    assert [r["shared_bp"] for r in shared.covered(df, "id", 50).collect()] == [want]


def test_letters_are_packed_without_loss():
    text = " 1 acgtnnACGUacgt-\n 2 n"
    n, letters, gaps = shared.pack_letters(text, 4)
    assert "".join("acgt?"[c] for c in shared.unpack_letters(n, letters, gaps)) == "acgt??acgtacgt??"
    assert shared.pack_letters("ac 1", 4) is None


def test_chunks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(shared, "CHUNK", 100)
    text = "".join(random.Random(4).choices("acgt", k=1000))
    starts = set()
    for codes, owner, begin, offset in shared._joined([shared.pack_letters(text, 40)], 40):
        for tok, first, last in [shared.compact_windows(codes, 40, 12)]:
            own = np.searchsorted(begin, first, "right") - 1
            for a, b, o in zip(first, last, own):
                starts |= set(range(a - begin[o] + offset[o], b - begin[o] + offset[o] + 1))
    assert starts == set(range(961))


# 6


@pytest.mark.parametrize("per_task", [50_000, 60])
def test_packing(spark, per_task):
    rng = random.Random(5)
    sizes = [rng.randint(1, 300) for _ in range(400)] + [0, None, 100, 250, 1000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(3, 17)], "id long, n int").withColumn("task", F.lit("clash"))
    rows = packing.pack(df, "id", "n", 100, per_task).collect()
    fill = {}
    for r in rows:
        if r["container_id"] is None:
            assert r["units"] == 0
        else:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["units"]
    total = sum(n or 0 for n in sizes) + 17
    assert max(fill.values()) <= 100 and sum(fill.values()) == total
    assert len(fill) <= 1.05 * total / 100 + 3
    per = {}
    for r in rows:
        per.setdefault(r["id"], []).append(r["units"])
    assert all(sum(per[i]) == (n or 0) + (17 if i == 3 else 0) for i, n in enumerate(sizes))
    assert all(len(per[i]) == 1 for i, n in enumerate(sizes) if n and n <= 100 and i != 3)
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0


def test_repeated_and_null_keys_are_spread(spark):
    df = spark.createDataFrame([(None, 7)] * 300 + [(1, 7)] * 300, "id long, n int")
    rows = packing.pack(df, "id", "n", 21, 50)
    got = rows.collect()
    assert len(got) == 600 and len({r["container_id"].split("-")[1] for r in got if r["container_id"].startswith("a")}) > 4
    assert max(Counter(r["container_id"] for r in got).values()) == 3


def test_packing_audit_sees_what_is_wrong(spark):
    items = spark.createDataFrame([(1, 5), (2, 30), (3, 0), (4, None)], "id long, n int")
    audit = lambda rows: tuple(packing.packing_audit(spark.createDataFrame(rows, "id long, units int, container_id string"), items, "id", "n", 10).first())
    assert audit([(1, 5, "x"), (2, 10, "a"), (2, 10, "b"), (2, 10, "c"), (3, 0, None), (4, 0, None)]) == (4, 0, 0, 0, True)
    assert audit([(1, 3, "x"), (1, 2, "y"), (2, 10, "a"), (2, 20, "b"), (3, 0, None)]) == (3, 1, 0, 1, True)
    assert audit([(1, 5, "x"), (2, 10, "a")])[2] == 20


def test_sum_of_squares_takes_the_best_bin():
    rng = random.Random(6)
    sizes = [rng.randint(1, 10) for _ in range(300)]
    bins = packing.sum_of_squares(np.array(sizes), 10)
    gaps = {}
    for s, b in zip(sizes, bins.tolist()):
        def total(place):
            g = {**gaps, place: gaps.get(place, 10) - s}
            n = [list(g.values()).count(x) for x in range(1, 10)]
            return sum(x * x for x in n)

        assert total(b) == min(total(p) for p in [*(p for p, g in gaps.items() if g >= s), "new"])
        gaps[b] = gaps.get(b, 10) - s


@pytest.mark.skipif(not VOCABULARY.exists(), reason="needs the tokenizers")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> é" * 2000)], "id long, t string")
    got = {r["id"]: r["n_tokens"] for r in packing.count_tokens(df, "id", "t").collect()}
    assert got[2] == got[3] == 0 and got[1] >= 2 and got[4] > 4000


# 7


def words_brute(pages, items, n):
    out = set()
    for i, t in items:
        w = leak.words_of(t)
        m = min(n, len(w))
        for p, u in pages:
            v = leak.words_of(u)
            if m and any(w[a : a + m] == v[b : b + m] for a in range(len(w) - m + 1) for b in range(len(v) - m + 1)):
                out.add((p, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 3, 5, 12, 20, 0])] + [(6, None), (7, "..."), (8, "One Tw​o three")]
    pages = [(i, text(n)) for i, n in enumerate([0, 2, 10, 300, 3000])] + [(5, None), (6, "x ONE, two\nth=\nree y"), (7, items[4][1] + "\n" + items[3][1]), (8, "one two thre¬ \n e")]
    P = spark.createDataFrame([*pages, pages[7]], "doc long, t string").withColumn("page", F.lit(0))
    I = spark.createDataFrame([*items, items[0]], "item long, t string")
    for block in (200_000, 5):
        got = {(r["doc"], r["item"]) for r in leak.find_leaks(P, "doc", "t", I, "item", "t", 6, block_words=block).collect()}
        assert got == words_brute(pages, items, 6)
    assert leak.find_leaks(P.limit(0), "doc", "t", I, "item", "t").count() == 0
    assert leak.find_leaks(P, "doc", "t", I.limit(0), "item", "t").count() == 0


def test_leaks_with_edits_reach_the_recall(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(150)]
    pages = []
    for i, t in items:
        w = t.split()
        w[rng.randrange(12)] = "changed"
        pages.append((i, " ".join(rng.choices(words, k=30) + w + rng.choices(words, k=30))))
    P, I = spark.createDataFrame(pages, "doc long, t string"), spark.createDataFrame(items, "item long, t string")
    got = {(r["doc"], r["item"]) for r in leak.find_leaks(P, "doc", "t", I, "item", "t", max_edits=1, recall=0.95).collect()}
    assert got <= {(i, i) for i, _ in items} and len(got) >= 0.9 * len(items)


@pytest.mark.parametrize("edits, recall", [(1, 0.95), (2, 0.8)])
def test_leaks_with_words_put_in_and_left_out(spark, edits, recall):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    other = lambda: rng.choice([*words, "foreign"])
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(150)]
    kinds = {}
    pages = []
    for i, t in items:
        for kind in ("put in", "left out", "at the end"):
            w = t.split()
            for _ in range(edits):
                at = rng.randrange(1, len(w) - 1)
                w[at : at + (kind != "put in")] = [other()] if kind == "put in" else []
            kinds[len(pages)] = (kind, i)
            pages.append((len(pages), " ".join([other() for _ in range(30)] + w + [other() for _ in range(30) if kind != "at the end"])))
    P, I = spark.createDataFrame(pages, "doc long, t string"), spark.createDataFrame(items, "item long, t string")
    got = [(r["doc"], r["item"]) for r in leak.find_leaks(P, "doc", "t", I, "item", "t", max_edits=edits, recall=recall).collect()]
    found = Counter(kinds[d][0] for d, i in got if kinds[d][1] == i)
    assert all(kinds[d][1] == i for d, i in got)
    assert all(found[k] >= recall * len(items) for k in ("put in", "left out", "at the end")), found


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_recall_by_kind_of_edit(edits):
    """Of 200 items of 12 words, each with its passage in a page of its own, at least 0.9 are found for each kind of edit."""
    rng = random.Random(edits)
    pool = [f"w{i}" for i in range(3000)]
    items = [(i, rng.choices(pool, k=12)) for i in range(200)]
    block = leak.ItemBlock(items, 12, edits, 0.9)
    for kind in ("changed", "put in", "left out"):
        ids, page = [], []
        for i, w in items:
            w = list(w)
            for _ in range(edits):
                at = rng.randrange(1, len(w))
                w[at : at + (kind != "put in")] = [] if kind == "left out" else ["foreign"]
            before, after = (rng.choices(pool, k=rng.choice([0, 20])) for _ in "ab")
            x = [block.vocabulary.get(v, 0) for v in before + w + after] + [0] * edits
            ids += x
            page += [i] * len(x)
        found = block.found(np.array(ids), np.array(page)).tolist()
        assert sum(p == i for p, i in found) >= 180, kind


def edits_brute(a, b):
    """Word edits from a to the nearest passage of b that begins at b's begin."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("n, most", [(1, 1), (5, 1), (6, 3), (12, 2)])
def test_passage_distances(n, most):
    rng = np.random.default_rng(n)
    a, b = rng.integers(1, 4, (300, n)), rng.integers(1, 4, (300, n + most))
    want = [min(edits_brute(x, y), most + 1) for x, y in zip(a.tolist(), b.tolist())]
    assert np.minimum(leak.passage_distances(a, b, most), most + 1).tolist() == want


def test_parts_miss_nothing(monkeypatch):
    monkeypatch.setattr(leak, "MOST_WALKS", 0)
    rng = random.Random(3)
    item = [rng.choice("abcd") for _ in range(9)]
    block = leak.ItemBlock([(0, item)], 9, 2, 0.9)
    pages = [[rng.choice("abcde") for _ in range(rng.choice([7, 8, 20]))] for _ in range(300)]
    for page in pages[:100]:
        page[3:5] = [x for x in item if rng.random() < 0.8]
    want = {k for k, p in enumerate(pages) if any(edits_brute(item, p[s : s + 11]) <= 2 for s in range(len(p)))}
    ids = [x for p in pages for x in [block.vocabulary.get(w, 0) for w in p] + [0, 0]]
    page = [k for k, p in enumerate(pages) for _ in range(len(p) + 2)]
    found = {p for p, _ in block.found(np.array(ids), np.array(page)).tolist()}
    assert found == want and 20 < len(want) < 280


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_leaks_with_an_edit_in_the_tables(spark):
    """All that is found holds, exact leaks are among it, and of all that holds by trying every place at least 0.9 is found."""
    D, I = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    got = set(map(tuple, queries.queries()["p7_edits"](spark, DATA).collect()))
    exact = set(map(tuple, queries.queries()["p7_found"](spark, DATA).collect()))
    pages = {r["doc_id"]: leak.words_of(r["text"]) for r in D.collect()}
    items = {r["item_id"]: leak.words_of(r["text"]) for r in I.collect()}
    number = {w: i + 1 for i, w in enumerate({w for v in items.values() for w in v})}
    ids = np.array([x for v in pages.values() for x in [*(number.get(w, 0) for w in v), *[0] * 13]])
    page = np.repeat([*pages], [len(v) + 13 for v in pages.values()])
    held = set()
    for item, words in items.items():
        x, n = np.array([number[w] for w in words]), min(12, len(words))
        if not n:
            continue
        edits = int(n == 12)
        known = np.concatenate(([0], np.cumsum(np.isin(ids, x))))
        at = np.flatnonzero(known[n:] - known[:-n] >= n - edits)  # an edit brings at most one other word
        at = at[at < len(ids) - 13]
        for a in range(len(x) - n + 1):
            d = leak.passage_distances(np.tile(x[a : a + n], (len(at), 1)), ids[at[:, None] + np.arange(n + edits)], 1)
            held |= {(p, item) for p in page[at[d <= edits]].tolist()}
    assert exact <= got <= held and len(got) >= 0.9 * len(held)


def test_passages_end_with_their_page():
    block = leak.ItemBlock([(0, list("abcdefghijkl"))], 12, 1, 0.9)
    ids = np.array([*range(1, 12), 0, 12, 0])  # the item's last word is the next page's first
    assert block.found(ids, np.array([0] * 12 + [1] * 2)).tolist() == [[0, 0]]
    cut = np.array([*range(1, 11), 0, 11, 12, 0])
    assert block.found(cut, np.array([0] * 11 + [1] * 3)).tolist() == []


# 8


@pytest.mark.parametrize(
    "a, b",
    [("ｆｕｌｌ　１２", "full 12"), ("oﬃce ﬂag", "office flag"), ("été", "été"), ("a​b⁠﻿­͏", "ab"), ("a b c d", "a b c d"), ("сосоа", "cocoa"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("УҮӀ", "YYI"), ("үѵӏρ", "yvlp"), ("ѴͿϹ", "VJC"), ("e‍́", "é")],
)
def test_same_look(a, b):
    assert visual.canonical(a) == visual.canonical(b)


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("0", "O"), ("1", "l"), ("a b", "a  b"), ("a\nb", "a b"), ("rn", "m"), ("ß", "ss"), ("œ", "oe"), ("x²", "x2"), ("a.", "a,"), ("й", "и"), ("в", "B")])
def test_other_look(a, b):
    assert visual.canonical(a) != visual.canonical(b)


def test_canonical_is_stable():
    rng = random.Random(9)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330), *range(0x370, 0x460), *range(0x2000, 0x2070), *range(0xFF00, 0xFFEF)]]
    for _ in range(500):
        t = "".join(rng.choices(pool, k=12))
        assert visual.canonical(visual.canonical(t)) == visual.canonical(t)


def test_visual_pairs(spark):
    rows = [(1, "Page one"), (2, "Ｐage one"), (3, "Page one"), (4, "page one"), (5, None), (6, "​ \n"), (7, " ⁠\n"), (8, ""), (9, "Pa­ge one"), (None, "Ｐage one"), (2, "Ｐage one"), (10, "é" * 40_000), (11, "é" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw", F.lit("clash"))
    got = sorted(map(tuple, visual.visual_pairs(df, "doc_id", "text").collect()))
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (10, 11)]
    assert visual.visual_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_visual_members_hold_the_same_links(spark):
    rng = random.Random(12)
    looks = ["page", "рage", "pаge", "ｐage", "pa\u200bge", "line one", "lіne one", "alone"]
    rows = [(rng.randint(1, 70), rng.choice(looks)) for _ in range(90)] + [(500 + i, "twin") for i in range(300)] + [(900, "twіn"), (901, None), (None, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"look": F.lit(0), "spelling": F.lit(0)})
    form = {(i, t): visual.canonical(t) for i, t in rows if t and i is not None}
    want = {(i, j) for (i, t), f in form.items() for (j, u), g in form.items() if i < j and t != u and f == g}
    assert set(map(tuple, visual.visual_pairs(df, "doc_id", "text").collect())) == want
    members = {tuple(r) for r in visual.visual_members(df, "doc_id", "text").select("doc_id", "look", "spelling", "n_spellings").collect()}
    mixed = {f: {t for (_, t), g in form.items() if f == g} for f in form.values()}
    assert members == {
        (i, min(j for (j, _), g in form.items() if g == f), min(j for (j, u), _ in form.items() if u == t), len(mixed[f])) for (i, t), f in form.items() if len(mixed[f]) > 1
    }


def test_folded_form(spark):
    df = spark.createDataFrame([("STRASSE",), ("Straße",), ("ＳＴＲＡＳＳＥ",), (None,)], "t string")
    assert [r["f"] for r in df.select(visual.canonical_text(F.col("t"), fold_case=True).alias("f")).collect()] == ["strasse", "strasse", "strasse", None]
