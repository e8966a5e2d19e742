"""Queries on small made tables with rows that are long, reversed or hold several values, against brute force."""

from contextlib import contextmanager
from datetime import datetime

from nucleoframe.queries import base, core

NOW = datetime(2026, 1, 1)
QUERIES = core.queries()
GENES = (
    "id string, display_name string, strand int, start bigint, end bigint, seq_region_name string, species string, loaded_at timestamp, "
    "Transcript array<struct<id: string, biotype: string, is_canonical: int, strand: int, start: bigint, end: bigint, Exon: array<struct<id: string, start: bigint, end: bigint, strand: int, seq_region_name: string>>>>"
)
EXONS = "id string, Parent string, start bigint, end bigint, strand int, seq_region_name string, assembly_name string, version int, loaded_at timestamp"


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def gene(name, start, end, strand=1):
    return (name, name, strand, start, end, "1", "human", None, [("T" + name, "x", 1, strand, start, end, [])])


def exon(name, parent, start, end):
    return (name, parent, start, end, 1, "1", "a", 1, None)


def test_sequences_of_long_transcripts(spark, tmp_path):
    places = {"TA": (1001, 1300, 1), "TB": (5001, 105000, 1), "TC": (5001, 105001, -1), "TD": (11, 250010, -1)}
    exons = [("TA", 1100, 1200), ("TB", 6000, 104000), ("TC", 6000, 104000), ("TD", 100, 240000), ("TD", 239990, 250000)]
    d = write(
        spark, tmp_path, genes=([gene(t[1:], *p) for t, p in places.items()], GENES),
        exons=([exon(f"e{i}", p, a, b) for i, (p, a, b) in enumerate(exons)], EXONS),
    )

    def part(t, lo, hi):
        a, b, strand = places[t]
        seq = ("ACCGTTTGAC" * ((b - a + 10) // 10))[: b - a + 1]
        return seq[lo - a : hi - a] if strand > 0 else seq[::-1][lo - a : hi - a][::-1]

    got = sorted(tuple(r) for r in QUERIES["e5_sliced_sequence"](spark, d).select("parent", "lo", "hi", "seq").collect())
    assert got == sorted((t, p[0] + 10, p[0] + 25, part(t, p[0] + 10, p[0] + 25)) for t, p in places.items())
    want = []
    for t, (a, b, _) in places.items():
        covered = {x for p, lo, hi in exons if p == t for x in range(lo, hi + 1)}
        free = [x for x in range(a, b + 1) if x not in covered]
        starts = [x for i, x in enumerate(free) if not i or free[i - 1] != x - 1]
        ends = [x + 1 for i, x in enumerate(free) if i + 1 == len(free) or free[i + 1] != x + 1]
        want += [(t, lo, hi, part(t, lo, hi)) for lo, hi in zip(starts, ends)]
    got = sorted(tuple(r) for r in QUERIES["e6_permitted_sequences"](spark, d).select("parent", "lo", "hi", "seq").collect())
    assert got == sorted(want)


def test_all_values_of_a_translation(spark, tmp_path):
    values = [["MKV"], ["mkl", "MAA*", "MR V"], ["", "MCC"], [None, "1", "MDD"], [], None]
    features = [("CDS", "1..9", None if v is None else {"translation": v}) for v in values] + [("gene", "1..9", {"note": ["x"]})]
    schema = "rec_id bigint, loaded_at timestamp, info string, seq string, features array<struct<type: string, location: string, qualifiers: map<string, array<string>>>>"
    d = write(spark, tmp_path, genbank=([(7, NOW, None, "ACGT", features), (8, NOW, None, "ACGT", None)], schema))
    got = {r["id"]: r["aa"] for r in base.proteins(spark, d).collect()}
    assert got == {"7/1": "MKV", "7/2": "MKL", "7/2/2": "MAA", "7/2/3": "MRV", "7/3/2": "MCC", "7/4/3": "MDD"}
    assert {r["id"] for r in QUERIES["s12_reverse_translate"](spark, d).where("ok").collect()} == set(got)


@contextmanager
def conf(spark, **values):
    for k, v in values.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        yield
    finally:
        for k in values:
            spark.conf.unset(f"spark.sql.{k}")


def test_sequences_are_not_sent_to_every_task(spark, tmp_path):
    n, long = 400, 250_000  # 100 MB of sequences from tables of some KB
    cuts = [(1000 * j + 1, 1000 * j + 100) for j in range(1, 21)]
    d = write(
        spark, tmp_path, genes=([gene(f"G{i}", 1, long) for i in range(n)], GENES),
        exons=([exon(f"e{i}/{a}", f"TG{i}", a, b) for i in range(n) for a, b in cuts], EXONS),
    )
    with conf(spark, autoBroadcastJoinThreshold="256k", maxBroadcastTableSize="80m"):  # a broadcast table takes a page of 32 MB at least
        rows = QUERIES["e6_permitted_sequences"](spark, d)
        got = sorted((r["parent"], r["lo"], r["hi"], r["n"]) for r in rows.selectExpr("parent", "lo", "hi", "length(seq) AS n").collect())
    free = list(zip([1, *[b + 1 for _, b in cuts]], [*[a for a, _ in cuts], long + 1]))
    assert got == sorted((f"TG{i}", lo, hi, hi - lo) for i in range(n) for lo, hi in free)


def test_design_reads_its_segments_once(spark, tmp_path):
    genes = [(f"G{i}", f"G{i}", 1, 1, 5000, "1", "human", None, [(f"T{i}", "x", 1, 1, 1, 5000, [(f"E{i}", 1001, 1000 + 60 * (i + 1), 1, "1")])]) for i in range(8)]
    d = write(
        spark, tmp_path, genes=(genes, GENES), exons=([exon(f"v{i}1", f"T{i}", 1061, 1062) for i in range(8)], EXONS),
        barcodes=([("AACCA",), ("ACCGG",)], "barcode string"),
    )
    rows = QUERIES["e12_design_padlocks"](spark, d)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") < 20
    found = rows.collect()
    assert found and all(len({r["relaxed"] for r in found if r["gene_id"] == g}) == 1 for g in {r["gene_id"] for r in found})
