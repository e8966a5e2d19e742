"""Files: reading, writing, round trips."""

from pyspark.sql import functions as F

from nucleoframe.sources import fasta, genbank, tables, xmfa

RECORD = """LOCUS       AB000001                  70 bp    DNA     linear   PLN 21-JUN-1999
DEFINITION  An invented record with a definition that is so long that it needs
            a second line.
ACCESSION   AB000001
VERSION     AB000001.1  GI:12
KEYWORDS    .
SOURCE      Inventa mirabilis
  ORGANISM  Inventa mirabilis
            Fictitia; Inventaceae.
REFERENCE   1  (bases 1 to 70)
  AUTHORS   Nobody,A. and Noone,B.
  TITLE     A title
  JOURNAL   Unpublished
COMMENT     A comment.
            
            
            ##Genome-Assembly-Data-START##
            Assembly Method       :: none
            ##Genome-Assembly-Data-END##
FEATURES             Location/Qualifiers
     source          1..70
                     /organism="Inventa mirabilis"
     CDS             join(<1..20,complement(30..>60))
                     /codon_start=1
                     /pseudo
                     /note="one"
                     /note="two"
                     /translation="MAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA
                     ACCC"
ORIGIN      
        1 acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac
       61 acgtacgtac
//
"""


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first entry\nACGT\nAC\n>two\nGG\nTT")
    got = {r["id"]: (r["description"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": ("one first entry", "ACGTAC"), "two": ("two", "GGTT")}
    bad = fasta.read_fasta(spark, str(tmp_path / "a.fa"), alphabet="DNA", mode="drop", not_allowed="A")
    assert [r["id"] for r in bad.collect()] == ["two"]
    fasta.write_fasta(spark.createDataFrame([("x", "A" * 130)], "n string, s string"), "n", "s", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    assert {r["seq"] for r in tables.read_records(spark, str(tmp_path / "a.fa")).collect()} == {"ACGTAC", "GGTT"}


def test_genbank_round_trip(spark, tmp_path):
    (tmp_path / "a.gb").write_text(RECORD * 2)
    df = genbank.read_genbank(spark, str(tmp_path / "a.gb"))
    rows = df.orderBy("record_no").collect()
    assert len(rows) == 2 and rows[0]["info"]["accession"] == "AB000001" and rows[0]["seq"] == "acgtacgtac" * 7
    f = rows[0]["features"][1]
    assert f["location"] == "join(<1..20,complement(30..>60))" and f["qualifiers"]["note"] == ["one", "two"] and f["qualifiers"]["pseudo"] == [None]
    assert f["qualifiers"]["translation"][0].endswith("ACCC")
    assert genbank.record_text(*[genbank.parse_record(RECORD)[k] for k in ("info", "features", "seq")]) == RECORD
    text = genbank.genbank_text(df.limit(1), "file").collect()[0]["text"]
    assert text == RECORD
    assert genbank.parse_record("no record") is None
    assert tables.read_records(spark, str(tmp_path / "a.gb")).count() == 2


def test_xmfa(spark, tmp_path):
    (tmp_path / "a.xmfa").write_text("> 1:1-6 + a.fa\nACG\nT--\n> 2:10-15 - b.fa b\nACGTAA\n=score=3\n> 1:7-9 + a.fa\nAAA\n=\n")
    rows = {(r["group_no"], r["seq_num"]): (r["strand"], r["notes"], r["seq"], r["group_notes"]) for r in xmfa.read_xmfa(spark, str(tmp_path / "a.xmfa")).collect()}
    assert rows == {(1, 1): ("+", "a.fa", "ACGT--", "score=3"), (1, 2): ("-", "b.fa b", "ACGTAA", "score=3"), (2, 1): ("+", "a.fa", "AAA", "")}


def test_barcode_sets(spark, tmp_path):
    pool = spark.createDataFrame([("AC",), ("GT",), ("AC",)], "b string")
    tables.write_barcode_set(pool, "b", str(tmp_path / "set"))
    assert sorted(r["barcode"] for r in tables.read_barcode_set(spark, str(tmp_path / "set")).collect()) == ["AC", "GT"]


def test_stream(spark, tmp_path):
    from nucleoframe.streaming import stateless

    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:30")], "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    stateless.to_memory(stateless.distinct_within(stream, ["k"], "t", "1 hour"), "distinct_keys").stop()
    assert spark.table("distinct_keys").count() == 2
    fixed = spark.createDataFrame([("a", 1)], "k string, v int")
    stateless.to_memory(stateless.match_static(stream, fixed, ["k"]), "matched").stop()
    assert spark.table("matched").count() == 2
    stateless.to_memory(stateless.windowed_counts(stream, "t", "1 hour", "1 minute", ["k"]), "counted", "complete").stop()
    assert {r["k"]: r["n"] for r in spark.table("counted").collect()} == {"a": 2, "b": 1}


def test_streams_of_a_file_and_of_a_folder(spark, tmp_path):
    from nucleoframe.streaming import stateless

    spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "folder.parquet"))
    next((tmp_path / "folder.parquet").glob("*.parquet")).rename(tmp_path / "file.parquet")
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string").repartition(2).write.mode("overwrite").parquet(str(tmp_path / "folder.parquet"))
    for name, n in (("file", 2), ("folder", 3)):
        got = stateless.to_files(stateless.parquet_stream(spark, str(tmp_path / f"{name}.parquet")))
        assert sorted(r["k"] for r in got.collect()) == list(range(1, n + 1))


AWKWARD = """LOCUS       INV_2                   130 bp ds-DNA     linear   BCT 01-JAN-2020
DEFINITION  Invented.
ACCESSION   INV_2 REGION: 1..130
VERSION     INV_2.7
DBLINK      BioProject: PRJX1
            BioSample: SAMX2
KEYWORDS    one; two.
SOURCE      Inventa (mirabilis)
  ORGANISM  Inventa
REFERENCE   1
  AUTHORS   Nobody,A.
  CONSRTM   Nobodies
  TITLE     Direct
            Submission
  JOURNAL   Submitted
   PUBMED   12
REFERENCE   2  (bases 3 to 9)
  AUTHORS   Noone,B.
COMMENT     COMMENT     said twice.
            Second line.
COMMENT     Another.
FEATURES             Location/Qualifiers
     source          1..130
     gene            complement(join(<3..9,
                     12^13,INV_9.1:1..>5))
                     /gene="a ""quoted"" name"
                     /note="with /slash=inside
                     /and=another"
                     /pseudo
                     /number=3
                     /note=""
     misc_feature    7
ORIGIN
        1 ACGTNacgtn acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac
       61 acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac
      121 acgtacgtac
//
"""


def test_an_awkward_flat_file(spark):
    r = genbank.parse_record(AWKWARD)
    info = r["info"]
    assert (info["name"], info["length"], info["stranded"], info["molecule_type"], info["form"], info["gb_division"], info["mod_date"]) == ("INV_2", 130, "ds", "DNA", "linear", "BCT", "01-JAN-2020")
    assert info["accession"] == "INV_2 REGION: 1..130" and (info["version"], info["GI"]) == ("INV_2.7", None) and info["dblink"] == "BioProject: PRJX1 BioSample: SAMX2"
    assert info["organism"] == ["Inventa"] and [(x["r_index"], x["start_idx"], x["end_idx"], x["title"], x["pubmed"]) for x in info["references"]] == [(1, None, None, "Direct Submission", "12"), (2, 3, 9, None, None)]
    assert info["comment"] == {"text": "COMMENT     said twice. Second line. Another.", "assembly": None}
    source, gene, misc = r["features"]
    assert gene["location"] == "complement(join(<3..9,12^13,INV_9.1:1..>5))" and (source["qualifiers"], misc["location"]) == ([], "7")
    assert dict(gene["qualifiers"]) == {"gene": ['a "quoted" name'], "note": ["with /slash=inside /and=another", ""], "pseudo": [None], "number": ["3"]}
    assert len(r["seq"]) == 130 and r["seq"].startswith("ACGTNacgtn")
    again = genbank.parse_record(genbank.record_text(r["info"], r["features"], r["seq"]))
    assert again == r
    rows = genbank.parse_genbank(spark.createDataFrame([(1, AWKWARD.replace("\n", "\r\n")), (2, ""), (3, None), (4, AWKWARD[:300])], "id int, t string"), "id", "t").collect()
    assert {x["id"]: x["seq"] for x in rows} == {1: r["seq"], 4: None}
