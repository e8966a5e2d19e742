"""Queries of text layout, orders and sets of hits, feature lists, position sets, gene-wise design, files and data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.common import table, work_folder
from nucleoframe.functions import codon, metrics, sql, text
from nucleoframe.operators import genes, graph, kmers, padlock, records, regions, restriction, similarity
from nucleoframe.queries import base
from nucleoframe.queries.base import query, rc_sql
from nucleoframe.queries.relational import _SIMPLE, _TARGETS, _bars, _flat, _simple, _targets
from nucleoframe.queries.scalars import _USAGE, _usage, tm_sql
from nucleoframe.sources import fasta, genbank, tables

# text

_LINE = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query("s15_soft_wrap", rf"SELECT doc_id, regexp_replace(regexp_replace({_LINE}, '(?:(.{{1,60}})(?: |$)|(\S{{61,}})(?: |$))', chr(10) || '\1\2', 'g'), '^\n', '') AS out FROM documents")
def s15w(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", text.soft_wrap(F.col("text"), 60).alias("out"))


@query("s15_shorten", rf"""SELECT doc_id, CASE WHEN length({_LINE}) <= 80 THEN {_LINE} WHEN regexp_extract({_LINE}, '^(.{{1,74}}) ', 1) = '' THEN '[...]'
ELSE regexp_extract({_LINE}, '^(.{{1,74}}) ', 1) || ' [...]' END AS out FROM documents""")
def s15s(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", text.shortened(F.col("text"), 80).alias("out"))


@query("s15_dedent", r"SELECT doc_id, regexp_replace(text, '(?m)^[ \t]+$', '', 'g') AS out FROM documents")
def s15d(spark: SparkSession, d: str) -> DataFrame:
    """Pages that were indented by four blanks come out as before, lines of blanks as empty ones, as their own common indent is none."""
    x = _pages(spark, d).withColumn("text", F.regexp_replace("text", "(?m)^", "    "))
    return x.select("doc_id", text.dedented(F.col("text")).alias("out"))


@query("s15_indent", r"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '\s*') THEN x ELSE '> ' || x END), chr(10)) AS out FROM documents")
def s15i(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", text.indented(F.col("text"), "> ").alias("out"))


# sets and orders of hits, cliques, windows


@query("w11_rolling_gc", "SELECT id, list_transform(range(1, length(seq) - 18), lambda i: length(regexp_replace(substr(seq, i, 20), '[^GC]', '', 'g'))::INT) AS gc FROM oligos")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq").select("id", metrics.rolling_gc(F.col("seq"), 20).cast("array<int>").alias("gc"))


_HITS = _TARGETS.format(m=20) + """, near AS (SELECT t.id, t.t, win.* FROM targets t JOIN win ON left(t.t, 10) = left(w, 10) UNION SELECT t.id, t.t, win.* FROM targets t JOIN win ON right(t.t, 10) = right(w, 10)),
hit AS (SELECT id AS target_id, ref_id, "offset" FROM near WHERE hamming(t, w) <= 1)
"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    return similarity.similarity_join(_targets(spark, d, 20), "id", "t", base.contigs(spark, d), "id", "seq", 20, k)


@query("o2_sorted_hits", _HITS + """SELECT target_id, list({'ref_id': ref_id, 'offset': "offset"} ORDER BY ref_id, "offset") AS hits FROM hit GROUP BY target_id""")
def o2(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 1).groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("ref_id", "offset"))).alias("hits"))


@query("o7_union_of_hits", _HITS + """SELECT target_id, ref_id, "offset" FROM hit UNION SELECT t.id, ref_id, "offset" FROM targets t JOIN win ON w = t.t""")
def o7(spark: SparkSession, d: str) -> DataFrame:
    cols = ["target_id", "ref_id", "offset"]
    return _hits(spark, d, 1).select(*cols).unionByName(_hits(spark, d, 0).select(*cols)).distinct()


@query("o6_disjoint_words", "SELECT id, NOT list_has_any(list_transform(range(1, length(seq_l) - 3), lambda i: substr(seq_l, i, 5)), list_transform(range(1, length(seq_r) - 3), lambda i: substr(seq_r, i, 5))) AS ok FROM oligos")
def o6(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq_l", "seq_r").select("id", (~F.arrays_overlap(kmers.word_list(F.col("seq_l"), 5), kmers.word_list(F.col("seq_r"), 5))).alias("ok"))


_CLIQUES = """, e AS (SELECT a.barcode AS i, b.barcode AS j FROM bars a JOIN bars b ON hamming(a.barcode, b.barcode) >= 4),
near AS (SELECT i, list(j) AS js FROM e GROUP BY i),
grown AS (SELECT [i] AS members, js AS may FROM near UNION ALL SELECT list_append(members, n.i), list_intersect(may, n.js) FROM grown JOIN near n ON n.i > members[-1] AND list_contains(may, n.i))
SELECT (row_number() OVER (ORDER BY len(members) DESC, members))::INT AS clique_no, len(members)::INT AS size, members FROM grown WHERE len(may) = 0 AND len(members) >= """


@query("g7_cliques_of_sequences", _CLIQUES + "3")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return graph.cliques_of(_bars(spark, d), "barcode", "barcode", 3, 4)


@query("o4_first_cliques", _CLIQUES + "3 ORDER BY clique_no LIMIT 5")
def o4(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the five largest cliques."""
    return graph.cliques_of(_bars(spark, d), "barcode", "barcode", 3, 4).orderBy("clique_no").limit(5)


# feature lists


@query("o3_insert_features", _SIMPLE + """, every AS (SELECT id, s AS start, e AS "end", type, location FROM simple UNION ALL SELECT id, 1614, 1635, 'myfeature', '1615..1636' FROM contigs WHERE length(seq) >= 1636)
SELECT id, start, "end", type, location, row_number() OVER (PARTITION BY id ORDER BY start NULLS FIRST, "end" NULLS FIRST, type NULLS FIRST, location)::INT AS feature_no FROM every""")
def o3i(spark: SparkSession, d: str) -> DataFrame:
    new = base.contigs(spark, d).where(F.length("seq") >= 1636).select("id", F.lit(1614).alias("start"), F.lit(1635).alias("end"), F.lit("myfeature").alias("type"), F.lit("1615..1636").alias("location"))
    return records.insert_features(_simple(spark, d), new, "id").select("id", "start", "end", "type", "location", "feature_no")


@query("o3_remove_features", _SIMPLE + """, n AS (SELECT id, s AS start, e AS "end", type, location, count(*) AS have, count(*) FILTER (WHERE feature_no % 3 = 0) AS gone FROM simple GROUP BY ALL)
SELECT id, start, "end", type, location FROM n, unnest(range(0, have - gone)) AS r(k)""")
def o3r(spark: SparkSession, d: str) -> DataFrame:
    f = _simple(spark, d)
    return records.remove_features(f, f.where("feature_no % 3 = 0"), "id").select("id", "start", "end", "type", "location")


@query("o3_absent_features", _SIMPLE + "SELECT id, s + 1 AS start FROM simple x WHERE NOT EXISTS (FROM simple y WHERE y.id = x.id AND y.s = x.s + 1 AND y.e = x.e AND y.type IS NOT DISTINCT FROM x.type AND y.location = x.location)")
def o3a(spark: SparkSession, d: str) -> DataFrame:
    f = _simple(spark, d)
    return records.absent_features(f, f.withColumn("start", F.col("start") + 1), "id").select("id", "start")


@query("f8_features_by_type", _SIMPLE + """SELECT id, type, count(*) AS n, list({'start': s, 'end': e} ORDER BY s, e) AS places FROM simple GROUP BY id, type""")
def f8t(spark: SparkSession, d: str) -> DataFrame:
    return records.features_by_type(_simple(spark, d), "id")


# positions and designs


@query("o5_position_difference", """, var AS (SELECT parent, least(s, e) AS lo, greatest(s, e) AS hi FROM exon_rows WHERE s IS NOT NULL AND e IS NOT NULL),
have AS (SELECT parent, unnest(range(least(s, e), greatest(s, e) + 1)) AS p FROM transcripts), gone AS (SELECT parent, unnest(range(lo, hi + 1)) AS p FROM var),
kept AS (SELECT parent, p FROM have EXCEPT SELECT parent, p FROM gone)
SELECT parent, count(*) AS n, min(p) AS first, max(p) AS last, sum(p % 1000)::BIGINT AS digits FROM kept GROUP BY parent""")
def o5d(spark: SparkSession, d: str) -> DataFrame:
    runs = regions.position_difference(base.transcripts(spark, d), base.exons(spark, d), "parent", "start", "end")
    upto = lambda x: F.floor(x / 1000) * 499500 + (x % 1000) * (x % 1000 - 1) / 2  # noqa: E731  # sum of p % 1000 for p below x
    return runs.groupBy("parent").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("n"), F.min("lo").alias("first"), (F.max("hi") - 1).alias("last"), F.sum(upto(F.col("hi")) - upto(F.col("lo"))).cast("bigint").alias("digits")
    )


@query("e7_typed_views", """SELECT t.id AS id, {'lo': t."start", 'hi': t."end"} AS idxs, t.strand = 1 AS is_fwd, t.strand = -1 AS is_rev, try_cast(chrom AS INT) AS chromosome
FROM (SELECT seq_region_name AS chrom, unnest("Transcript") AS t FROM genes1)""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    t = base.genes(spark, d).select("seq_region_name", F.explode("Transcript").alias("t")).select("seq_region_name", "t.*")
    return genes.typed(t).select("id", "idxs", "is_fwd", "is_rev", "chromosome")


# a made sequence for every exon, the same in both engines
_MADE = "GATCCATGACGTTAGCCATTACGGCATCAGTCAAGCTTGCAACGTGTCCATCGGA"


def _exon_sequences(spark: SparkSession, d: str) -> DataFrame:
    t = genes.transcripts_of(base.genes(spark, d)).select(F.explode("t.Exon").alias("e")).select(F.col("e.id").alias("exon_id"), (F.abs(F.col("e.end") - F.col("e.start")) + 1).cast("int").alias("n"))
    own = t.where("exon_id is not null and n is not null").groupBy("exon_id").agg(F.max("n").alias("n"))
    return own.select("exon_id", F.substr(F.repeat(F.lit(_MADE), F.ceil(F.col("n") / len(_MADE)).cast("int")), F.lit(1), F.col("n")).alias("seq"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return padlock.target_segments(base.genes(spark, d), base.exons(spark, d).where("id like '%1'"), "parent", _exon_sequences(spark, d))


@query("e12_target_segments", f"""
, canon AS (SELECT gene_id, min({{'id': t.id, 'strand': t.strand, 'e': t."Exon"[-1]}}) AS x FROM tx WHERE t.is_canonical = 1 GROUP BY gene_id),
ex AS (SELECT gene_id, x.id AS transcript_id, x.strand AS strand, x.e.id AS exon_id, least(x.e."start", x.e."end") AS rs, greatest(x.e."start", x.e."end") AS re FROM canon WHERE x.e.id IS NOT NULL AND x.e."start" + x.e."end" IS NOT NULL),
lens AS (SELECT id, max(n) AS n FROM (SELECT e.id AS id, abs(e."end" - e."start") + 1 AS n FROM (SELECT unnest(t."Exon") AS e FROM tx)) WHERE id IS NOT NULL AND n IS NOT NULL GROUP BY id),
var AS (SELECT parent, least(s, e) AS lo, greatest(s, e) AS hi FROM exon_rows WHERE s IS NOT NULL AND e IS NOT NULL AND id LIKE '%1'),
ev AS (SELECT ex.*, v.lo AS vlo, v.hi AS vhi FROM ex JOIN var v ON v.parent = transcript_id AND v.lo <= re AND v.hi >= rs UNION ALL SELECT ex.*, re + 1, re + 1 FROM ex),
runs AS (SELECT *, greatest(rs, coalesce(max(vhi) OVER (PARTITION BY gene_id ORDER BY vlo, vhi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, rs)) AS lo, vlo AS hi FROM ev),
seg AS (SELECT DISTINCT r.gene_id, transcript_id, exon_id, strand, lo, hi, hi - lo AS len, substr(repeat('{_MADE}', (n // {len(_MADE)} + 1)::INT), (CASE WHEN strand < 0 THEN n - (hi - rs) ELSE lo - rs END)::INT + 1, (hi - lo)::INT) AS seq
  FROM runs r JOIN lens ON lens.id = exon_id WHERE lo < hi),
cum AS (SELECT *, sum(len) OVER (PARTITION BY gene_id) - 10 - coalesce(sum(len) OVER (PARTITION BY gene_id ORDER BY CASE WHEN strand < 0 THEN -lo ELSE lo END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM seg)
SELECT gene_id, transcript_id, exon_id, CASE WHEN strand = 1 THEN 'fwd' ELSE 'rev' END AS strand_dir, (CASE WHEN strand < 0 THEN lo + len - least(len, room) ELSE lo END)::BIGINT AS genome_idx, left(seq, least(len, room)::INT) AS seq
FROM cum WHERE len > 40 AND (room >= len OR room >= 40)""")
def e12s(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query("e12_design_padlocks")
def e12(spark: SparkSession, d: str) -> DataFrame:
    out = padlock.design_for_genes(_segments(spark, d), "TCTAC{barcode}GCAGGTACC", base.barcodes(spark, d))
    return out.select("gene_id", "transcript_id", "exon_id", "genome_idx", "idx", "barcode", "padlock_seq", "score", "relaxed")


@query("io26_padlock_files", f"""SELECT gene AS gene_name, name0, name1, strand_dir, genome_idx, idx AS "index", gap_size, padlock_seq AS "sequence", barcode, seq_r AS right_arm, scaffold, seq_l AS left_arm,
round({tm_sql('seq_r')}, 3) AS right_tm, round({tm_sql('seq_l')}, 3) AS left_tm FROM padlock_hits""")
def io26(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV files and read again."""
    hits, path = table(spark, d, "padlock_hits"), work_folder(spark)
    tables.write_padlocks(hits, path)
    return spark.read.schema(padlock.padlock_table(hits).schema).csv(path, header=True)


# files


@query("io10_parse_origin", "SELECT id, coalesce(regexp_replace(seq, '[^A-Za-z]', '', 'g'), '') AS seq FROM recs WHERE NOT coalesce(regexp_matches(seq, '[^A-Za-z\\s\\d]'), FALSE)")
def io10(spark: SparkSession, d: str) -> DataFrame:
    """The letters of the ORIGIN section; records whose sequence has other marks than letters, blanks and digits aren't asked for."""
    own = base.records(spark, d).where("not coalesce(seq rlike '[^A-Za-z\\\\s\\\\d]', false)")
    return genbank.parse_genbank(genbank.genbank_text(own, "id"), "id", "text").select("id", F.coalesce("seq", F.lit("")).alias("seq"))


@query("io16_first_sequences", """SELECT id::VARCHAR || '.fa' AS path, seq FROM contigs WHERE seq <> ''
UNION ALL SELECT id::VARCHAR || '.gb', regexp_replace(seq, '[\\s\\d]', '', 'g') FROM recs UNION ALL SELECT id::VARCHAR || '.txt', NULL FROM contigs WHERE seq <> ''""")
def io16(spark: SparkSession, d: str) -> DataFrame:
    c = base.contigs(spark, d).where("seq <> ''").withColumn("t", F.concat(fasta.fasta_text(F.lit("first entry"), F.col("seq")), F.lit("\n"), fasta.fasta_text(F.lit("second"), F.reverse("seq"))))
    g = _flat(spark, d).select(F.concat(F.col("id").cast("string"), F.lit(".gb")).alias("path"), F.concat("text", "text").alias("t"))
    files = g
    for kind in (".fa", ".txt"):
        files = files.unionByName(c.select(F.concat(F.col("id").cast("string"), F.lit(kind)).alias("path"), "t"))
    return tables.first_sequences(files, "path", "t").withColumn("seq", F.when(F.col("path").endswith(".gb"), F.coalesce("seq", F.lit(""))).otherwise(F.col("seq"))).select("path", F.nullif("seq", F.lit("")).alias("seq"))


@query("io28_record_files", """SELECT info.name AS name, translate(upper(regexp_replace(seq, '[\\s\\d-]', '', 'g')), 'U', 'T') AS seq FROM recs WHERE info.name IS NOT NULL AND regexp_replace(seq, '[\\s\\d-]', '', 'g') <> ''""")
def io28(spark: SparkSession, d: str) -> DataFrame:
    """Records written as GenBank, read, written as JSON, read, written as FASTA and read again."""
    folder = work_folder(spark)
    own = base.records(spark, d).withColumn("seq", F.translate(F.upper(F.regexp_replace("seq", r"[\s\d-]", "")), "U", "T"))
    tables.to_genbank(own.where("seq <> ''"), f"{folder}/a.gb")
    tables.to_json(tables.from_genbank_like(spark, f"{folder}/a.gb"), f"{folder}/b.json")
    tables.to_fasta(spark.read.schema(tables.genbank.SCHEMA).json(f"{folder}/b.json"), f"{folder}/c.fa")
    return tables.from_fasta(spark, f"{folder}/c.fa")


# data sets


@query("io20_codon_usage_files", _USAGE + "SELECT division AS organism, aa, codon, round(freq, 6) AS freq FROM usage")
def io20u(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark)
    tables.write_codon_usage(_usage(spark, d), "division", path)
    return tables.read_codon_usage(spark, path).withColumn("freq", F.round("freq", 6))


@query("io23_codon_counts", _USAGE + ", every AS (SELECT DISTINCT division FROM usage) SELECT ascii(division) * 65536 + ascii(substr(division, 2)) * 256 + ascii(substr(division, 3)) AS organism_id, division AS organism, aa, codon, n, round(freq, 6) AS freq FROM usage")
def io23(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the tables' divisions, laid out as a codon count table and read from it; codons that don't occur are no rows of the SQL."""
    order = [c.replace("T", "U") for c in sorted(codon.CODONS)]
    counts = _usage(spark, d).groupBy("division").agg(F.map_from_entries(F.collect_list(F.struct("codon", "n"))).alias("m"))
    line = F.array_join(F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0)).cast("string") for c in sorted(codon.CODONS)]), " ")
    no = F.ascii("division") * 65536 + F.ascii(F.substring("division", 2, 1)) * 256 + F.ascii(F.substring("division", 3, 1))
    made = counts.select(F.concat(no.cast("string"), F.lit(":"), F.col("division"), F.lit(": 7\n"), line, F.lit(" \n")).alias("t"))
    return tables.parse_codon_counts(made, "t", order).where("n > 0").withColumn("freq", F.round("freq", 6)).withColumn("organism_id", F.col("organism_id").cast("int"))


def _enzyme_text(spark: SparkSession, d: str) -> DataFrame:
    """A list of enzymes laid out in eight numbered fields; each part of the table ``part`` is an enzyme with one of the known sites."""
    names = sorted(restriction.ENZYMES)
    site = F.get(F.array(*[F.lit(restriction.ENZYMES[n]) for n in names]), F.pmod("p_partkey", F.lit(len(names))).cast("int"))
    rows = table(spark, d, "part").select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("n"), site.alias("s"), F.lit("NX").alias("a"))
    gold = spark.createDataFrame([(n, restriction.ENZYMES[n], "N") for n in restriction.GOLDEN], "n string, s string, a string")
    return rows.unionByName(gold).select(F.format_string("<1>%s\n<2>\n<3>Inventa mirabilis\n<4>\n<5>%s\n<6>\n<7>%s\n<8>1", "n", "s", "a").alias("t"))


@query("io22_enzyme_build", ", names(n) AS (SELECT unnest([" + ", ".join(f"'{restriction.ENZYMES[n]}'" for n in sorted(restriction.ENZYMES)) + """])), nth AS (SELECT n, row_number() OVER () - 1 AS i FROM names),
every AS (SELECT 'E' || p_partkey AS enzyme, n AS shorthand, 'NX' AS availability FROM part JOIN nth ON i = p_partkey % (SELECT count(*) FROM names) UNION ALL SELECT * FROM (VALUES ('EcoRI', 'G^AATTC', 'N'), ('BsaI', 'GGTCTC(1/5)', 'N'), ('BaeI', '(10/15)ACNNNNGTAYC(12/7)', 'N')))
SELECT enzyme, 0 AS cutsite_no, shorthand, regexp_replace(regexp_replace(shorthand, '\\(.*?\\)', '', 'g'), '\\^', '') AS core, availability FROM every""")
def io22(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.parse_enzyme_records(_enzyme_text(spark, d), "t")
    built = restriction.build_enzyme_dataset(rows, "name", "sites", "availability", work_folder(spark))
    return built.select("enzyme", "cutsite_no", "shorthand", F.col("core_seq")[0].alias("core"), "availability")


@query("r4_wrong_sites", "SELECT * FROM (VALUES ('EcoRI', 'enzyme'), ('BsaI', 'shorthand'), ('BsaI', 'full_seq'), ('BsaI', 'full_regex'), ('BsaI', 'cut_fwd'), ('BsaI', 'cut_rev')) AS t(enzyme, field)")
def r4w(spark: SparkSession, d: str) -> DataFrame:
    """A data set without EcoRI, with a wrong BsaI and a right BaeI."""
    rows = spark.createDataFrame([("BsaI", "GGTCTC(2/6)", "N"), ("BaeI", restriction.ENZYMES["BaeI"], "N"), ("Other", "?,G^AATTC", None)], "n string, s string, a string")
    return restriction.wrong_sites(restriction.enzyme_dataset(rows, "n", "s", "a"))


@query("io22_enzyme_list", "SELECT * FROM (VALUES ('AclI', 'AA^CGTT'), ('BaeI', '(10/15)ACNNNNGTAYC(12/7)'), ('BspMI', 'ACCTGC(4/8)'), ('BfuAI', 'ACCTGC(4/8)')) AS t(name, sites)")
def io22l(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([("AA/CGTT AclI",), ("(10/15)ACNNNNGTAYC(12/7)    BaeI",), ("ACCTGC(4/8) BspMI BfuAI",), ("",)], "line string")
    return tables.parse_enzyme_list(lines, "line").select("name", "sites")


@query("sql1_functions", """SELECT id, translate(seq_l, 'ACGT', 'TGCA') AS c, reverse(translate(seq_l, 'ACGT', 'TGCA')) AS rc, round(length(regexp_replace(seq_l, '[^GC]', '', 'g')) / length(seq_l), 6) AS gc,
hamming(seq_l, seq_r)::INT AS hd, list_transform(range(1, length(seq_l) - 3), lambda i: substr(seq_l, i, 5)) AS words FROM oligos""")
def sql1(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    own = base.oligos(spark, d, "seq_l", "seq_r")
    return spark.sql(
        "SELECT id, seq_complement(seq_l) AS c, seq_reverse_complement(seq_l) AS rc, round(seq_gc_content(seq_l), 6) AS gc, seq_hamming(seq_l, seq_r) AS hd, seq_words(seq_l, 5) AS words FROM {own}", own=own
    )
