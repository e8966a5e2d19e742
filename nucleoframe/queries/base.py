"""Relations that the queries start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.common import latest_rows, table  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    run: Query
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        ENTRIES[name] = Entry(f, WITH + sql if sql else None)
        return f

    return add


def raws(spark: SparkSession, d: str) -> DataFrame:
    """``id, seq``: sequences as delivered, the current row of each record."""
    return latest_rows(table(spark, d, "genbank").select("rec_id", "loaded_at", "seq"), ["rec_id"], "loaded_at", ["seq"]).select(F.col("rec_id").alias("id"), "seq")


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """``id, seq``: sequences in upper case without blanks and digits, as DNA."""
    return raws(spark, d).where("seq is not null").select("id", F.translate(F.upper(F.regexp_replace("seq", r"[\s\d]+", "")), "U", "T").alias("seq"))


def coding(spark: SparkSession, d: str) -> DataFrame:
    """Contigs cut to whole codons."""
    return contigs(spark, d).select("id", F.substr("seq", F.lit(1), F.length("seq") - F.length("seq") % 3).alias("seq"))


def oligos(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``id`` and the named ones of ``seq, seq_l, seq_r, barcode``: the current padlock probes.  Only named columns are read and exchanged."""
    cols = ["padlock_seq" if c == "seq" else c for c in columns]
    now = latest_rows(table(spark, d, "padlock_hits").select("hit_id", "loaded_at", *cols), ["hit_id"], "loaded_at", cols)
    return now.select(F.col("hit_id").alias("id"), *[F.col(c).alias(n) for c, n in zip(cols, columns)])


def oligos_of(*columns: str) -> Query:
    """``oligos`` with these columns, under the name that SQL has for it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return oligos(spark, d, *columns)

    run.__name__ = "oligos"
    return run


def records(spark: SparkSession, d: str) -> DataFrame:
    """``id, info, features, seq`` of the current records; of several at the latest time that with the greatest values."""

    def with_qualifiers(f: Callable[[Column], Column]) -> Column:  # maps have no order, lists of their entries do
        return F.transform("features", lambda x: F.struct(x["type"].alias("type"), x["location"].alias("location"), f(x["qualifiers"]).alias("qualifiers"))).alias("features")

    rows = table(spark, d, "genbank").select("rec_id", "loaded_at", "seq", "info", with_qualifiers(F.map_entries))
    return latest_rows(rows, ["rec_id"], "loaded_at", ["seq", "info", "features"]).select(F.col("rec_id").alias("id"), "info", with_qualifiers(F.map_from_entries), "seq")


def proteins(spark: SparkSession, d: str) -> DataFrame:
    """``id, aa``: the letters of each translation; a feature's values after the first have their place in the id."""
    f = records(spark, d).select("id", F.posexplode("features").alias("_i", "f"))
    v = f.select("id", "_i", F.posexplode(F.try_element_at(F.col("f.qualifiers"), F.lit("translation"))).alias("_j", "v"))
    own = F.concat_ws("/", F.col("id").cast("string"), (F.col("_i") + 1).cast("string"), F.when(F.col("_j") > 0, (F.col("_j") + 1).cast("string")))
    return v.select(own.alias("id"), F.regexp_replace(F.upper("v"), "[^A-Z]", "").alias("aa")).where("aa <> ''")


def features(spark: SparkSession, d: str) -> DataFrame:
    """``id, feature_no, type, location``."""
    f = records(spark, d).select("id", F.posexplode("features").alias("_i", "f"))
    return f.select("id", (F.col("_i") + 1).alias("feature_no"), "f.type", "f.location")


def genes(spark: SparkSession, d: str) -> DataFrame:
    """The genes without doubled rows."""
    return table(spark, d, "genes").dropDuplicates(["id", "display_name", "strand", "start", "end", "seq_region_name", "species", "loaded_at"])


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Exon rows with the columns of array probes."""
    return table(spark, d, "exons").select(
        F.col("id").alias("probe_name"), "start", "end", (F.col("end") - F.col("start") + 1 - F.col("version") % 5).cast("int").alias("probe_length"), F.lit("exon").alias("feature_type"),
        F.col("assembly_name").alias("probe_set"), "seq_region_name", "strand", F.concat(F.lit("array"), F.col("version").cast("string")).alias("microarray"),
    )


def exons(spark: SparkSession, d: str) -> DataFrame:
    """``parent, start, end`` of exon rows with a parent."""
    from nucleoframe.common import bare_id

    return table(spark, d, "exons").where("Parent is not null").select(bare_id(F.col("Parent")).alias("parent"), "id", "start", "end", "seq_region_name", "strand")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """``parent, start, end, strand`` of the transcripts of the gene models."""
    t = genes(spark, d).select(F.explode("Transcript").alias("t"))
    return t.select(F.col("t.id").alias("parent"), "t.start", "t.end", "t.strand").distinct()


def barcodes(spark: SparkSession, d: str) -> list[str]:
    """The barcodes: a fixed table of some dozens."""
    rows = table(spark, d, "barcodes").select("barcode").where("barcode is not null").distinct().orderBy("barcode").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the barcode table is fixed and small")
    return [r["barcode"] for r in rows]


BARE_SQL = r"upper(regexp_replace(regexp_replace(regexp_replace(trim({c}), '^.*:', ''), '^\s+|\s+$', '', 'g'), '\.\d+$', ''))"
WITH = rf"""WITH RECURSIVE
recs AS (SELECT rec_id AS id, info, features, seq FROM genbank WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC NULLS LAST, seq DESC NULLS LAST) = 1),
raws AS (SELECT id, seq FROM recs),
contigs AS (SELECT id, replace(upper(regexp_replace(seq, '[\s\d]', '', 'g')), 'U', 'T') AS seq FROM recs WHERE seq IS NOT NULL),
coding AS (SELECT id, left(seq, length(seq) - length(seq) % 3) AS seq FROM contigs),
oligos AS (SELECT hit_id AS id, padlock_seq AS seq, seq_l, seq_r, barcode FROM padlock_hits WHERE hit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1),
feats AS (SELECT id, i AS feature_no, features[i] AS f FROM recs, unnest(range(1, len(features) + 1)) AS r(i)),
proteins AS (SELECT * FROM (SELECT id || '/' || feature_no || CASE WHEN j > 1 THEN '/' || j ELSE '' END AS id, regexp_replace(upper(v[j]), '[^A-Z]', '', 'g') AS aa
  FROM (SELECT id, feature_no, f.qualifiers['translation'] AS v FROM feats), unnest(range(1, len(v) + 1)) AS r(j)) WHERE aa <> ''),
genes1 AS (SELECT DISTINCT id, display_name, strand, "start", "end", seq_region_name, species, "Transcript", loaded_at FROM genes),
tx AS (SELECT g.id AS gene_id, g.display_name, g.strand AS gene_strand, g."start" AS gene_start, g."end" AS gene_end, t.u AS t FROM genes1 g, unnest(g."Transcript") AS t(u)),
transcripts AS (SELECT DISTINCT t.id AS parent, t."start" AS s, t."end" AS e, t.strand AS strand FROM tx),
exon_rows AS (SELECT {BARE_SQL.format(c='"Parent"')} AS parent, id, "start" AS s, "end" AS e, seq_region_name, strand FROM exons WHERE "Parent" IS NOT NULL),
probes AS (SELECT id AS probe_name, "start", "end", ("end" - "start" + 1 - version % 5)::INT AS probe_length, 'exon' AS feature_type, assembly_name AS probe_set, seq_region_name, strand, 'array' || version AS microarray FROM exons),
bars AS (SELECT DISTINCT barcode FROM barcodes WHERE barcode IS NOT NULL)
"""


def code_sql(s: str) -> str:
    """The packed integer of an A, C, G, T string."""
    return f"list_reduce(list_transform(string_split({s}, ''), lambda x: CASE x WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END::BIGINT), lambda a, b: a * 4 + b)"


def rc_sql(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"
