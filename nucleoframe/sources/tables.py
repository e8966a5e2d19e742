"""Dimension tables and files chosen by their kind."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.functions.codon import CODONS, codon_frequencies
from nucleoframe.operators.padlock import padlock_table
from nucleoframe.sources import genbank
from nucleoframe.sources.fasta import entries_of, parse_entries, read_fasta, write_fasta
from nucleoframe.sources.genbank import read_genbank


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``id, seq`` of a FASTA or GenBank file, by its extension."""
    kind = PurePath(path).suffix.lower()
    if kind in (".fa", ".fasta", ".faa", ".fna"):
        return read_fasta(spark, path).select("id", "seq")
    if kind in (".gb", ".gbk", ".genbank"):
        return read_genbank(spark, path).select(F.col("info.accession").alias("id"), "seq")
    raise ValueError(f"unknown kind of file: {path}")


def read_barcode_set(spark: SparkSession, path: str) -> DataFrame:
    """``barcode`` of a file with one JSON array of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("barcode"))


def write_barcode_set(pool: DataFrame, barcode: str, path: str) -> None:
    pool.agg(F.to_json(F.sort_array(F.collect_set(barcode))).alias("value")).write.text(path)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_padlocks(hits: DataFrame, path: str) -> None:
    """CSV files with the 14 columns of ``padlock_table``."""
    padlock_table(hits).write.csv(path, header=True, mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def first_sequences(files: DataFrame, path: str, text: str) -> DataFrame:
    """``path, seq``: of each file the sequence of its first entry, FASTA or GenBank by the extension; null for other kinds."""
    kind = F.lower(F.regexp_extract(F.col(path), r"\.(\w+)$", 1))
    own = files.select(F.col(path).alias("path"), F.col(text).alias("text"), kind.alias("kind"))
    fa = own.where(kind_of("fasta")).select("path", F.get(entries_of(F.col("text")), F.lit(0)).alias("e"))
    a = fa.select("path", F.regexp_replace(F.regexp_replace("e", r"^[^\r\n]*", ""), r"\s+", "").alias("seq"))
    gb = genbank.parse_genbank(own.where(kind_of("genbank")).select("path", F.regexp_extract("text", r"(?s)^(.*?)(?:\n//|$)", 1).alias("text")), "path", "text")
    rest = own.where(~(kind_of("fasta") | kind_of("genbank"))).select("path", F.lit(None).cast("string").alias("seq"))
    return a.unionByName(gb.select("path", "seq")).unionByName(rest).withColumnRenamed("path", path)


def kind_of(name: str) -> Column:
    kinds = {"fasta": ("fa", "fasta", "faa", "fna"), "genbank": ("gb", "gbk", "genbank")}
    return F.col("kind").isin(*kinds[name])


def from_fasta(spark: SparkSession, path: str, alphabet: str = "DNA", not_allowed: str = "") -> DataFrame:
    """Records ``name, seq`` of FASTA files; a letter outside the alphabet is an error."""
    return read_fasta(spark, path, mode="fail", alphabet=alphabet, not_allowed=not_allowed).select(F.col("id").alias("name"), "seq")


def from_genbank_like(spark: SparkSession, path: str) -> DataFrame:
    """Records ``info, features, seq`` of GenBank or JSON files, by the extension."""
    kind = PurePath(path).suffix.lower()
    if kind == ".gb":
        return read_genbank(spark, path).select("info", "features", "seq")
    if kind == ".json":
        return read_json_records(spark, path, genbank.SCHEMA)
    raise ValueError(f"only .json and .gb are supported: {path}")


def to_genbank(records: DataFrame, path: str, ordered: bool = False) -> None:
    """GenBank files of ``info, features, seq``."""
    genbank.genbank_text(records.withColumn("_nf_key", F.lit(0)), "_nf_key", ordered).select(F.col("text").alias("value")).write.text(path)


def to_json(records: DataFrame, path: str) -> None:
    """JSON files of ``info, features, seq``, one record a line."""
    records.select("info", "features", "seq").write.json(path, ignoreNullFields=False)


def to_fasta(records: DataFrame, path: str) -> None:
    """FASTA files of ``info.name`` and ``seq``."""
    write_fasta(records.select(F.col("info.name").alias("name"), "seq").where("name is not null and seq is not null"), "name", "seq", path)


def read_codon_usage(spark: SparkSession, path: str) -> DataFrame:
    """``organism, aa, codon, freq`` of files with one JSON object from organism to amino acid to codon to share."""
    text = spark.read.text(path, wholetext=True)
    o = text.select(F.explode(F.from_json("value", "map<string,map<string,map<string,double>>>")).alias("organism", "x"))
    return o.select("organism", F.explode("x").alias("aa", "y")).select("organism", "aa", F.explode("y").alias("codon", "freq"))


def write_codon_usage(usage: DataFrame, organism: str, path: str) -> None:
    """The JSON object that ``read_codon_usage`` reads: a dimension table of at most 64 rows an organism."""
    aas = usage.groupBy(F.col(organism).alias("o"), "aa").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("codon", "freq")))).alias("x"))
    orgs = aas.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("aa", "x"))).alias("x"))
    orgs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o", "x")))).alias("value")).write.text(path)


def parse_codon_counts(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``organism_id, organism, aa, codon, n, freq`` of texts of a codon count table.

    Two lines an organism: ``id:name: number`` and the counts of the codons in the given
    order (RNA or DNA letters), separated by blanks.  Shares are those among the codons of an amino acid.
    """
    pairs = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^(\d+:[^\n]*\n[\d ]+)$"), F.lit(1))
    p = rows.select(F.explode(pairs).alias("p")).select(F.regexp_extract("p", r"^(\d+):([^\n]*?)(?:: *\d+)?\n", 1).cast("bigint").alias("organism_id"), F.regexp_extract("p", r"^(\d+):([^\n]*?)(?:: *\d+)?\n", 2).alias("organism"), F.split(F.trim(F.substring_index("p", "\n", -1)), " +").alias("c"))
    names = F.array(*[F.lit(c.replace("U", "T")) for c in order])
    codes = F.create_map(*[F.lit(x) for c, a in CODONS.items() for x in (c, a)])
    each = p.select("organism_id", "organism", F.posexplode("c").alias("i", "n")).select("organism_id", "organism", F.get(names, F.col("i")).alias("codon"), F.col("n").cast("bigint").alias("n"))
    return codon_frequencies(each.withColumn("aa", F.try_element_at(codes, F.col("codon"))), ["organism_id", "aa"])


def parse_enzyme_records(rows: DataFrame, text: str) -> DataFrame:
    """``name, prototype, organism, source, sites, methylation, availability, refs`` of texts with records of eight numbered fields, ``<1>`` to ``<8>``."""
    each = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?ms)^(<1>.*?)(?=^<1>|\z)"), F.lit(1))).alias("r"))
    names = ("name", "prototype", "organism", "source", "sites", "methylation", "availability", "refs")
    return each.select(*[F.trim(F.regexp_extract("r", rf"(?m)^<{i}>([^\r\n]*)", 1)).alias(n) for i, n in enumerate(names, 1)])


def parse_enzyme_list(rows: DataFrame, line: str) -> DataFrame:
    """``name, sites, availability`` of lines ``site enzyme [alias ...]``, a row for each name; ``/`` outside brackets marks the cut."""
    words = F.split(F.trim(F.col(line)), r"\s+")
    site = F.regexp_replace(F.get(words, F.lit(0)), r"/(?![^(]*\))", "^")
    each = rows.where(F.trim(F.col(line)) != "").select(site.alias("sites"), F.explode(F.slice(words, 2, 1 << 10)).alias("name"))
    return each.select("name", "sites", F.lit(None).cast("string").alias("availability"))
