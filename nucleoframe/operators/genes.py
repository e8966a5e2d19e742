"""Genes, transcripts, exons, array probes and cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE_FIELDS = ["probe_name", "start", "end", "probe_length", "feature_type", "probe_set", "seq_region_name", "strand", "microarray"]


def unique_probes(probes: DataFrame) -> DataFrame:
    """Probes without rows that repeat all nine fields."""
    return probes.select(*PROBE_FIELDS).distinct()


def probes_by_name(probes: DataFrame) -> DataFrame:
    """One row per probe name: its arrays in order, the other fields from the first row in order of start and end."""
    rest = [c for c in PROBE_FIELDS if c not in ("probe_name", "microarray")]
    first = F.min(F.struct("start", "end", *[c for c in rest if c not in ("start", "end")])).alias("f")
    return unique_probes(probes).groupBy("probe_name").agg(first, F.sort_array(F.collect_set("microarray")).alias("microarrays")).select("probe_name", *[f"f.{c}" for c in rest], "microarrays")


def frequent_probes(probes: DataFrame, keep_n: int) -> DataFrame:
    """The distinct places of the ``keep_n`` probes on the most rows, with ``array_freq``; only those whose length fits their bounds."""
    freq = probes.groupBy("probe_name").agg(F.count("*").alias("array_freq")).orderBy(F.desc("array_freq"), "probe_name").limit(keep_n)
    places = probes.select([c for c in PROBE_FIELDS if c not in ("microarray", "probe_set", "feature_type")]).where(F.col("end") - F.col("start") + 1 == F.col("probe_length"))
    return places.join(freq, "probe_name").distinct()


def probe(probes: DataFrame, name: str) -> DataFrame:
    """The first row of a probe by its fields."""
    return probes.where(F.col("probe_name") == name).orderBy(*PROBE_FIELDS).limit(1)


def grouped_references(refs: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One row per database with its references in order."""
    return refs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("refs"))


def protein_coding(transcripts: Column) -> Column:
    """The transcripts whose biotype is protein_coding."""
    return F.filter(transcripts, lambda t: t["biotype"] == "protein_coding")


def transcripts_of(genes: DataFrame) -> DataFrame:
    """``gene_id, display_name, gene_strand, gene_start, gene_end, t``: one row per transcript."""
    return genes.select(
        F.col("id").alias("gene_id"), "display_name", F.col("strand").alias("gene_strand"), F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), F.explode("Transcript").alias("t")
    )


def last_exons(genes: DataFrame) -> DataFrame:
    """``display_name, transcript_id, exon_id``: the last exon of each canonical transcript; null where it has none."""
    t = transcripts_of(genes).where("t.is_canonical = 1")
    return t.select("display_name", F.col("t.id").alias("transcript_id"), F.try_element_at(F.col("t.Exon"), F.lit(-1))["id"].alias("exon_id"))


def gene_report(genes: DataFrame, variants: DataFrame, variant_key: str) -> DataFrame:
    """Per gene: number of transcripts, strand, length, and of the canonical transcript the exons, their summed length and the variants."""
    fields = ["display_name", "start", "end", "strand", "Transcript"]
    first = F.min(F.struct(F.col("display_name").isNull(), *fields)).alias("g")  # of several rows of a gene the first by name and place
    t = transcripts_of(genes.groupBy("id").agg(first).select("id", *[F.col(f"g.{c}").alias(c) for c in fields]))
    counted = t.groupBy("gene_id").agg(F.count("*").alias("transcripts"), F.max("gene_strand").alias("strand"), F.max(F.col("gene_end") - F.col("gene_start") + 1).alias("gene_length"))
    canonical = t.where("t.is_canonical = 1").select(
        "gene_id", F.col("t.id").alias("transcript_id"), F.coalesce(F.size("t.Exon"), F.lit(0)).alias("exons"),
        F.aggregate(F.coalesce(F.col("t.Exon"), F.array()), F.lit(0).cast("bigint"), lambda s, e: s + e["end"] - e["start"] + 1).alias("exon_length"),
    )
    v = variants.groupBy(F.col(variant_key).alias("transcript_id")).agg(F.count("*").alias("variants"))
    return counted.join(canonical, "gene_id", "left").join(v, "transcript_id", "left").withColumn("variants", F.coalesce("variants", F.lit(0)))


def exon_offsets(genes: DataFrame) -> DataFrame:
    """``gene_id, transcript_id, exon_no, exon_id, from_gene_start, length``: exons in places relative to their gene."""
    e = transcripts_of(genes).select("gene_id", "gene_start", F.col("t.id").alias("transcript_id"), F.posexplode("t.Exon").alias("_i", "e"))
    return e.select("gene_id", "transcript_id", (F.col("_i") + 1).alias("exon_no"), F.col("e.id").alias("exon_id"), (F.col("e.start") - F.col("gene_start")).alias("from_gene_start"), (F.col("e.end") - F.col("e.start") + 1).alias("length"))


def typed(rows: DataFrame) -> DataFrame:
    """Genes, transcripts or exons with ``idxs`` (first and last place), ``is_fwd``, ``is_rev`` and ``chromosome`` (a number, else null)."""
    return rows.withColumns({
        "idxs": F.struct(F.col("start").alias("lo"), F.col("end").alias("hi")), "is_fwd": F.col("strand") == 1, "is_rev": F.col("strand") == -1,
        "chromosome": F.col("seq_region_name").try_cast("int"),
    })
