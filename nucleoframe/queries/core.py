"""All queries outside the subpackage llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.common import table
from nucleoframe.operators.islands import exon_periods
from nucleoframe.operators.nested import SchemaGraph, lookup_genes, nested_parts
from nucleoframe.queries import base, datasets, relational, scalars  # noqa: F401


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exon_periods(table(spark, sf_dir, "exons"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_parts(table(spark, sf_dir, "lookup_raw"), table(spark, sf_dir, "genbank"))


def p4_json_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema graph of the looked-up genes, from all of them: scalar fields with their types, elements with one or many."""
    found = lookup_genes(table(spark, sf_dir, "lookup_raw")).select(F.to_json("gene").alias("text"))
    graph = SchemaGraph.of_json(found, "text", "Gene")
    rows = [(e.name, f, k) for e in graph.elements.values() for f, k in e.scalars.items()] + [(e.name, x.name, "many" if x.many else "one") for e in graph.elements.values() for x in e.edges]
    return spark.createDataFrame(rows, "element string, field string, kind string")


P3_SQL = r"""
WITH cur AS (
  SELECT upper(regexp_replace(regexp_replace(regexp_replace(trim("Parent"), '^.*:', ''), '^\s+|\s+$', '', 'g'), '\.\d+$', '')) AS parent, id, seq_region_name, least("start", "end") AS lo, greatest("start", "end") AS hi, "start" AS s, "end" AS e
  FROM exons WHERE "Parent" IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(regexp_replace(regexp_replace(regexp_replace(trim("Parent"), '^.*:', ''), '^\s+|\s+$', '', 'g'), '\.\d+$', '')), id ORDER BY loaded_at DESC NULLS LAST) = 1),
ok AS (SELECT DISTINCT parent, seq_region_name, lo, hi FROM cur WHERE s IS NOT NULL AND e IS NOT NULL),
marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY parent, seq_region_name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM ok),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY parent, seq_region_name ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM marked),
periods AS (SELECT parent, seq_region_name, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY parent, seq_region_name, isle),
gaps AS (SELECT parent, seq_region_name, hi + 1 AS lo, lead(lo) OVER (PARTITION BY parent, seq_region_name ORDER BY lo) - 1 AS hi FROM periods)
SELECT parent, seq_region_name, 'period' AS kind, lo AS start_pos, hi AS end_pos FROM periods
UNION ALL SELECT parent, seq_region_name, 'gap', lo, hi FROM gaps WHERE hi IS NOT NULL
"""

P4_SQL = r"""
WITH payloads AS (SELECT raw_id, fetched_at, payload::JSON AS j FROM lookup_raw WHERE json_valid(payload)),
entries AS (
  SELECT raw_id, fetched_at, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.object_type') THEN [j] WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$.*') ELSE [] END) AS g FROM payloads),
genes_ AS (
  SELECT g, g ->> '$.id' AS gid FROM entries WHERE g ->> '$.object_type' = 'Gene' AND g ->> '$.id' <> ''
  QUALIFY row_number() OVER (PARTITION BY gid ORDER BY fetched_at DESC NULLS LAST, raw_id DESC) = 1),
tx AS (SELECT gid, unnest(CASE json_type(g, '$.Transcript') WHEN 'ARRAY' THEN json_extract(g, '$.Transcript[*]') WHEN 'OBJECT' THEN [json_extract(g, '$.Transcript')] ELSE [] END) AS t FROM genes_),
ex AS (SELECT gid, t ->> '$.id' AS tid, CASE json_type(t, '$.Exon') WHEN 'ARRAY' THEN json_extract(t, '$.Exon[*]') WHEN 'OBJECT' THEN [json_extract(t, '$.Exon')] ELSE [] END AS es FROM tx),
exon AS (SELECT gid, tid, i, es[i] ->> '$.id' AS eid FROM ex, unnest(range(1, len(es) + 1)) AS r(i)),
rec AS (SELECT rec_id, features FROM genbank QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC NULLS LAST) = 1),
feat AS (SELECT rec_id, i AS place, features[i] AS f FROM rec, unnest(range(1, len(features) + 1)) AS r(i)),
parts AS (SELECT rec_id, place, string_split(regexp_replace(regexp_replace(f.location, '[\s<>)]|complement|join|order', '', 'g'), '[(]', '', 'g'), ',') AS p FROM feat WHERE f.location <> ''),
part AS (SELECT rec_id, place, i, replace(p[i], '^', '..') AS x FROM parts, unnest(range(1, len(p) + 1)) AS r(i)),
vals AS (SELECT rec_id, place, f.qualifiers['translation'] AS v FROM feat),
val AS (SELECT rec_id, place, i, length(regexp_replace(v[i], '[^A-Za-z]', '', 'g')) AS n FROM vals, unnest(range(1, len(v) + 1)) AS r(i))
SELECT 'exon' AS kind, gid AS root_id, tid AS parent_key, i::INT AS child_no, eid AS child_key FROM exon WHERE eid <> ''
UNION ALL SELECT 'location', rec_id::VARCHAR, place::VARCHAR, i::INT, CASE WHEN contains(x, '..') THEN x ELSE x || '..' || regexp_extract(x, '\d+$') END FROM part WHERE x <> ''
UNION ALL SELECT 'translation', rec_id::VARCHAR, place::VARCHAR, i::INT, n::VARCHAR FROM val WHERE n > 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p4_found": p4_found, "p4_json_graph": p4_json_graph} | {name: e.run for name, e in base.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    """Operators that draw at random, render text or search exhaustively in Python have none; tests check those."""
    return {"p3_found": P3_SQL, "p4_found": P4_SQL} | {name: e.sql for name, e in base.ENTRIES.items() if e.sql}
