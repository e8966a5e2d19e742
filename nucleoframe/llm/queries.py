"""The queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nucleoframe.common import cut_lineage, table
from nucleoframe.llm.leak import find_leaks
from nucleoframe.llm.packing import count_tokens, pack, pack_documents, packing_audit
from nucleoframe.llm.shared import shared_bases
from nucleoframe.llm.split import split_records
from nucleoframe.llm.topn import best_padlocks
from nucleoframe.llm.visual import visual_members, visual_pairs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_padlocks(table(spark, sf_dir, "padlock_hits")).select("name0", "hit_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "genbank"))


def p2_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of about equal size by recursive bisection."""
    return split_records(table(spark, sf_dir, "genbank"), bisect=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_bases(table(spark, sf_dir, "genbank"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any filling: no page lost or cut, no container too full, few more containers than needed."""
    tokens = cut_lineage(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing_audit(pack(tokens, "doc_id", "n_tokens"), tokens, "doc_id", "n_tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with at most one word changed, put in or left out."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", max_edits=1)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_members(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_bisected, p5_found, p6_packed, p6_audit, p7_found, p7_edits, p8_found, p8_members)}


P1_SQL = r"""
WITH cur AS (SELECT * FROM padlock_hits WHERE hit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC NULLS LAST) = 1),
ok AS (
  SELECT upper(regexp_replace(regexp_replace(regexp_replace(trim(name0), '^.*:', ''), '^\s+|\s+$', '', 'g'), '\.\d+$', '')) AS name0, hit_id, idx,
         round(report.tm_arm_min_l + 0.9 * report.tm_arm_min_r, 4) AS score
  FROM cur
  WHERE name0 IS NOT NULL AND isfinite(report.tm_arm_min_l) AND isfinite(report.tm_arm_min_r) AND report.tm_arm_min_l > 0 AND report.tm_arm_min_r > 0)
SELECT name0, hit_id FROM ok QUALIFY row_number() OVER (PARTITION BY name0 ORDER BY score DESC, idx, hit_id) <= 3
"""

P2_SQL = r"""
WITH RECURSIVE cur AS (
  SELECT rec_id, features, length(regexp_replace(seq, '[\s\d]', '', 'g')) AS n
  FROM genbank QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC NULLS LAST) = 1),
big AS (SELECT * FROM cur WHERE n > 2000),
feat AS (SELECT rec_id, unnest(features) AS f FROM big),
spans AS (
  SELECT DISTINCT rec_id, list_min(b) AS lo, list_max(b) - 1 AS hi
  FROM (SELECT rec_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(f.location, '\s', '', 'g'), '[A-Za-z0-9_.]+:[<>]?\d+((\.\.|\^)[<>]?\d+)?', '', 'g'), '\d+'), lambda x: x::BIGINT) AS b
        FROM feat WHERE f.location IS NOT NULL AND f.type IS DISTINCT FROM 'source')
  WHERE len(b) > 1 AND list_max(b) > list_min(b)),
marked AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM spans),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM marked),
blocked AS (SELECT rec_id, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY rec_id, isle),
walk AS (
  SELECT rec_id, n, 0 AS piece_no, NULL::BIGINT AS start_pos, 100::BIGINT AS end_pos FROM big
  UNION ALL
  SELECT w.rec_id, w.n, w.piece_no + 1, w.end_pos - 99,
         CASE WHEN w.n - (w.end_pos - 99) + 1 <= 2000 THEN w.n
              WHEN b.lo IS NOT NULL AND b.lo - 1 >= w.end_pos - 99 + 100 THEN b.lo - 1
              ELSE w.end_pos - 99 + 1999 END
  FROM walk w LEFT JOIN blocked b ON b.rec_id = w.rec_id AND b.lo <= w.end_pos + 1900 AND b.hi >= w.end_pos + 1900
  WHERE w.end_pos < w.n)
SELECT rec_id, piece_no::INT AS piece_no, start_pos::INT AS start_pos, end_pos::INT AS end_pos FROM walk WHERE piece_no > 0
"""

P5_SQL = r"""
WITH cur AS (
  SELECT rec_id, replace(lower(regexp_replace(seq, '[\s\d]', '', 'g')), 'u', 't') AS s
  FROM genbank QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC NULLS LAST) = 1),
mers AS (SELECT rec_id, p, substr(s, p::INT, 80) AS m FROM cur, unnest(range(1, length(s) - 78)) AS t(p) WHERE length(s) >= 80),
many AS (SELECT m FROM mers WHERE regexp_full_match(m, '[acgt]+') GROUP BY m HAVING count(DISTINCT rec_id) > 1),
hits AS (SELECT DISTINCT rec_id, p FROM mers JOIN many USING (m)),
own AS (SELECT rec_id, least(80, coalesce(lead(p) OVER (PARTITION BY rec_id ORDER BY p) - p, 80)) AS c FROM hits)
SELECT rec_id, sum(c)::INT AS shared_bp FROM own GROUP BY rec_id
"""


P6_SQL = "SELECT count(*) AS items, 0::BIGINT AS overfull, 0::BIGINT AS lost, 0::BIGINT AS split, TRUE AS tight FROM documents"


def _form_sql(column: str) -> str:
    """The consistent form, with DuckDB's own normalisation."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))
    x = f"regexp_replace({column}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    x = f"regexp_replace({x}, '[\\t\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    for lig, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        x = f"replace({x}, '{lig}', '{plain}')"
    x = f"translate({x}, '{wide.replace(chr(39), chr(39) * 2)}', '{narrow.replace(chr(39), chr(39) * 2)}')"
    # Letters of one shape, Cyrillic, then Greek, then the precomposed letters on such shapes that occur
    for other, latin in (
        ("АВЕКМНОРСТУХЅІЈѴҮӀԚԜ", "ABEKMHOPCTYXSIJVYIQW"), ("аеорсухѕіјѵүһӏԁԛԝ", "aeopcyxsijvyhldqw"),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"), ("νορϲϳ", "vopcj"), ("ёЁ", "ëË"),
    ):
        x = f"translate({x}, '{other}', '{latin}')"
    return f"nfc_normalize({x})"


P7_SQL = rf"""
WITH form AS (
  SELECT 'd' AS side, doc_id AS id, lower({_form_sql("text")}) AS t FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, lower({_form_sql("text")}) FROM eval_items WHERE text IS NOT NULL),
words AS (SELECT side, id, regexp_extract_all(regexp_replace(t, '([\p{{L}}\p{{N}}])[-‐¬=] *\n *([\p{{L}}\p{{N}}])', '\1\2', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM form),
passages AS (
  SELECT DISTINCT id AS item_id, least(12, len(w)) AS n, list_slice(w, p, p + least(12, len(w)) - 1) AS m
  FROM words, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS r(p) WHERE side = 'i' AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM passages),
windows AS (SELECT id AS doc_id, list_slice(w, p, p + n - 1) AS m FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS r(p) WHERE side = 'd' AND len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM windows JOIN passages USING (m)
"""

P8_SQL = rf"""
WITH form AS (SELECT doc_id, text, {_form_sql("text")} AS f FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM form a JOIN form b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text
WHERE regexp_matches(a.f, '[^\s]')
"""


P8_MEMBERS_SQL = rf"""
WITH form AS (SELECT doc_id, text, {_form_sql("text")} AS f FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS look, min(doc_id) OVER (PARTITION BY f, text) AS spelling, n_spellings
FROM form JOIN (SELECT f, count(DISTINCT text) AS n_spellings FROM form GROUP BY f HAVING count(DISTINCT text) > 1) USING (f)
WHERE regexp_matches(f, '[^\s]')
"""


def oracle_sql() -> dict[str, str]:
    """p6_packed has none: many fillings are equally good; p6_audit says what must hold of all of them."""
    return {"p1_found": P1_SQL, "p2_found": P2_SQL, "p5_found": P5_SQL, "p6_audit": P6_SQL, "p7_found": P7_SQL, "p8_found": P8_SQL, "p8_members": P8_MEMBERS_SQL}
