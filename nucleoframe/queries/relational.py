"""Queries of repeats, joins, graphs, regions, genes, probes, records, duplexes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.common import table
from nucleoframe.functions import bits
from nucleoframe.functions.seq import reverse_complement
from nucleoframe.operators import duplex, genes, graph, islands, kmers, padlock, records, regions, restriction, seeds, similarity
from nucleoframe.queries import base
from nucleoframe.queries.base import query, rc_sql
from nucleoframe.queries.scalars import tm_sql
from nucleoframe.sources import fasta, genbank, xmfa

# words and repeats

_KMERS = """, km AS (SELECT id, p, substr(seq, p::INT + 1, 8) AS w FROM contigs, unnest(range(0, length(seq) - 7)) AS r(p) WHERE length(seq) >= 8),
good AS (SELECT * FROM km WHERE regexp_full_match(w, '[ACGT]{8}')),
idx AS (SELECT id, p, w, lead(p) OVER x AS nxt, lag(p) OVER x AS prev FROM good WINDOW x AS (PARTITION BY id, w ORDER BY p)),
rep AS (SELECT * FROM idx WHERE nxt IS NOT NULL OR prev IS NOT NULL)
"""


@query("pm10_word_list", "SELECT id, list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8)) || list_transform(range(1, length(seq) - 6), lambda i: substr(reverse(translate(seq, 'ACGT', 'TGCA')), i, 8)) AS words FROM oligos")
def pm10(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq").select("id", kmers.word_list(F.col("seq"), 8, True).alias("words"))


@query("pm11_word_counts", _KMERS + "SELECT id, w AS word, count(*) AS n FROM km GROUP BY id, w")
def pm11(spark: SparkSession, d: str) -> DataFrame:
    return kmers.word_counts(base.contigs(spark, d), "id", "seq", 8)


@query("pm12_duplicate_words", _KMERS + ", c AS (SELECT id, w, count(*) AS n FROM km GROUP BY id, w) SELECT g.id, count(c.w) AS duplicates FROM contigs g LEFT JOIN c ON c.id = g.id AND c.n > 1 GROUP BY g.id")
def pm12(spark: SparkSession, d: str) -> DataFrame:
    return kmers.duplicate_words(base.contigs(spark, d), "id", "seq", 8)


@query("w1_repeat_index", _KMERS + "SELECT id, p AS pos, w AS word, nxt, prev, coalesce(nxt, -1) AS code FROM rep")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return kmers.repeat_index(base.contigs(spark, d), "id", "seq", 8)


@query("w3_places_of", "SELECT id, p AS pos FROM contigs, unnest(range(0, length(seq))) AS r(p) WHERE substr(seq, p::INT + 1, 6) = 'GATAGA'")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return kmers.places_of(base.contigs(spark, d), "id", "seq", "gataga")


@query("w4_screen_ends", _KMERS + """SELECT g.id, count(r.p) FILTER (WHERE r.p < 200) > 0 AS five, count(r.p) FILTER (WHERE r.nxt IS NULL AND r.p >= length(g.seq) - 7 - 200) > 0 AS three
FROM contigs g LEFT JOIN rep r ON r.id = g.id GROUP BY g.id""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return kmers.screen_ends(base.contigs(spark, d), "id", "seq", 8, 200)


@query("w5_close_repeats", _KMERS + """, near AS (SELECT id, p, nxt, nxt - p AS dist, p - row_number() OVER (PARTITION BY id, nxt - p ORDER BY p) AS isle FROM idx WHERE nxt - p < 500)
SELECT id, min(p) AS first, min(nxt) AS second, count(*) + 7 AS length FROM near GROUP BY id, dist, isle""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return kmers.close_repeats(base.contigs(spark, d), "id", "seq", 8, 500)


@query("w6_all_repeats")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return kmers.all_repeats(base.contigs(spark, d), "id", "seq", 12)


@query("w7_window_counts", _KMERS + """, pairs AS (SELECT i.id, greatest(nxt - 192, 0) AS lo, least(p, length(g.seq) - 200) AS hi FROM idx i JOIN contigs g USING (id) WHERE nxt - p <= 192 AND length(g.seq) >= 200)
SELECT id, s AS start, count(*) AS n FROM pairs, unnest(range(lo, hi + 1)) AS r(s) GROUP BY id, s HAVING count(*) > 1""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return kmers.window_counts(base.contigs(spark, d), "id", "seq", 8, 200, 1)


@query("w8_window_words", """, part AS (SELECT id, substr(seq, 101, 400) AS s FROM contigs WHERE length(seq) >= 500), pk AS (SELECT id, p + 100 AS p, substr(s, p::INT + 1, 8) AS w FROM part, unnest(range(0, 393)) AS r(p))
SELECT id, w AS word, list(p ORDER BY p) AS places FROM pk WHERE regexp_full_match(w, '[ACGT]{8}') GROUP BY id, w HAVING count(*) > 1""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return kmers.window_words(base.contigs(spark, d), "id", "seq", 8, 100, 400)


@query("w9_repeated_fraction", _KMERS + """, cov AS (SELECT DISTINCT id, p + i AS b FROM rep, unnest(range(0, 8)) AS r(i))
SELECT g.id, CASE WHEN length(g.seq) > 0 THEN round(count(c.b) / length(g.seq), 6) END AS fraction FROM contigs g LEFT JOIN cov c ON c.id = g.id GROUP BY g.id, g.seq""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return kmers.repeated_fraction(base.contigs(spark, d), "id", "seq", 8).withColumn("fraction", F.round("fraction", 6))


@query("w10_window_fractions", _KMERS + """, lastp AS (SELECT id, s AS start, p, lag(p) OVER (PARTITION BY id, s ORDER BY p) AS before
  FROM (SELECT r.id, r.p, unnest(range(greatest(r.p - 92, 0), least(r.p, length(g.seq) - 100) + 1)) AS s FROM rep r JOIN contigs g USING (id) WHERE length(g.seq) >= 100))
SELECT id, start, sum(least(8, p - coalesce(before, p - 8)))::BIGINT AS covered FROM lastp GROUP BY id, start HAVING covered > 40""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return kmers.window_fractions(base.contigs(spark, d), "id", "seq", 8, 100, 0.4)


@query("w12_anchored_groups", """, st AS (SELECT name0 AS k, list(DISTINCT idx ORDER BY idx) AS s FROM padlock_hits WHERE name0 IS NOT NULL AND idx IS NOT NULL GROUP BY name0),
walk AS (SELECT k, s, 1 AS i, s[1] AS anchor FROM st UNION ALL SELECT k, s, i + 1, CASE WHEN s[i + 1] > anchor + 60 THEN s[i + 1] ELSE anchor END FROM walk WHERE i < len(s))
SELECT k AS name0, s[i] AS idx, anchor AS group_start FROM walk""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "padlock_hits").where("name0 is not null and idx is not null").groupBy("name0").agg(F.sort_array(F.collect_set("idx")).alias("s"))
    z = h.select("name0", F.explode(F.arrays_zip("s", padlock.anchored_groups(F.col("s"), 60).alias("a"))).alias("z"))
    return z.select("name0", F.col("z.s").alias("idx"), F.col("z.a").alias("group_start"))


@query("w13_best_of_group", "SELECT name1, hit_id FROM padlock_hits WHERE name1 IS NOT NULL AND isfinite(right_tm) AND isfinite(left_tm) QUALIFY row_number() OVER (PARTITION BY name1 ORDER BY round(left_tm + 0.9 * right_tm, 4) DESC, idx, hit_id, loaded_at) = 1")
def w13(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "padlock_hits").where("name1 is not null and not isnan(right_tm) and not isnan(left_tm) and abs(right_tm) < double('Infinity') and abs(left_tm) < double('Infinity')")
    key = F.struct(F.round(-(F.col("left_tm") + 0.9 * F.col("right_tm")), 4), "idx", "hit_id", "loaded_at")
    return h.groupBy("name1").agg(F.min_by("hit_id", key).alias("hit_id"))


# joins

_TARGETS = """, targets AS (SELECT id, substr(seq, 101, {m}) AS t FROM contigs WHERE length(seq) >= 120 AND regexp_full_match(substr(seq, 101, {m}), '[ACGT]+')),
win AS (SELECT id AS ref_id, o::INT AS "offset", substr(seq, o::INT + 1, {m}) AS w FROM contigs, unnest(range(0, length(seq) - {m} + 1)) AS r(o) WHERE length(seq) >= {m})
"""


def _targets(spark: SparkSession, d: str, m: int) -> DataFrame:
    return base.contigs(spark, d).where(F.length("seq") >= 120).select("id", F.substring("seq", 101, m).alias("t")).where(F.col("t").rlike("^[ACGT]+$"))


@query("j1_exact_join", _TARGETS.format(m=20) + 'SELECT t.id AS target_id, ref_id, "offset", 0 AS hd FROM targets t JOIN win ON w = t.t')
def j1(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similarity_join(_targets(spark, d, 20), "id", "t", base.contigs(spark, d), "id", "seq", 20, 0)


@query("j2_seed_keys", "SELECT id, list_transform(range(0, 6), lambda s: {'shift': s::INT, 'look': substr(seq_l, s + 1, 3) || substr(seq_l, s + 5, 3) || substr(seq_l, s + 9, 3) || substr(seq_l, s + 13, 3)}) AS keys FROM oligos")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq_l").select("id", similarity.seed_keys(F.col("seq_l"), "###-###-###-###-", 20).alias("keys"))


_NEAR = 'SELECT t.id AS target_id, ref_id, "offset", hamming(t.t, w)::INT AS hd FROM targets t, win WHERE hamming(t.t, w) <= 1'
_HALVES = """, cand AS (SELECT t.id, t.t, win.* FROM targets t JOIN win ON left(t.t, 10) = left(w, 10) UNION SELECT t.id, t.t, win.* FROM targets t JOIN win ON right(t.t, 10) = right(w, 10))
SELECT id AS target_id, ref_id, "offset", hamming(t, w)::INT AS hd FROM cand WHERE hamming(t, w) <= 1"""


@query("j3_seed_join", _TARGETS.format(m=19) + _NEAR)
def j3(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similarity_join(_targets(spark, d, 19), "id", "t", base.contigs(spark, d), "id", "seq", 19, 1, "seed")


@query("j4_brute_join", """, places AS (SELECT b.barcode AS target_id, g.id AS ref_id, o::INT AS "offset", greatest(-o, 0)::INT AS skip, least(5, length(seq) - o)::INT - greatest(-o, 0)::INT AS n, seq
  FROM bars b, contigs g, unnest(range(-2, length(seq) - 2)) AS r(o))
SELECT target_id, ref_id, "offset", 0 AS hd FROM places WHERE n > 0 AND substr(target_id, skip + 1, n) = substr(seq, greatest("offset", 0) + 1, n)""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "barcodes").select("barcode").distinct()
    return similarity.similarity_join(pool, "barcode", "barcode", base.contigs(spark, d), "id", "seq", 5, 0, overhang=2)


@query("j5_similarity_join", _TARGETS.format(m=20) + _HALVES)
def j5(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similarity_join(_targets(spark, d, 20), "id", "t", base.contigs(spark, d), "id", "seq", 20, 1)


@query("pm17_misprimes", _TARGETS.format(m=14) + """, prim AS (SELECT barcode AS id, barcode || reverse(barcode) || left(barcode, 4) AS t FROM bars),
cand AS (SELECT t.id, t.t, w FROM prim t JOIN win ON left(t.t, 7) = left(w, 7) UNION SELECT t.id, t.t, w FROM prim t JOIN win ON right(t.t, 7) = right(w, 7))
SELECT DISTINCT id FROM cand WHERE hamming(t, w) < 2""")
def pm17(spark: SparkSession, d: str) -> DataFrame:
    primers = table(spark, d, "barcodes").select("barcode").where("barcode is not null").distinct().withColumn("t", F.expr("concat(barcode, reverse(barcode), left(barcode, 4))"))
    return similarity.misprimes(primers, "barcode", "t", base.contigs(spark, d), "id", "seq", 14, 2).withColumnRenamed("barcode", "id")


_ENZYMES = ["EcoRI", "BamHI", "HindIII", "BsaI", "HinfI"]
_SITES_SQL = """, pats(enzyme, cutsite_no, strand, pat, pair, cf, cr) AS (VALUES
 ('EcoRI', 0, 1, 'GAATTC', 'GAATTC', [1], [5]), ('EcoRI', 0, -1, 'GAATTC', 'GAATTC', [1], [5]),
 ('BamHI', 0, 1, 'GGATCC', 'GGATCC', [1], [5]), ('BamHI', 0, -1, 'GGATCC', 'GGATCC', [1], [5]),
 ('HindIII', 0, 1, 'AAGCTT', 'AAGCTT', [1], [5]), ('HindIII', 0, -1, 'AAGCTT', 'AAGCTT', [1], [5]),
 ('BsaI', 0, 1, 'GGTCTC[ATGC]{5}', '[ATGC]{5}GAGACC', [7], [11]), ('BsaI', 0, -1, '[ATGC]{5}GAGACC', 'GGTCTC[ATGC]{5}', [7], [11]),
 ('HinfI', 0, 1, 'GA[ATGC]{1}TC', 'GA[ATGC]{1}TC', [1], [4]), ('HinfI', 0, -1, 'GA[ATGC]{1}TC', 'GA[ATGC]{1}TC', [1], [4])),
 hits AS (SELECT id, p.*, string_split_regex(seq, pat) AS parts, regexp_extract_all(seq, pat) AS found FROM contigs, pats p)
"""


@query("j6_find_sites", _SITES_SQL + """SELECT id, enzyme, cutsite_no, strand, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::INT AS start_idx,
 (list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))))::INT AS end_idx, cf AS cut_fwd, cr AS cut_rev, pair AS pair_regex FROM hits, unnest(range(1, len(found) + 1)) AS r(i)""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return restriction.find_sites(base.contigs(spark, d), "id", "seq", restriction.sites_of(_ENZYMES))


@query("j7_count_sites", _SITES_SQL + "SELECT id, enzyme, cutsite_no, sum(len(found))::INT AS n FROM hits GROUP BY id, enzyme, cutsite_no")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return restriction.count_sites(base.contigs(spark, d), "id", "seq", restriction.sites_of(_ENZYMES))


@query("j8_has_sites", "SELECT id, regexp_matches(seq, 'GGTCTC[ATGC]{5}|[ATGC]{5}GAGACC|GCGGCCGC') AS present FROM contigs")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return base.contigs(spark, d).select("id", restriction.has_sites(F.col("seq"), restriction.sites_of(["BsaI", "NotI"])).alias("present"))


_GOLD = """SELECT * FROM (VALUES
 ('EcoRI', 0, 'G^AATTC', ['GAATTC', 'GAATTC'], ['GAATTC', 'GAATTC'], ['GAATTC', 'GAATTC'], ['GAATTC', 'GAATTC'], [1], [5]),
 ('BsaI', 0, 'GGTCTC(1/5)', ['GGTCTC', 'GAGACC'], ['GGTCTCNNNNN', 'NNNNNGAGACC'], ['GGTCTC', 'GAGACC'], ['GGTCTC[ATGC]{5}', '[ATGC]{5}GAGACC'], [7], [11]),
 ('BaeI', 0, '(10/15)ACNNNNGTAYC(12/7)', ['ACNNNNGTAYC', 'GRTACNNNNGT'], ['NNNNNNNNNNNNNNNACNNNNGTAYCNNNNNNNNNNNN', 'NNNNNNNNNNNNGRTACNNNNGTNNNNNNNNNNNNNNN'],
  ['AC[ATGC]{4}GTA[CT]C', 'G[AG]TAC[ATGC]{4}GT'], ['[ATGC]{15}AC[ATGC]{4}GTA[CT]C[ATGC]{12}', '[ATGC]{12}G[AG]TAC[ATGC]{4}GT[ATGC]{15}'], [5, 38], [0, 33]))
 AS t(enzyme, cutsite_no, shorthand, core_seq, full_seq, core_regex, full_regex, cut_fwd, cut_rev)"""


@query("j9_enzyme_regexes", f"SELECT enzyme, cutsite_no, full_regex FROM ({_GOLD})")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return restriction.enzyme_table(spark, ["EcoRI", "BsaI", "BaeI"]).select("enzyme", "cutsite_no", "full_regex")


@query("r1_parse_shorthand", _GOLD)
def r1(spark: SparkSession, d: str) -> DataFrame:
    return restriction.enzyme_table(spark, ["EcoRI", "BsaI", "BaeI"])


@query("r2_enzyme_sites", "SELECT 'E' || p_partkey AS enzyme, i::INT AS cutsite_no, s[i + 1] AS shorthand FROM (SELECT p_partkey, ['G^AATTC', 'GGTCTC(1/5)', '?'] AS s FROM part), unnest(range(0, 3)) AS r(i)")
def r2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("name"), F.lit("G^AATTC, GGTCTC(1/5),?").alias("sites"))
    return restriction.enzyme_sites(p, "name", "sites")


@query("r3_site_regex", "SELECT * FROM (VALUES ('GCCNNNNNGGC', 'GCC[ATGC]{5}GGC'), ('ACRYKMSWBDHVNT', 'AC[AG][CT][GT][AC][GC][AT][GTC][GAT][ACT][GCA][ATGC]{1}T')) AS t(site, regex)")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s, restriction.site_regex(s)) for s in ("GCCNNNNNGGC", "ACRYKMSWBDHVNT")], "site string, regex string")


@query("r4_enzyme_quality", "SELECT 0::BIGINT AS wrong")
def r4(spark: SparkSession, d: str) -> DataFrame:
    gold = spark.createDataFrame([("EcoRI", [1], [5]), ("BsaI", [7], [11]), ("BaeI", [5, 38], [0, 33])], "enzyme string, cut_fwd array<int>, cut_rev array<int>")
    return gold.join(restriction.enzyme_table(spark), ["enzyme", "cut_fwd", "cut_rev"], "left_anti").agg(F.count("*").alias("wrong"))


@query("x10_digest", """, cut AS (SELECT id, seq, string_split(replace(seq, 'GAATTC', 'G|AATTC'), '|') AS p FROM contigs),
fr AS (SELECT id, i::INT AS frag_no, p[i] AS fragment, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::INT AS start_idx FROM cut, unnest(range(1, len(p) + 1)) AS r(i))
SELECT id, frag_no, start_idx, start_idx + length(fragment)::INT AS end_idx, fragment, CASE WHEN frag_no = 1 THEN 0 ELSE -4 END AS overhang FROM fr""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return restriction.digest(base.contigs(spark, d), "id", "seq", restriction.sites_of(["EcoRI"]))


@query("x10_digest_circular")
def x10c(spark: SparkSession, d: str) -> DataFrame:
    return restriction.digest(base.contigs(spark, d), "id", "seq", restriction.sites_of(["BsaI", "BaeI"]), circular=True)


_SIMPLE = """, loc AS (SELECT id, feature_no, f.type AS type, regexp_replace(f.location, '\\s', '', 'g') AS l, f.location AS location FROM feats),
simple AS (SELECT id, feature_no, type, location, NOT starts_with(l, 'complement') AS is_fwd, regexp_extract(l, '(\\d+)', 1)::INT - 1 AS s, regexp_extract(l, '(\\d+)\\)?$', 1)::INT - 1 AS e,
  CASE WHEN contains(l, '<') THEN 4 ELSE 0 END + CASE WHEN contains(l, '>') THEN 2 ELSE 0 END + CASE WHEN contains(l, '^') THEN 1 ELSE 0 END AS flags
  FROM loc WHERE regexp_full_match(l, '(complement\\()?<?\\d+((\\.\\.|\\^)>?\\d+)?\\)?'))
"""


def _simple(spark: SparkSession, d: str) -> DataFrame:
    f = base.features(spark, d).withColumn("l", records.simple_location(F.col("location"))).where("l is not null and l.remote is null")
    return f.select("id", "feature_no", "type", "location", "l.is_fwd", "l.start", "l.end", "l.flags")


@query("f1_simple_location", _SIMPLE + "SELECT id, feature_no, type, location, is_fwd, s AS start, e AS \"end\", flags FROM simple")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return _simple(spark, d)


@query("f1_location_spans", """, loc AS (SELECT id, feature_no, regexp_replace(f.location, '\\s', '', 'g') AS l FROM feats WHERE f.location <> '')
SELECT id, feature_no, len(regexp_extract_all(l, '\\d+')) > 0 AS parsed, length(l) - length(replace(l, ',', '')) + 1 AS parts FROM loc""")
def f1s(spark: SparkSession, d: str) -> DataFrame:
    s = records.location_spans(F.col("location"))
    return base.features(spark, d).where("location <> ''").select("id", "feature_no", s.isNotNull().alias("parsed"), F.size(s).cast("bigint").alias("parts"))


@query("f2_location_text", _SIMPLE + "SELECT id, feature_no, regexp_replace(location, '\\s', '', 'g') AS text FROM simple")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return _simple(spark, d).select("id", "feature_no", records.location_text(F.col("start"), F.col("end"), F.col("flags"), F.lit(None).cast("string"), F.col("is_fwd")).alias("text"))


@query("f3_feature_support", """SELECT id, feature_no, regexp_full_match(regexp_replace(f.location, '\\s', '', 'g'), '(complement\\()?([A-Za-z0-9_.]+:)?<?\\d+((\\.\\.|\\^)>?\\d+)?\\)?') AS supported FROM feats WHERE f.location IS NOT NULL""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return base.features(spark, d).where("location is not null").select("id", "feature_no", records.simple_location(F.col("location")).isNotNull().alias("supported"))


@query("f4_qualifiers", """SELECT id, feature_no, coalesce(f.qualifiers['note'], []) || ['checked'] AS note, f.qualifiers['gene'] IS NOT NULL AS had_gene, FALSE AS has_gene FROM feats WHERE f.qualifiers IS NOT NULL""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    f = base.records(spark, d).select("id", F.posexplode("features").alias("_i", "f")).where("f.qualifiers is not null")
    q = F.col("f.qualifiers")
    note = F.try_element_at(records.add_qualifier(q, "note", F.lit("checked")), F.lit("note"))
    gone = F.map_contains_key(records.remove_qualifier(q, "gene"), F.lit("gene"))
    return f.select("id", (F.col("_i") + 1).alias("feature_no"), note.alias("note"), F.try_element_at(q, F.lit("gene")).isNotNull().alias("had_gene"), gone.alias("has_gene"))


@query("f5_slice", _SIMPLE + """SELECT r.id, substr(r.seq, 101, 900) AS seq, coalesce(n, 0) AS features, first FROM contigs r
LEFT JOIN (SELECT id, count(*) AS n, min(s) - 100 AS first FROM simple WHERE s >= 100 AND e < 1000 GROUP BY id) f ON f.id = r.id""")
def f5(spark: SparkSession, d: str) -> DataFrame:
    seqs, feats = records.slice_records(base.contigs(spark, d), _simple(spark, d), "id", "seq", 100, 1000)
    n = feats.groupBy("id").agg(F.count("*").alias("features"), F.min("start").alias("first"))
    return seqs.join(n, "id", "left").select("id", "seq", F.coalesce("features", F.lit(0)).alias("features"), "first")


@query("f6_concat", _SIMPLE + """, pr AS (SELECT a.id AS a, b.id AS b, length(a.seq) AS n, length(a.seq) + length(b.seq) AS total FROM contigs a JOIN contigs b ON b.id = a.id + 1)
SELECT a AS "left", b AS "right", total, coalesce((SELECT sum(s) FROM simple WHERE id = a), 0)::BIGINT + coalesce((SELECT sum(s + n) FROM simple WHERE id = b), 0)::BIGINT AS starts FROM pr""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    c = base.contigs(spark, d)
    pairs = c.select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    seqs, feats = records.concat_records(pairs, _simple(spark, d), "id", "left", "right", c, "seq")
    s = feats.groupBy("left", "right").agg(F.sum("start").alias("starts"))
    return seqs.join(s, ["left", "right"], "left").select("left", "right", F.length("seq").alias("total"), F.coalesce("starts", F.lit(0)).alias("starts"))


@query("f7_equal_sequences", ", low AS (SELECT lower(seq) AS s, count(*) AS n, min(id) AS first FROM raws WHERE seq IS NOT NULL GROUP BY lower(seq)) SELECT first, n FROM low")
def f7(spark: SparkSession, d: str) -> DataFrame:
    r = base.raws(spark, d).where("seq is not null").select("id", records.sequence_hash(F.col("seq")).alias("h"))
    return r.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("first", "n")


@query("f8_collect_features", _SIMPLE + "SELECT id, count(*) AS n, min(s) AS first_start, arg_min(location, (s, e, type, location)) AS first_location FROM simple GROUP BY id")
def f8(spark: SparkSession, d: str) -> DataFrame:
    c = records.collect_features(_simple(spark, d), "id")
    return c.select("id", F.size("features").cast("bigint").alias("n"), F.col("features")[0]["start"].alias("first_start"), F.col("features")[0]["location"].alias("first_location"))


@query("f9_feature_types", "SELECT type, (dense_rank() OVER (ORDER BY type) - 1)::INT AS type_id FROM (SELECT DISTINCT f.type AS type FROM feats WHERE f.type IS NOT NULL)")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return records.feature_types(base.features(spark, d))


@query("j11_features_in_range", _SIMPLE + "SELECT id, feature_no FROM simple WHERE (s > 500 OR (s = 500 AND e >= 500)) AND (s < 1500 OR (s = 1500 AND e <= 1500))")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return regions.features_in_range(_simple(spark, d), "start", "end", 500, 1500).select("id", "feature_no")


@query("j11_range_join", """SELECT g.id AS gene, x.id AS exon, least(x.s, x.e) AS start, greatest(x.s, x.e) AS "end" FROM genes1 g JOIN exon_rows x ON x.seq_region_name = g.seq_region_name
 AND least(x.s, x.e) <= greatest(g."start", g."end") AND greatest(x.s, x.e) >= least(g."start", g."end") WHERE x.s + x.e + g."start" + g."end" IS NOT NULL""")
def j11r(spark: SparkSession, d: str) -> DataFrame:
    j = regions.range_join(base.genes(spark, d), base.exons(spark, d), "seq_region_name", ("id", "start", "end"), ("start", "end"))
    return j.select(F.col("query_id").alias("gene"), F.col("id").alias("exon"), "start", "end")


@query("j12_contained", """SELECT o.id, instr(c.seq, CASE WHEN o.id % 2 = 0 THEN q ELSE reverse(translate(q, 'ACGT', 'TGCA')) END) > 0 AS found
FROM (SELECT id, substr(seq, 51, 30) AS q FROM contigs) o JOIN contigs c USING (id)""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    c = base.contigs(spark, d)
    q = c.select("id", F.substring("seq", 51, 30).alias("q"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("strand"))
    return regions.contained(q, c.withColumn("ref_strand", F.lit(1)), "id", "q", "strand", "seq", "ref_strand").select("id", "found")


# probes, genes and regions

_PROBE = 'probe_name, "start", "end", probe_length, feature_type, probe_set, seq_region_name, strand, microarray'


@query("a1_unique_probes", f"SELECT DISTINCT {_PROBE} FROM probes")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return genes.unique_probes(base.probes(spark, d))


@query("a2_probes_by_name", """SELECT probe_name, min("start") FILTER (WHERE r = 1) AS "start", count(DISTINCT microarray) AS arrays, coalesce(list_sort(list(DISTINCT microarray) FILTER (WHERE microarray IS NOT NULL)), []) AS microarrays FROM
(SELECT *, row_number() OVER (PARTITION BY probe_name ORDER BY "start" NULLS FIRST, "end" NULLS FIRST) AS r FROM probes) GROUP BY probe_name""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return genes.probes_by_name(base.probes(spark, d)).select("probe_name", "start", F.size("microarrays").cast("bigint").alias("arrays"), "microarrays")


@query("a3_frequent_probes", """, freq AS (SELECT probe_name, count(*) AS array_freq FROM probes GROUP BY probe_name ORDER BY array_freq DESC, probe_name LIMIT 50)
SELECT DISTINCT probe_name, "start", "end", probe_length, seq_region_name, strand, array_freq FROM probes JOIN freq USING (probe_name) WHERE "end" - "start" + 1 = probe_length""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return genes.frequent_probes(base.probes(spark, d), 50)


@query("a4_probe", f"SELECT {_PROBE} FROM probes WHERE probe_name = 'LNBE00000000011' ORDER BY 1, 2 NULLS FIRST, 3 NULLS FIRST, 4 NULLS FIRST, 5, 6, 7, 8, 9 LIMIT 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return genes.probe(base.probes(spark, d), "LNBE00000000011")


@query("a5_grouped_references", "SELECT display_name, list_sort(list({'id': id, 'species': species})) AS refs FROM genes1 GROUP BY display_name")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return genes.grouped_references(base.genes(spark, d), "display_name", ["id", "species"])


@query("a9_protein_coding", """SELECT id, loaded_at, len(list_filter("Transcript", lambda t: t.biotype = 'protein_coding')) AS n FROM genes1""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("Transcript").isNotNull(), F.size(genes.protein_coding(F.col("Transcript"))))
    return base.genes(spark, d).select("id", "loaded_at", n.cast("bigint").alias("n"))


@query("a10_last_exons", 'SELECT display_name, t.id AS transcript_id, t."Exon"[-1].id AS exon_id FROM tx WHERE t.is_canonical = 1')
def a10(spark: SparkSession, d: str) -> DataFrame:
    return genes.last_exons(base.genes(spark, d))


@query("a11_gene_report", """, one AS (SELECT * FROM tx QUALIFY dense_rank() OVER (PARTITION BY gene_id ORDER BY display_name, gene_start) = 1),
counted AS (SELECT gene_id, count(*) AS transcripts, max(gene_strand) AS strand, max(gene_end - gene_start + 1) AS gene_length FROM one GROUP BY gene_id),
canon AS (SELECT gene_id, t.id AS transcript_id, coalesce(len(t."Exon"), 0)::INT AS exons, coalesce(list_sum(list_transform(t."Exon", lambda e: e."end" - e."start" + 1)), 0)::BIGINT AS exon_length FROM one WHERE t.is_canonical = 1),
v AS (SELECT parent, count(*) AS n FROM exon_rows GROUP BY parent)
SELECT gene_id, transcripts, strand, gene_length, transcript_id, exons, exon_length, coalesce(n, 0) AS variants FROM counted LEFT JOIN canon USING (gene_id) LEFT JOIN v ON v.parent = transcript_id""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return genes.gene_report(base.genes(spark, d), base.exons(spark, d), "parent")


@query("a11_exon_offsets", 'SELECT gene_id, t.id AS transcript_id, i::INT AS exon_no, t."Exon"[i].id AS exon_id, t."Exon"[i]."start" - gene_start AS from_gene_start, t."Exon"[i]."end" - t."Exon"[i]."start" + 1 AS length FROM tx, unnest(range(1, len(t."Exon") + 1)) AS r(i)')
def a11o(spark: SparkSession, d: str) -> DataFrame:
    return genes.exon_offsets(base.genes(spark, d))


@query("e1_ordered_bounds", 'SELECT parent, id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN least(s, e) END AS "start", CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN greatest(s, e) END AS "end" FROM exon_rows')
def e1(spark: SparkSession, d: str) -> DataFrame:
    return regions.ordered_bounds(base.exons(spark, d), "start", "end").select("parent", "id", "start", "end")


_PERMITTED = """, var AS (SELECT parent, least(s, e) AS lo, greatest(s, e) AS hi FROM exon_rows WHERE s IS NOT NULL AND e IS NOT NULL),
ev AS (SELECT t.parent, t.s AS rs, t.e AS re, t.strand, v.lo, v.hi FROM transcripts t JOIN var v ON v.parent = t.parent AND v.lo <= t.e AND v.hi >= t.s UNION ALL SELECT parent, s, e, strand, e + 1, e + 1 FROM transcripts),
runs AS (SELECT parent, rs, re, strand, greatest(rs, coalesce(max(hi) OVER (PARTITION BY parent, rs, re ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, rs)) AS lo, lo AS hi FROM ev)
"""


@query("e2_variant_gaps", _PERMITTED + "SELECT DISTINCT parent, lo, hi FROM runs WHERE lo < hi")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return regions.variant_gaps(base.transcripts(spark, d), base.exons(spark, d), "parent", "start", "end")


@query("e3_variant_positions", ", var AS (SELECT parent, least(s, e) AS lo, greatest(s, e) AS hi FROM exon_rows WHERE s IS NOT NULL AND e IS NOT NULL), pos AS (SELECT DISTINCT parent, unnest(range(lo, hi + 1)) AS p FROM var) SELECT parent, count(*) AS n FROM pos GROUP BY parent")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return regions.variant_positions(base.exons(spark, d), "parent", "start", "end").groupBy("parent").agg(F.count("*").alias("n"))


@query("e4_permitted_regions", _PERMITTED + "SELECT parent, sum(hi - lo)::BIGINT AS bases FROM (SELECT DISTINCT parent, lo, hi FROM runs WHERE lo < hi) GROUP BY parent")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return regions.permitted_regions(base.transcripts(spark, d), base.exons(spark, d), "parent", "start", "end").groupBy("parent").agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))


def _with_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts with a made sequence of the right length, the same in both engines."""
    return base.transcripts(spark, d).withColumn("seq", F.substr(F.repeat(F.lit("ACCGTTTGAC"), F.floor((F.col("end") - F.col("start") + 10) / 10).cast("int")), F.lit(1), (F.col("end") - F.col("start") + 1).cast("int")))


_SEQ = "substr(repeat('ACCGTTTGAC', ((re - rs + 10) // 10)::INT), (CASE WHEN strand < 0 THEN (re - rs + 1) - (hi - rs) ELSE lo - rs END)::INT + 1, (hi - lo)::INT)"


@query("e5_sliced_sequence", """SELECT parent, s + 10 AS lo, s + 25 AS hi, substr(repeat('ACCGTTTGAC', ((e - s + 10) // 10)::INT), (CASE WHEN strand < 0 THEN (e - s + 1) - 25 ELSE 10 END)::INT + 1, 15) AS seq FROM transcripts WHERE e - s > 30""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    t = _with_sequence(spark, d).where(F.col("end") - F.col("start") > 30).withColumns({"lo": F.col("start") + 10, "hi": F.col("start") + 25})
    return t.select("parent", "lo", "hi", regions.sliced_sequence(F.col("seq"), F.col("start"), F.col("lo"), F.col("hi"), F.col("strand") < 0).alias("seq"))


@query("e6_permitted_sequences", _PERMITTED + f"SELECT DISTINCT parent, lo, hi, {_SEQ} AS seq FROM runs WHERE lo < hi")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return regions.permitted_sequences(_with_sequence(spark, d), base.exons(spark, d), "parent", "start", "end", "seq", "strand")


@query("o5_variant_periods", """, v AS (SELECT parent, least(s, e) AS lo, greatest(s, e) AS hi FROM exon_rows WHERE s IS NOT NULL AND e IS NOT NULL),
m AS (SELECT DISTINCT parent, lo, hi FROM v), f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY parent ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM m),
g AS (SELECT *, sum(n) OVER (PARTITION BY parent ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT parent, min(lo) AS start_pos, max(hi) AS end_pos FROM g GROUP BY parent, i""")
def o5(spark: SparkSession, d: str) -> DataFrame:
    return islands.periods_and_gaps(base.exons(spark, d), ["parent"], "start", "end").where("kind = 'period'").select("parent", "start_pos", "end_pos")


@query("e9_scaffold", "SELECT id, 'TCTAC' || barcode || 'AAGTT' AS scaffold FROM oligos")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "barcode").select("id", padlock.scaffold("TCTAC{barcode}AAGTT{armr}", F.col("barcode")).alias("scaffold"))


_E10 = f""", pairs AS (SELECT id, 0 AS k, seq_l AS a, seq_r AS b FROM oligos UNION ALL SELECT id, 1, seq_l, 'TCTACAAGTT' FROM oligos UNION ALL SELECT id, 2, 'TCTACAAGTT', seq_r FROM oligos),
tails AS (SELECT DISTINCT id, k, right(a, n::INT) AS t FROM pairs, unnest(range(4, 9)) AS r(n) WHERE length(a) >= n AND contains({rc_sql("b")}, right(a, n::INT))),
one AS (SELECT t, {tm_sql("t")} AS tm FROM (SELECT DISTINCT t FROM tails WHERE regexp_full_match(t, '[ACGT]+'))),
dim AS (SELECT p.id, p.k, greatest(0, coalesce(max(tm), 0)) AS tm FROM pairs p LEFT JOIN tails t ON t.id = p.id AND t.k = p.k LEFT JOIN one USING (t) GROUP BY p.id, p.k),
three AS (SELECT id, max(tm) FILTER (WHERE k = 0) AS d0, max(tm) FILTER (WHERE k = 1) AS d1, max(tm) FILTER (WHERE k = 2) AS d2 FROM dim GROUP BY id),
g AS (SELECT id, seq_l, seq_r, length(regexp_replace(seq_l, '[^GC]', '', 'g')) / length(seq_l) AS gl, length(regexp_replace(seq_r, '[^GC]', '', 'g')) / length(seq_r) AS gr, {tm_sql("seq_l")} AS tl, {tm_sql("seq_r")} AS tr,
  length(regexp_replace(left(seq_l, 5), '[^GC]', '', 'g')) <= 3 AND length(regexp_replace(right(seq_r, 5), '[^GC]', '', 'g')) <= 3 AS clamp FROM oligos)
SELECT id, gl BETWEEN 0.4 AND 0.6 AND gr BETWEEN 0.4 AND 0.6 AND clamp AND tl >= 50 AND tr >= 50 AND NOT contains(seq_l, 'GGGGG') AND NOT contains(seq_r, 'GGGGG') AND greatest(d0, d1, d2) <= 30 AS ok,
  round(gl, 6) AS gc_l, round(gr, 6) AS gc_r, clamp AS l_clamp, round(tl, 4) AS tm_l, round(tr, 4) AS tm_r, round(d0, 4) AS tm_hetero_0, round(d1, 4) AS tm_hetero_1, round(d2, 4) AS tm_hetero_2 FROM g JOIN three USING (id)"""


@query("e10_screen_arms", _E10)
def e10(spark: SparkSession, d: str) -> DataFrame:
    s = padlock.screen_arms(F.col("seq_l"), F.col("seq_r"), F.lit("TCTACAAGTT"))
    x = base.oligos(spark, d, "seq_l", "seq_r").select("id", s.alias("s"))
    return x.select("id", "s.ok", F.round("s.gc_l", 6).alias("gc_l"), F.round("s.gc_r", 6).alias("gc_r"), "s.l_clamp", *[F.round(f"s.{c}", 4).alias(c) for c in ("tm_l", "tm_r", "tm_hetero_0", "tm_hetero_1", "tm_hetero_2")])


@query("e11_generate_padlocks")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return padlock.generate_padlocks(base.contigs(spark, d), "id", "seq", "TCTACGATTACGCAGGTACC").select("id", "idx", "group_start", "padlock_seq", "score")


@query("e12_design_of_sequences")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return padlock.design(base.contigs(spark, d), "id", "seq", "TCTACGATTACGCAGGTACC").select("id", "idx", "padlock_seq", "score", "relaxed")


# graphs, barcodes and seeds


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "barcodes").select("barcode").where("barcode is not null").distinct()


@query("g1_hamming_graph", "SELECT a.barcode AS i, b.barcode AS j, hamming(a.barcode, b.barcode)::INT AS distance FROM bars a JOIN bars b ON a.barcode < b.barcode")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return similarity.full_graph(_bars(spark, d), "barcode", "barcode")


@query("g1_distance_graph", ", s AS (SELECT seq_l AS x FROM oligos WHERE length(seq_l) = 20 UNION SELECT left(seq_l, (id % 20)::INT) || 'C' || substr(seq_l, (id % 20)::INT + 2) FROM oligos WHERE length(seq_l) = 20), c AS (SELECT a.x AS i, b.x AS j FROM s a JOIN s b ON left(a.x, 10) = left(b.x, 10) AND a.x < b.x UNION SELECT a.x, b.x FROM s a JOIN s b ON right(a.x, 10) = right(b.x, 10) AND a.x < b.x) SELECT i, j, hamming(i, j)::INT AS distance FROM c WHERE hamming(i, j) <= 1")
def g1d(spark: SparkSession, d: str) -> DataFrame:
    """All arms, and each once more with a C at one place."""
    arms = base.oligos(spark, d, "seq_l").where("length(seq_l) = 20")
    other = arms.select(F.expr("concat(left(seq_l, cast(id % 20 as int)), 'C', substr(seq_l, cast(id % 20 as int) + 2))").alias("seq_l"))
    return similarity.distance_graph(arms.select("seq_l").unionByName(other).distinct(), "seq_l", "seq_l", 1, 20)


@query("g2_placed_graph", """, p AS (SELECT barcode, left(barcode, 3 + ascii(barcode) % 3) AS s FROM bars),
 o AS (SELECT a.barcode AS i, b.barcode AS j, CASE WHEN length(a.s) <= length(b.s) THEN a.s ELSE b.s END AS x, CASE WHEN length(a.s) <= length(b.s) THEN b.s ELSE a.s END AS y FROM p a JOIN p b ON a.barcode < b.barcode)
SELECT i, j, list_min(list_transform(range(0, length(y) - length(x) + 1), lambda k: hamming(x, substr(y, k + 1, length(x)))))::INT AS distance FROM o""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    own = _bars(spark, d).withColumn("s", F.expr("left(barcode, 3 + ascii(barcode) % 3)"))
    return similarity.full_graph(own, "barcode", "s", "placed")


@query("g3_both_ways_graph", "SELECT a.barcode AS i, b.barcode AS j, (hamming(a.barcode, b.barcode) > 2 AND hamming(a.barcode, reverse(b.barcode)) > 2)::INT AS linked FROM bars a JOIN bars b ON a.barcode < b.barcode")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return similarity.full_graph(_bars(spark, d), "barcode", "barcode", "both_ways")


@query("g4_3p_graph", "SELECT a.barcode AS i, b.barcode AS j, (hamming(a.barcode, b.barcode) > 2 AND hamming(a.barcode, reverse(b.barcode)) > 2 AND right(a.barcode, 3) <> right(b.barcode, 3) AND right(a.barcode, 3) <> reverse(left(b.barcode, 3)) AND reverse(left(a.barcode, 3)) <> right(b.barcode, 3))::INT AS linked FROM bars a JOIN bars b ON a.barcode < b.barcode")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return similarity.full_graph(_bars(spark, d), "barcode", "barcode", "both_ways_3p")


def _edges(spark: SparkSession, d: str, least: int) -> DataFrame:
    return similarity.full_graph(_bars(spark, d), "barcode", "barcode").where(F.col("distance") >= least)


@query("g5_maximal_cliques", """, e AS (SELECT a.barcode AS i, b.barcode AS j FROM bars a JOIN bars b ON hamming(a.barcode, b.barcode) >= 4),
near AS (SELECT i, list(j) AS js FROM e GROUP BY i),
grown AS (SELECT [i] AS members, js AS may FROM near UNION ALL SELECT list_append(members, n.i), list_intersect(may, n.js) FROM grown JOIN near n ON n.i > members[-1] AND list_contains(may, n.i))
SELECT (row_number() OVER (ORDER BY len(members) DESC, members))::INT AS clique_no, len(members)::INT AS size, members FROM grown WHERE len(may) = 0 AND len(members) >= 2""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_cliques(_edges(spark, d, 4), "i", "j")


@query("g6_triangles", ", e AS (SELECT a.barcode AS i, b.barcode AS j FROM bars a JOIN bars b ON a.barcode < b.barcode WHERE hamming(a.barcode, b.barcode) >= 4) SELECT x.i AS a, x.j AS b, y.j AS c FROM e x JOIN e y ON y.i = x.j JOIN e z ON z.i = x.i AND z.j = y.j")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(_edges(spark, d, 4), "i", "j")


@query("g6_find_cliques")
def g6c(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_cliques(_edges(spark, d, 3), "i", "j", 4, 100)


@query("g8_barcode_pool", """, n4(b) AS (VALUES ('A'), ('C'), ('G'), ('T')), w AS (SELECT a.b || b.b || c.b || d.b || e.b AS barcode FROM n4 a, n4 b, n4 c, n4 d, n4 e)
SELECT barcode FROM w WHERE NOT regexp_matches(barcode, 'AAAA|CCCC|GGGG|TTTT') AND length(regexp_replace(barcode, '[^GC]', '', 'g')) < 4""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return graph.barcode_pool(spark, 5)


@query("g9_barcode_set", "SELECT 4::BIGINT AS size, TRUE AS ok")
def g9(spark: SparkSession, d: str) -> DataFrame:
    s = graph.barcode_set(_bars(spark, d), "barcode", 3, 4)
    worst = similarity.full_graph(s, "barcode", "barcode").agg((F.min("distance") >= 3).alias("ok"))
    return s.agg(F.count("*").alias("size")).withColumn("one", F.lit(1)).join(worst.withColumn("one", F.lit(1)), "one").drop("one")


@query("g10_pool_without_drawn", "SELECT count(*) - 1 AS n FROM bars")
def g10(spark: SparkSession, d: str) -> DataFrame:
    pool = _bars(spark, d)
    return graph.without(pool, "barcode", graph.drawn(pool, "barcode", 5)).agg(F.count("*").alias("n"))


@query("d1_masks", "SELECT lpad(bin(i), 10, '0') AS mask FROM unnest(range(0, 1024)) AS r(i) WHERE bit_count(i) = 8")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return seeds.masks(spark, 10, 2).select("mask")


@query("d2_seeds", "SELECT translate(lpad(bin(i), 9, '0'), '10', '#-') AS seed FROM unnest(range(0, 512)) AS r(i) WHERE bit_count(i) = 5")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return seeds.seeds(spark, 9, 5)


_SHIFTS = """, m AS (SELECT i, lpad(bin(i), 12, '0') AS mask FROM unnest(range(0, 4096)) AS r(i) WHERE bit_count(i) = 10),
h AS (SELECT mask, s, (substr(mask, s + 1, 1) = '0' OR substr(mask, s + 2, 1) = '0' OR substr(mask, s + 4, 1) = '0' OR substr(mask, s + 6, 1) = '0')::INT AS hit FROM m, unnest(range(0, 7)) AS q(s))
"""


@query("d3_shift_hits", _SHIFTS + "SELECT mask, list(hit ORDER BY s) AS hits FROM h GROUP BY mask")
def d3(spark: SparkSession, d: str) -> DataFrame:
    b = seeds.seed_bits("##-#-#", 12)
    hits = F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(x)) != x, 1).otherwise(0) for x in b])
    return seeds.masks(spark, 12, 2).select("mask", hits.alias("hits"))


@query("d4_check_seed", "SELECT * FROM (VALUES ('#-##--#-##', 15, 2), ('#-##-##-##', 15, 1)) AS t(seed, m, best)")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s, 15, seeds.check_seed(s, 15)) for s in ("#-##--#-##", "#-##-##-##")], "seed string, m int, best int")


@query("d5_failing_masks", _SHIFTS + "SELECT mask FROM h GROUP BY mask HAVING min(hit) = 1")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return seeds.failing_masks(spark, ["##-#-#"], 12, 2)


@query("d6_check_seeds", """SELECT m, k, TRUE AS lossless FROM (VALUES (6, 1), (7, 1), (7, 2), (8, 1), (9, 1), (9, 2), (10, 1), (10, 2), (11, 1), (11, 2), (12, 1), (12, 2), (13, 1), (13, 2), (14, 1), (14, 2), (15, 1), (15, 2), (16, 1), (16, 2), (17, 1), (17, 2), (18, 1), (18, 2), (19, 1), (19, 2)) AS t(m, k)""")
def d6(spark: SparkSession, d: str) -> DataFrame:
    from nucleoframe.plans.strategy import SEEDS

    return spark.createDataFrame([(m, k, seeds.check_seeds(f, m, k, k) == k) for (m, k), f in SEEDS.items()], "m int, k int, lossless boolean")


@query("d7_find_seeds")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w, s) for w, s in seeds.find_seeds(10, 1).items()], "weight int, seed string")


@query("d8_find_seed_pairs")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(list(p),) for p in seeds.find_seed_pairs(9, 2, 4)], "family array<string>")


# duplexes


def _duplexes(spark: SparkSession, d: str) -> DataFrame:
    o = base.oligos(spark, d, "seq_l", "barcode")
    return o.select("id", duplex.duplex(F.concat("barcode", "seq_l"), reverse_complement(F.concat("seq_l", "barcode")), -5).alias("d"))


@query("x1_duplex", "SELECT id, barcode || seq_l AS fwd, reverse(translate(seq_l || barcode, 'ACGT', 'TGCA')) AS rev, length(seq_l) + 10 AS total FROM oligos")
def x1(spark: SparkSession, d: str) -> DataFrame:
    x = _duplexes(spark, d)
    return x.select("id", "d.fwd", "d.rev", duplex.total_length(F.col("d")).cast("bigint").alias("total"))


@query("x2_aligned_overhang")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return base.oligos(spark, d, "seq_l").select("id", duplex.aligned_overhang(F.col("seq_l"), reverse_complement(F.substring("seq_l", 3, 12))).alias("overhang"))


@query("x2_gapped_overhang", "SELECT id, (length(seq_l) - 2)::INT * 2 AS score, -2 AS overhang FROM oligos WHERE length(seq_l) > 12")
def x2g(spark: SparkSession, d: str) -> DataFrame:
    """The strand from its third letter on: all of it agrees, two letters further on."""
    return base.oligos(spark, d, "seq_l").where("length(seq_l) > 12").select("id", duplex.gapped_overhang(F.col("seq_l"), reverse_complement(F.substring("seq_l", 3, 1 << 10))).alias("x")).select("id", "x.score", "x.overhang")


@query("x3_ends", "SELECT id, 'FIVE' AS lt, barcode AS ls, 'FIVE' AS rt, reverse(translate(barcode, 'ACGT', 'TGCA')) AS rs FROM oligos")
def x3(spark: SparkSession, d: str) -> DataFrame:
    x = _duplexes(spark, d)
    l, r = duplex.left_end(F.col("d")), duplex.right_end(F.col("d"))
    return x.select("id", l["type"].alias("lt"), l["seq"].alias("ls"), r["type"].alias("rt"), r["seq"].alias("rs"))


@query("x5_ligate", "SELECT id, barcode || seq_l || barcode || seq_l AS fwd, reverse(translate(seq_l || barcode || seq_l || barcode, 'ACGT', 'TGCA')) AS rev FROM oligos")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return _duplexes(spark, d).select("id", duplex.ligate(F.col("d"), F.col("d")).alias("x")).select("id", "x.fwd", "x.rev")


@query("x6_slice", "SELECT id, substr(barcode || seq_l, 4, 7) AS fwd, reverse(translate(substr(seq_l || barcode, 1, 5), 'ACGT', 'TGCA')) AS rev, -2 AS overhang FROM oligos")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return _duplexes(spark, d).select("id", duplex.sliced(F.col("d"), 3, 10).alias("x")).select("id", "x.fwd", "x.rev", "x.overhang")


@query("x7_repeat", "SELECT id, repeat(barcode || seq_l, 3) AS fwd FROM oligos")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return _duplexes(spark, d).select("id", duplex.repeated(F.col("d"), 3)["fwd"].alias("fwd"))


@query("x8_circularize", "SELECT id, TRUE AS can, barcode || seq_l AS fwd, reverse(translate(barcode || seq_l, 'ACGT', 'TGCA')) AS rev FROM oligos")
def x8(spark: SparkSession, d: str) -> DataFrame:
    x = _duplexes(spark, d)
    c = duplex.circularize(F.col("d"))
    return x.select("id", duplex.can_circularize(F.col("d")).alias("can"), c["fwd"].alias("fwd"), duplex.linearize(c)["rev"].alias("rev"))


@query("x9_indexes", "SELECT id, length(seq_l)::INT + 5 - 1 - 2 AS rev_of_7, 9 AS fwd_again FROM oligos")
def x9(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("d")
    j = duplex.reverse_index(x, F.lit(7))
    return _duplexes(spark, d).select("id", j.alias("rev_of_7"), (duplex.forward_index(x, j) + 2).alias("fwd_again"))


# files

_FASTA = "SELECT id::VARCHAR AS id, id || ' record ' || id AS description, seq FROM contigs WHERE seq <> ''"


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    c = base.contigs(spark, d).where("seq <> ''")
    return c.select(fasta.fasta_text(F.concat(F.col("id").cast("string"), F.lit(" record "), F.col("id").cast("string")), F.col("seq")).alias("text"))


@query("io1_parse_fasta", _FASTA)
def io1(spark: SparkSession, d: str) -> DataFrame:
    return fasta.parse_entries(_fasta(spark, d).select(F.explode(fasta.entries_of(F.col("text"))).alias("e")), "e")


@query("io2_fasta_first_word", "SELECT id::VARCHAR AS id, length(seq) AS n FROM contigs WHERE seq <> ''")
def io2(spark: SparkSession, d: str) -> DataFrame:
    return fasta.parse_entries(_fasta(spark, d).select(F.substring("text", 2, 1 << 30).alias("e")), "e").select("id", F.length("seq").cast("bigint").alias("n"))


@query("io3_sanitize", "SELECT id::VARCHAR AS id, regexp_matches(seq, '[^ACGT]') AS bad FROM contigs WHERE seq <> ''")
def io3(spark: SparkSession, d: str) -> DataFrame:
    return fasta.parse_entries(_fasta(spark, d).select(F.substring("text", 2, 1 << 30).alias("e")), "e", alphabet="DNA", not_allowed="WSMKRYBDHVN").select("id", "bad")


@query("io4_write_fasta", r"SELECT '>' || id || ' record ' || id || chr(10) || regexp_replace(regexp_replace(seq, '(.{60})', '\1' || chr(10), 'g'), '\n$', '') AS text FROM contigs WHERE seq <> ''")
def io4(spark: SparkSession, d: str) -> DataFrame:
    return _fasta(spark, d)


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return genbank.genbank_text(base.records(spark, d), "id")


@query("io5_parse_genbank", "SELECT id, info.accession AS accession, len(features) AS features, coalesce(regexp_replace(seq, '[\\s\\d]', '', 'g'), '') AS seq FROM recs")
def io5(spark: SparkSession, d: str) -> DataFrame:
    g = genbank.parse_genbank(_flat(spark, d), "id", "text")
    n = F.when(F.size("features") > 0, F.size("features").cast("bigint"))
    own = base.records(spark, d).select("id", F.when(F.col("features").isNotNull(), F.lit(0).cast("bigint")).alias("none"))
    return g.join(own, "id").select("id", "info.accession", F.coalesce(n, "none").alias("features"), F.coalesce("seq", F.lit("")).alias("seq"))


@query("io6_genbank_header", "SELECT id, info.name AS name, info.length AS length, info.molecule_type AS molecule_type, info.form AS form, info.gb_division AS division, info.mod_date AS mod_date, info.definition AS definition, info.version AS version, info.\"GI\" AS gi, info.source AS source, info.organism AS organism FROM recs")
def io6(spark: SparkSession, d: str) -> DataFrame:
    g = genbank.parse_genbank(_flat(spark, d), "id", "text")
    return g.select("id", *[F.col(f"info.{c}").alias(a) for c, a in (("name", "name"), ("length", "length"), ("molecule_type", "molecule_type"), ("form", "form"), ("gb_division", "division"), ("mod_date", "mod_date"), ("definition", "definition"), ("version", "version"), ("GI", "gi"), ("source", "source"), ("organism", "organism"))])


@query("io7_references", "SELECT id, r.r_index AS r_index, r.authors AS authors, r.title AS title, r.journal_info AS journal_info FROM (SELECT id, unnest(info.\"references\") AS r FROM recs)")
def io7(spark: SparkSession, d: str) -> DataFrame:
    g = genbank.parse_genbank(_flat(spark, d), "id", "text").select("id", F.explode("info.references").alias("r"))
    return g.select("id", "r.r_index", "r.authors", "r.title", "r.journal_info")


@query("io8_comment", "SELECT id, info.comment.text AS text, info.comment.assembly AS assembly FROM recs WHERE info.comment IS NOT NULL AND info.comment.text <> ''")
def io8(spark: SparkSession, d: str) -> DataFrame:
    return genbank.parse_genbank(_flat(spark, d), "id", "text").select("id", "info.comment.text", "info.comment.assembly").where("text <> ''")


@query("io9_parse_features", "SELECT id, feature_no::INT AS feature_no, coalesce(f.type, '-') AS type, coalesce(regexp_replace(f.location, '\\s', '', 'g'), '') AS location FROM feats")
def io9(spark: SparkSession, d: str) -> DataFrame:
    g = genbank.parse_genbank(_flat(spark, d), "id", "text").select("id", F.posexplode("features").alias("i", "f"))
    return g.select("id", (F.col("i") + 1).alias("feature_no"), "f.type", "f.location")


@query("io12_write_genbank", "SELECT id, TRUE AS same FROM recs")
def io12(spark: SparkSession, d: str) -> DataFrame:
    """Text that is read and written again stays the same, byte for byte."""
    first = _flat(spark, d)
    again = genbank.genbank_text(genbank.parse_genbank(first, "id", "text"), "id").withColumnRenamed("text", "again")
    return first.join(again, "id").select("id", (F.col("text") == F.col("again")).alias("same"))


@query("io14_parse_xmfa", "SELECT id, 1 AS group_no, 'n' || id AS group_notes, k::INT AS seq_num, 1 AS start_idx, length(s)::INT AS end_idx, CASE WHEN k = 1 THEN '+' ELSE '-' END AS strand, 'a.fa' AS notes, s AS seq FROM (SELECT id, k, CASE WHEN k = 1 THEN seq_l ELSE seq_r END AS s FROM oligos, unnest([1, 2]) AS r(k))")
def io14(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k, c, s: F.concat(F.lit(f"> {k}:1-"), F.length(c).cast("string"), F.lit(f" {s} a.fa\n"), F.substring(c, 1, 10), F.lit("\n"), F.substring(c, 11, 100), F.lit("\n"))
    text = F.concat(part(1, "seq_l", "+"), part(2, "seq_r", "-"), F.lit("=n"), F.col("id").cast("string"), F.lit("\n"))
    return xmfa.parse_xmfa(base.oligos(spark, d, "seq_l", "seq_r").select("id", text.alias("text")), "id", "text")


@query("io15_genbank_to_fasta", "SELECT '>' || info.accession || chr(10) || regexp_replace(regexp_replace(regexp_replace(seq, '[\\s\\d]', '', 'g'), '(.{60})', '\\1' || chr(10), 'g'), '\\n$', '') AS text FROM recs WHERE seq <> '' AND info.accession IS NOT NULL")
def io15(spark: SparkSession, d: str) -> DataFrame:
    g = genbank.parse_genbank(_flat(spark, d), "id", "text").where("seq <> '' and info.accession is not null")
    return g.select(fasta.fasta_text(F.col("info.accession"), F.col("seq")).alias("text"))


@query("io18_json_round_trip", "SELECT id, info.accession AS accession, len(features) AS n FROM recs")
def io18(spark: SparkSession, d: str) -> DataFrame:
    r = base.records(spark, d)
    back = r.select("id", F.from_json(F.to_json(F.struct("info", "features")), r.select("info", "features").schema.simpleString().replace("struct<info:", "info ", 1)[:-1].replace(",features:", ", features ", 1)).alias("j"))
    return back.select("id", "j.info.accession", F.when(F.col("j.features").isNotNull(), F.size("j.features").cast("bigint")).alias("n"))


@query("io20_codon_table", "SELECT count(*) AS n, count(DISTINCT codon) AS codons FROM (SELECT unnest(range(64)) AS codon)")
def io20(spark: SparkSession, d: str) -> DataFrame:
    from nucleoframe.functions.codon import codon_table

    return codon_table(spark).agg(F.count("*").alias("n"), F.countDistinct("codon").alias("codons"))


@query("io27_barcode_sets", "SELECT DISTINCT barcode_set, barcode FROM barcodes WHERE barcode IS NOT NULL")
def io27(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "barcodes").groupBy("barcode_set").agg(F.to_json(F.sort_array(F.collect_set("barcode"))).alias("json"))
    return sets.select("barcode_set", F.explode(F.from_json("json", "array<string>")).alias("barcode"))


@query("st1_stream_columns", "SELECT hit_id, reverse(translate(seq_l, 'ACGT', 'TGCA')) AS rc FROM padlock_hits")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """A stream of probes with a column function, run over all that is there, into files."""
    from nucleoframe.functions.seq import simple_reverse_complement
    from nucleoframe.streaming import stateless

    stream = stateless.parquet_stream(spark, f"{d}/padlock_hits.parquet")
    out = stateless.with_columns(stream, {"rc": lambda: simple_reverse_complement(F.col("seq_l"))}).select("hit_id", "rc")
    return stateless.to_files(out)
