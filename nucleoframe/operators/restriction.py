"""Restriction enzymes: site shorthand, search, counting and digestion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.functions.seq import IUPAC, IUPAC_COMPLEMENT
from nucleoframe.operators.kmers import per_record

_RC = str.maketrans(IUPAC, IUPAC_COMPLEMENT)
# Bases an IUPAC letter stands for.
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "K": "[GT]", "M": "[AC]", "S": "[GC]", "W": "[AT]", "B": "[GTC]", "D": "[GAT]", "H": "[ACT]", "V": "[GCA]"}
# Public recognition sites of common enzymes in the usual shorthand; others come from a file (sources.tables).
ENZYMES = {
    "AatII": "GACGT^C", "AccI": "GT^MKAC", "AciI": "CCGC(-3/-1)", "AclI": "AA^CGTT", "AcuI": "CTGAAG(16/14)", "AfeI": "AGC^GCT",
    "AflII": "C^TTAAG", "AgeI": "A^CCGGT", "AluI": "AG^CT", "AlwI": "GGATC(4/5)", "ApaI": "GGGCC^C", "ApaLI": "G^TGCAC",
    "AscI": "GG^CGCGCC", "AseI": "AT^TAAT", "AvaI": "C^YCGRG", "AvaII": "G^GWCC", "AvrII": "C^CTAGG",
    "BaeI": "(10/15)ACNNNNGTAYC(12/7)", "BamHI": "G^GATCC", "BanI": "G^GYRCC", "BanII": "GRGCY^C", "BbsI": "GAAGAC(2/6)", "BbvI": "GCAGC(8/12)",
    "BclI": "T^GATCA", "BfaI": "C^TAG", "BglI": "GCCNNNN^NGGC", "BglII": "A^GATCT", "BlpI": "GC^TNAGC", "BsaI": "GGTCTC(1/5)",
    "BsmBI": "CGTCTC(1/5)", "BsmFI": "GGGAC(10/14)", "BspEI": "T^CCGGA", "BspHI": "T^CATGA", "BsrGI": "T^GTACA", "BssHII": "G^CGCGC",
    "BssSI": "CACGAG(-5/-1)", "BstBI": "TT^CGAA", "BstEII": "G^GTNACC", "BstXI": "CCANNNNN^NTGG", "ClaI": "AT^CGAT", "CviQI": "G^TAC",
    "DdeI": "C^TNAG", "DpnI": "GA^TC", "DpnII": "^GATC", "DraI": "TTT^AAA", "DraIII": "CACNNN^GTG", "EagI": "C^GGCCG", "EarI": "CTCTTC(1/4)",
    "EcoRI": "G^AATTC", "EcoRV": "GAT^ATC", "FokI": "GGATG(9/13)", "FseI": "GGCCGG^CC", "FspI": "TGC^GCA", "HaeII": "RGCGC^Y",
    "HaeIII": "GG^CC", "HhaI": "GCG^C", "HincII": "GTY^RAC", "HindIII": "A^AGCTT", "HinfI": "G^ANTC", "HpaI": "GTT^AAC", "HpaII": "C^CGG",
    "KasI": "G^GCGCC", "KpnI": "GGTAC^C", "MboI": "^GATC", "MfeI": "C^AATTG", "MluI": "A^CGCGT", "MlyI": "GAGTC(5/5)", "MseI": "T^TAA",
    "MspI": "C^CGG", "NaeI": "GCC^GGC", "NarI": "GG^CGCC", "NcoI": "C^CATGG", "NdeI": "CA^TATG", "NheI": "G^CTAGC", "NlaIII": "CATG^",
    "NotI": "GC^GGCCGC", "NruI": "TCG^CGA", "NsiI": "ATGCA^T", "PacI": "TTAAT^TAA", "PciI": "A^CATGT", "PmeI": "GTTT^AAAC", "PstI": "CTGCA^G",
    "PvuI": "CGAT^CG", "PvuII": "CAG^CTG", "RsaI": "GT^AC", "SacI": "GAGCT^C", "SacII": "CCGC^GG", "SalI": "G^TCGAC", "SapI": "GCTCTTC(1/4)",
    "SbfI": "CCTGCA^GG", "ScaI": "AGT^ACT", "SfiI": "GGCCNNNN^NGGCC", "SmaI": "CCC^GGG", "SnaBI": "TAC^GTA", "SpeI": "A^CTAGT",
    "SphI": "GCATG^C", "SspI": "AAT^ATT", "StuI": "AGG^CCT", "StyI": "C^CWWGG", "SwaI": "ATTT^AAAT", "TaqI": "T^CGA", "XbaI": "T^CTAGA",
    "XhoI": "C^TCGAG", "XmaI": "C^CCGGG", "XmnI": "GAANN^NNTTC",
}
_SHORT = re.compile(r"(?:\((-?\d+)/(-?\d+)\))?([A-Z^]+)(?:\((-?\d+)/(-?\d+)\))?")
SITE_FIELDS = (
    "enzyme string, cutsite_no int, shorthand string, core_seq array<string>, full_seq array<string>, "
    "core_regex array<string>, full_regex array<string>, cut_fwd array<int>, cut_rev array<int>"
)


@dataclass(frozen=True)
class Site:
    enzyme: str
    cutsite_no: int
    shorthand: str
    core: str | None
    full: str | None
    cut_fwd: tuple[int, ...]
    cut_rev: tuple[int, ...]
    compat: bool = False

    def patterns(self, full: bool = True) -> tuple[str, str] | None:
        s = self.full if full else self.core
        return None if s is None else (site_regex(s, self.compat), site_regex(flipped(s), self.compat))

    def width(self, full: bool = True) -> int:
        return len((self.full if full else self.core) or "")


def flipped(seq: str) -> str:
    return seq.translate(_RC)[::-1]


def site_regex(seq: str, compat: bool = False) -> str:
    """The pattern of a site; a run of N becomes one counted class.  ``compat`` reads Y as C or G."""
    out = re.sub("N+", lambda m: f"n{len(m[0])}n", seq)
    out = "".join(BASES.get(c, c) if c != "Y" or not compat else "[CG]" for c in out)
    return re.sub(r"n(\d+)n", r"[ATGC]{\1}", out)


def parse_site(shorthand: str, enzyme: str = "", cutsite_no: int = 0, compat: bool = False) -> Site:
    """A site from its shorthand: ``^`` marks a cut, ``(fwd/rev)`` cuts before or behind the site, ``?`` an unknown one."""
    text = shorthand.strip()
    if text == "?":
        return Site(enzyme, cutsite_no, text, None, None, (), (), compat)
    m = _SHORT.fullmatch(text)
    core = m[3].replace("^", "") if m else ""
    if not m or not core or set(core) - set(BASES) - {"N"} or m[3].count("^") > 1 or ("^" in m[3] and (m[1] or m[4])):
        raise ValueError(f"not a site shorthand: {shorthand}")
    if "^" in m[3]:
        at = m[3].index("^")
        return Site(enzyme, cutsite_no, text, core, core, (at,), (len(core) - at,), compat)
    before = (int(m[1]), int(m[2])) if m[1] else None
    behind = (int(m[4]), int(m[5])) if m[4] else None
    front, back = max(0, *(before or (0,))), max(0, *(behind or (0,)))
    cuts = [[], []]
    for strand in (0, 1):
        if before:
            cuts[strand].append(front - before[strand])
        if behind:
            cuts[strand].append(front + len(core) + behind[strand])
    return Site(enzyme, cutsite_no, text, core, "N" * front + core + "N" * back, tuple(cuts[0]), tuple(cuts[1]), compat)


def sites_of(names: list[str] | None = None, known: dict[str, str] | None = None, compat: bool = False) -> list[Site]:
    """Sites of the named enzymes; several sites of one are separated by commas.  An unknown name is an error."""
    known = known or ENZYMES
    missing = [n for n in names or [] if n not in known]
    if missing:
        raise ValueError(f"unknown enzymes: {', '.join(missing)}")
    return [parse_site(s, n, i, compat) for n in names or sorted(known) for i, s in enumerate(known[n].split(","))]


def enzyme_table(spark: SparkSession, names: list[str] | None = None, known: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """The dimension table of sites, one row per enzyme and site."""
    return spark.createDataFrame([site_row(s) for s in sites_of(names, known, compat)], SITE_FIELDS)


GOLDEN = ("EcoRI", "BsaI", "BaeI")


def enzyme_dataset(records: DataFrame, name: str, sites: str, availability: str, compat: bool = False) -> DataFrame:
    """The dimension table of a table of enzymes: ``SITE_FIELDS`` and ``availability``, one row per enzyme and site.

    Several sites in one field are separated by commas; an unknown site (``?``) has null
    sequences; a null or empty field gives no row, one that is no site an error.
    """
    own = records.select(F.col(name).alias("enzyme"), F.col(availability).alias("availability"), F.col(sites).alias("sites")).where("trim(sites) <> ''")

    types = site_types()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, a) for e, a, x in zip(*(c.to_pylist() for c in b.columns)) for i, t in enumerate(x.split(",")) for s, a in [(parse_site(t, e, i, compat), a)]]
            cols = list(zip(*[(*site_row(s), a) for s, a in rows])) or [()] * (len(types) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types.values(), pa.string()])], [*types, "availability"])

    return own.mapInArrow(run, SITE_FIELDS + ", availability string")


def site_types() -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(SITE_FIELDS))}


def site_row(s: Site) -> tuple:
    """A site as the values of ``SITE_FIELDS``."""
    pair = lambda x: None if x is None else [x, flipped(x)]
    return (s.enzyme, s.cutsite_no, s.shorthand, pair(s.core), pair(s.full), list(p) if (p := s.patterns(False)) else None, list(p) if (p := s.patterns()) else None, list(s.cut_fwd), list(s.cut_rev))


def wrong_sites(dataset: DataFrame, compat: bool = False) -> DataFrame:
    """``enzyme, field``: what differs of the known enzymes ``GOLDEN`` in a dataset; a missing enzyme is its field ``enzyme``."""
    spark = dataset.sparkSession
    known = enzyme_table(spark, list(GOLDEN), compat=compat)
    fields = [c for c in known.columns if c not in ("enzyme", "cutsite_no")]
    own = dataset.select("enzyme", "cutsite_no", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_there"))
    both = known.join(own, ["enzyme", "cutsite_no"], "left")
    wrong = F.when(F.col("_there").isNull(), F.array(F.lit("enzyme"))).otherwise(F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in fields]), lambda x: x.isNotNull()))
    return both.select("enzyme", F.explode(wrong).alias("field"))


def build_enzyme_dataset(records: DataFrame, name: str, sites: str, availability: str, path: str) -> DataFrame:
    """Write the dimension table of ``records`` to ``path``, if its known enzymes are right, and return it; else an error."""
    dataset = enzyme_dataset(records, name, sites, availability)
    if bad := [tuple(r) for r in wrong_sites(dataset).collect()]:  # a few rows at most
        raise ValueError(f"wrong enzymes: {bad}")
    dataset.coalesce(1).write.mode("overwrite").parquet(path)
    return records.sparkSession.read.parquet(path)


def sites_of_table(dataset: DataFrame, names: list[str]) -> list[Site]:
    """Sites of the named enzymes of a dimension table, for the searches; an unknown name is an error."""
    rows = dataset.where(F.col("enzyme").isin(*names)).select("enzyme", "cutsite_no", "shorthand").orderBy("enzyme", "cutsite_no").collect()  # the named ones only
    if missing := set(names) - {r["enzyme"] for r in rows}:
        raise ValueError(f"unknown enzymes: {', '.join(sorted(missing))}")
    return [parse_site(r["shorthand"], r["enzyme"], r["cutsite_no"]) for r in rows]


def enzyme_sites(records: DataFrame, name: str, sites: str) -> DataFrame:
    """``enzyme, cutsite_no, shorthand`` of a table that has several sites in one field, separated by commas."""
    return records.select(F.col(name).alias("enzyme"), F.posexplode(F.split(F.col(sites), ",")).alias("cutsite_no", "shorthand")).withColumn("shorthand", F.trim("shorthand"))


def find_sites(df: DataFrame, key: str, seq: str, sites: list[Site], full: bool = True) -> DataFrame:
    """All matches that don't overlap each other, of the pattern and of its reverse complement, in places of the forward strand.

    Sites are constants of the plan.  ``key, enzyme, cutsite_no, strand, start_idx, end_idx, cut_fwd, cut_rev, pair_regex``.
    """
    plans = [(s, strand, re.compile(p[i]), p[1 - i]) for s in sites if (p := s.patterns(full)) for i, strand in ((0, 1), (1, -1))]

    def work(t: str) -> dict[str, object]:
        hits = [(s, strand, m.start(), m.end(), pair) for s, strand, p, pair in plans for m in p.finditer(t)]
        return {
            "enzyme": [h[0].enzyme for h in hits], "cutsite_no": [h[0].cutsite_no for h in hits], "strand": [h[1] for h in hits],
            "start_idx": [h[2] for h in hits], "end_idx": [h[3] for h in hits],
            "cut_fwd": [list(h[0].cut_fwd) for h in hits], "cut_rev": [list(h[0].cut_rev) for h in hits], "pair_regex": [h[4] for h in hits],
        }

    return per_record(df, key, seq, work, "enzyme string, cutsite_no int, strand int, start_idx int, end_idx int, cut_fwd array<int>, cut_rev array<int>, pair_regex string")


def count_sites(df: DataFrame, key: str, seq: str, sites: list[Site], full: bool = True) -> DataFrame:
    """``key, enzyme, cutsite_no, n``: matches on both strands; a palindrome counts twice."""
    s = F.col(f"`{seq}`")
    counted = F.array(*[
        F.struct(F.lit(x.enzyme).alias("enzyme"), F.lit(x.cutsite_no).alias("cutsite_no"), (F.regexp_count(s, F.lit(p[0])) + F.regexp_count(s, F.lit(p[1]))).alias("n"))
        for x in sites if (p := x.patterns(full))
    ])
    return df.select(F.col(f"`{key}`").alias(key), F.explode(counted).alias("_x")).select(key, "_x.*")


def has_sites(seq: Column, sites: list[Site], full: bool = True) -> Column:
    """Whether any site lies on either strand."""
    return seq.rlike("|".join(dict.fromkeys(p for x in sites if (q := x.patterns(full)) for p in q)))


def digest(df: DataFrame, key: str, seq: str, sites: list[Site], circular: bool = False) -> DataFrame:
    """Fragments of a complete digestion: ``key, frag_no, start_idx, end_idx, fragment, overhang``.

    ``start_idx`` and ``end_idx`` are cuts of the forward strand; ``overhang`` is the
    offset of the forward cut against the reverse one at the fragment's begin (negative:
    the forward strand is longer there), 0 at a blunt cut and at the end of a linear record.
    A circular record is cut also across its origin; uncut it is one fragment with null overhang.
    """
    plans = [(re.compile(f"(?=({p[i]}))"), x, i) for x in sites if (p := x.patterns()) for i in (0, 1)]

    def cuts(t: str) -> dict[int, int]:
        n, out = len(t), {}
        text = t + t[: max((x.width() for x in sites), default=1) - 1] if circular else t
        for p, x, back in plans:
            for m in p.finditer(text):
                if m.start() >= n:
                    continue
                width = len(m[1])
                for f, r in zip(x.cut_fwd, x.cut_rev):
                    # the pair of cuts of a site on the other strand, in places of this one
                    a, b = (m.start() + f, m.start() + r) if not back else (m.start() + width - r, m.start() + width - f)
                    if x.core == flipped(x.core or "") and not back or x.core != flipped(x.core or ""):
                        if circular:
                            out[a % n] = a - b
                        elif 0 < a < n:
                            out[a] = a - b
        return out

    def work(t: str) -> dict[str, object]:
        found = sorted(cuts(t).items()) if t else []
        if circular and found:
            begin = [a for a, _ in found]
            end = begin[1:] + [begin[0] + len(t)]
            frag = [(t + t)[a:b] for a, b in zip(begin, end)]
            over = [o for _, o in found]
        else:
            begin = [0] + [a for a, _ in found]
            end = begin[1:] + [len(t)]
            frag = [t[a:b] for a, b in zip(begin, end)]
            over = [None if circular else 0] + [o for _, o in found]
        return {"frag_no": list(range(1, len(frag) + 1)), "start_idx": begin, "end_idx": end, "fragment": frag, "overhang": over}

    return per_record(df, key, seq, work, "frag_no int, start_idx int, end_idx int, fragment string, overhang int")
