"""GenBank flat files: reading into nested rows, writing them back."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INFO = (
    "name string, length int, stranded string, molecule_type string, form string, gb_division string, mod_date string, definition string, accession string, "
    "version string, GI string, dblink string, keywords string, source string, organism array<string>, "
    "references array<struct<r_index:int,start_idx:int,end_idx:int,authors:string,title:string,journal_info:string,pubmed:string>>, comment struct<text:string,assembly:array<string>>"
)
FEATURES = "array<struct<type:string,location:string,qualifiers:map<string,array<string>>>>"
SCHEMA = f"info struct<{re.sub(r'(^|, )(\w+) ', r'\1\2:', INFO)}>, features {FEATURES}, seq string"
_LOCUS = re.compile(r"LOCUS\s+(\S+)\s+(\d+) bp\s+(?:([smd]s)-)?(\S+)?(?:\s+(linear|circular))?(?:\s+([A-Z]{3}))?(?:\s+(\d\d-[A-Z]{3}-\d{4}))?\s*$")
_QUALIFIER = re.compile(r"/([^=\s]+)(?:=(.*))?$", re.S)
#: Qualifiers whose values stand without quotes.
BARE = {"codon_start", "transl_table", "transl_except"}


def _blocks(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    """Header fields: keyword in the first twelve columns, text behind it, also on the lines that follow."""
    name, text = "", []
    for line in lines:
        key = line[:12].strip()
        if key and not line.startswith(" " * 12):
            if name:
                yield name, text
            name, text = key, [line[12:].rstrip()]
        elif name:
            text.append(line[12:].rstrip() if len(line) > 12 else "")
    if name:
        yield name, text


def _feature_rows(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    parts: list[str] = []
    for line in lines:
        if line[5:6].strip():
            out.append({"type": line[5:21].strip(), "parts": [line[21:].strip()]})
        elif out and line.strip():
            parts = out[-1]["parts"]
            text = line[21:].rstrip()
            inside = len(parts) > 1 and parts[-1].count('"') % 2 == 1 and "=\"" in parts[-1]
            if text.lstrip().startswith("/") and not inside:
                parts.append(text.strip())
            else:
                parts[-1] += "\n" + text.strip()
    for f in out:
        location, *quals = f.pop("parts")
        f["location"] = re.sub(r"\s+", "", location)
        values: dict[str, list[str | None]] = {}
        for q in quals:
            m = _QUALIFIER.match(q)
            if not m:
                continue
            glue = "" if m[1] == "translation" else " "
            value = None if m[2] is None else m[2].replace("\n", glue)
            if value is not None and len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1].replace('""', '"')
            values.setdefault(m[1], []).append(value)
        f["qualifiers"] = list(values.items())
    return out


def parse_record(text: str) -> dict | None:
    """One record as nested values; null for text without a LOCUS line."""
    lines = text.replace("\r\n", "\n").split("\n")
    cut = {k: next((i for i, x in enumerate(lines) if x.startswith(k)), len(lines)) for k in ("LOCUS", "FEATURES", "ORIGIN", "//")}
    if cut["LOCUS"] == len(lines):
        return None
    head_end = min(cut["FEATURES"], cut["ORIGIN"], cut["//"])
    info: dict = dict.fromkeys(x.split()[0] for x in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", INFO).split(", "))
    m = _LOCUS.match(lines[cut["LOCUS"]])
    if m:
        info |= {"name": m[1], "length": int(m[2]), "stranded": m[3], "molecule_type": m[4], "form": m[5], "gb_division": m[6], "mod_date": m[7]}
    refs: list[dict] = []
    comments: list[list[str]] = []
    for key, body in _blocks(lines[cut["LOCUS"] + 1 : head_end]):
        joined = " ".join(x.strip() for x in body if x.strip())
        if key in ("DEFINITION", "ACCESSION", "DBLINK", "KEYWORDS", "SOURCE"):
            info[key.lower()] = joined
        elif key == "VERSION":
            version, _, gi = joined.partition("GI:")
            info |= {"version": version.strip(), "GI": gi.strip() or None}
        elif key == "ORGANISM":
            info["organism"] = [body[0].strip(), *([" ".join(x.strip() for x in body[1:])] if len(body) > 1 else [])]
        elif key == "REFERENCE":
            n = re.match(r"(\d+)(?:\s+\(bases (\d+) to (\d+)\))?", joined)
            refs.append({"r_index": int(n[1]) if n else None, "start_idx": int(n[2]) if n and n[2] else None, "end_idx": int(n[3]) if n and n[3] else None, "authors": None, "title": None, "journal_info": None, "pubmed": None})
        elif refs and key in ("AUTHORS", "TITLE", "JOURNAL", "PUBMED"):
            refs[-1]["journal_info" if key == "JOURNAL" else key.lower()] = joined
        elif key == "COMMENT":
            comments.append(body)
    if refs:
        info["references"] = refs
    if comments:
        lines_ = [x for c in comments for x in c]
        gap = next((i + 2 for i in range(len(lines_) - 2) if not lines_[i].strip() and not lines_[i + 1].strip()), len(lines_))
        at = min(gap, next((i for i, x in enumerate(lines_) if x.startswith("##")), len(lines_)))
        info["comment"] = {"text": " ".join(x.strip() for x in lines_[:at] if x.strip()), "assembly": [x.strip() for x in lines_[at:] if x.strip()] or None}
    seq = re.sub(r"[\s\d]+", "", "".join(lines[cut["ORIGIN"] + 1 : max(cut["//"], cut["ORIGIN"] + 1)])) if cut["ORIGIN"] < len(lines) else None
    return {"info": info, "features": _feature_rows(lines[cut["FEATURES"] + 1 : min(cut["ORIGIN"], cut["//"])]), "seq": seq}


def parse_genbank(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, record_no, info, features, seq``: every record of each text (records end with ``//``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(SCHEMA))}
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.posexplode(F.split(F.col(f"`{text}`"), r"(?m)^//[ \t]*$")).alias("_i", "text")).where(F.trim("text") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, r) for i, t in enumerate(b.column(2).to_pylist()) if (r := parse_record(t)) is not None]
            own = pa.array([i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), *[pa.array([r[n] for _, r in got], t) for n, t in types.items()]], ["key", "record_no", *types]
            )

    return rows.mapInArrow(run, f"key {kind}, record_no int, {SCHEMA}").withColumnRenamed("key", key)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parse_genbank(files, "file", "value")


def _soft(text: str, width: int, indent: str) -> str:
    return ("\n" + indent).join(textwrap.wrap(text, width, break_on_hyphens=False)) if text else ""


def _at_commas(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` that end behind commas where there are any."""
    lines = [""]
    for part in re.findall(r"[^,]*,|[^,]+$", text):
        if lines[-1] and len(lines[-1]) + len(part) > width:
            lines.append("")
        lines[-1] += part
    return lines


def record_text(info: dict, features: list[dict], seq: str | None, ordered: bool = False) -> str:
    """The flat file of one record: 79 columns, qualifiers in 58, sequence in six groups of ten."""
    pad = " " * 12
    field = lambda key, text: f"{key:<12}{_soft(text, 67, pad)}\n"
    kind = (f"{info['stranded']}-" if info.get("stranded") else "") + (info.get("molecule_type") or "")
    form = {"linear": "linear  ", None: ""}.get(info.get("form"), info.get("form"))
    out = ["LOCUS       %-16s %11d bp    %-6s  %8s %s %s\n" % (info.get("name") or "", info.get("length") or 0, kind, form, info.get("gb_division") or "", info.get("mod_date") or "")]
    out += [field(k.upper(), info[k]) for k in ("definition", "accession") if info.get(k)]
    if info.get("version"):
        out.append(f"VERSION     {info['version']}" + (f"  GI:{info['GI']}" if info.get("GI") else "") + "\n")
    out += [field(k.upper(), info[k]) for k in ("dblink", "keywords", "source") if info.get(k)]
    if info.get("organism"):
        first, *rest = info["organism"]
        out.append(f"  ORGANISM  {first}\n" + "".join(f"{pad}{_soft(x, 67, pad)}\n" for x in rest))
    for r in info.get("references") or []:
        place = f"  (bases {r['start_idx']} to {r['end_idx']})" if r.get("start_idx") is not None and r.get("end_idx") is not None else ""
        out.append(f"REFERENCE   {r['r_index']}{place}\n")
        out += [field(f"  {k}", r[v]) for k, v in (("AUTHORS", "authors"), ("TITLE", "title"), ("JOURNAL", "journal_info"), ("PUBMED", "pubmed")) if r.get(v)]
    if c := info.get("comment"):
        out.append(field("COMMENT", c["text"]) + (f"{pad}\n{pad}\n" + "".join(f"{pad}{x}\n" for x in c["assembly"]) if c.get("assembly") else ""))
    out.append("FEATURES             Location/Qualifiers\n")
    inner = " " * 21
    for f in features or []:
        location = re.sub(r"\s+", "", f["location"] or "")
        out.append(f"     {f['type'] or '-':<16}" + ("\n" + inner).join(_at_commas(location, 58)) + "\n")
        quals = f["qualifiers"] or []
        pairs = list(quals.items()) if isinstance(quals, dict) else list(quals)
        for name, values in sorted(pairs, key=lambda x: x[0]) if ordered else pairs:
            for v in (sorted(values or [None], key=lambda x: x or "") if ordered else values or [None]):
                if v is None:
                    out.append(f"{inner}/{name}\n")
                elif name in BARE:
                    out.append(f"{inner}/{name}={v}\n")
                else:
                    text = f'/{name}="' + (re.sub(r"\s+", "", v) if name == "translation" else v).replace('"', '""') + '"'
                    body = ("\n" + inner).join(text[i : i + 58] for i in range(0, len(text), 58)) if name == "translation" else _soft(text, 58, inner)
                    out.append(f"{inner}{body}\n")
    out.append("ORIGIN      \n")
    s = re.sub(r"[\s\d]+", "", seq or "")
    out += ["%9d %s\n" % (i + 1, " ".join(s[i + j : i + j + 10] for j in range(0, min(60, len(s) - i), 10))) for i in range(0, len(s), 60)]
    return "".join(out) + "//\n"


def genbank_text(df: DataFrame, key: str, ordered: bool = False) -> DataFrame:
    """``key, text``: the flat file of every row of ``info, features, seq``."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([record_text(i or {}, f, s, ordered) for i, f, s in rows], pa.string())], ["key", "text"])

    return df.select(F.col(f"`{key}`").alias("key"), "info", "features", "seq").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def write_genbank(df: DataFrame, key: str, path: str) -> None:
    genbank_text(df, key).select(F.col("text").alias("value")).write.text(path)
