"""Deeply nested records as related flat tables (problem 4): shared inlining.

The schema is a graph of elements.  Elements that occur once below their parent are
inlined into its table; repeated, shared and recursive ones get a table of their
own, whose rows name their parent and their place in it.  The same graph serves
typed columns (structs, arrays, maps) and JSON held as variants.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from nucleoframe.common import cut_lineage, latest_rows

ROOT, ROW, PARENT, POS, KEY = "root_id", "row_id", "parent_key", "child_no", "child_key"


@dataclass(frozen=True)
class Edge:
    """A child element: ``many`` if it is repeated, ``keyed`` if its entries have keys instead of places."""

    name: str
    child: str
    many: bool = False
    keyed: bool = False


@dataclass
class Element:
    """Scalar fields with their SQL types and child elements; ``key`` is the field that names an entry."""

    name: str
    scalars: dict[str, str] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    key: str | None = None


class SchemaGraph:
    """Elements by name and what becomes of each: a table or columns of another table."""

    def __init__(self, root: str, elements: list[Element]):
        self.root, self.elements = root, {e.name: e for e in elements}
        parents: dict[str, int] = {}
        for e in elements:
            for edge in e.edges:
                parents[edge.child] = parents.get(edge.child, 0) + 1
        repeated = {edge.child for e in elements for edge in e.edges if edge.many or edge.keyed}
        shared = {name for name, n in parents.items() if n > 1}
        self.recursive = {e.name for e in elements if e.name in self._below(e.name)}
        self.tables = [e.name for e in elements if e.name == root or e.name in repeated | shared | self.recursive]

    def _below(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [edge.child for edge in self.elements[name].edges]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [edge.child for edge in self.elements[x].edges]
        return seen

    @classmethod
    def of(cls, schema: StructType, root: str, keys: dict[str, str] | None = None) -> SchemaGraph:
        """The graph of a Spark schema.  Equal structs under one name are one element, wherever they stand."""
        keys, found, kinds = keys or {}, {}, {}

        def name_of(wish: str, kind: DataType) -> str:
            sign = (wish, kind.json())
            if sign not in kinds:
                taken = set(kinds.values())
                kinds[sign] = next(n for i in range(1, len(taken) + 3) if (n := wish if i == 1 else f"{wish}_{i}") not in taken)
            return kinds[sign]

        def visit(name: str, kind: DataType) -> None:
            if name in found:
                return
            e = found[name] = Element(name, key=keys.get(name))
            for f in kind.fields if isinstance(kind, StructType) else []:
                add(e, f.name, f.dataType)
            if isinstance(kind, (ArrayType, MapType)):
                add(e, "value", kind)
            elif not isinstance(kind, StructType):
                e.scalars["value"] = kind.simpleString()

        def add(e: Element, fname: str, kind: DataType) -> None:
            if isinstance(kind, StructType):
                child = name_of(fname, kind)
                e.edges.append(Edge(fname, child))
                visit(child, kind)
            elif isinstance(kind, (ArrayType, MapType)):
                inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
                child = name_of(fname if fname != "value" else f"{e.name}_value", inner)
                e.edges.append(Edge(fname, child, isinstance(kind, ArrayType), isinstance(kind, MapType)))
                visit(child, inner)
            else:
                e.scalars[fname] = kind.simpleString()

        visit(root, schema)
        return cls(root, list(found.values()))


    @classmethod
    def of_json(cls, df: DataFrame, text: str, root: str, key: str = "id", most: int = 10_000) -> SchemaGraph:
        """The graph of the JSON objects in a text column, from all rows.

        Every name under which objects stand is an element, many if they stand in an array
        anywhere, whatever their parent (shared) or depth (recursive); other fields are
        scalars of the narrowest SQL type that holds all their values, string where they
        are mixed or arrays of plain values.  Each task reports every name once, so the
        rows that are gathered are as many as names; more than ``most`` are an error, as
        then the names are data (use a map).  Null and incomplete texts count for nothing.
        """

        def walk(e: str, x: dict, seen: set[tuple[str, str, str]]) -> None:
            for k, v in x.items():
                inner = [v] if isinstance(v, dict) else [y for y in v if isinstance(y, dict)] if isinstance(v, list) else []
                if inner:
                    seen.add((e, k, "many" if isinstance(v, list) else "one"))
                    for y in inner:
                        walk(k, y, seen)
                elif v is not None and v != []:
                    seen.add((e, k, {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[str, str, str]] = set()
            for b in batches:
                for t in b.column(0).to_pylist():
                    try:
                        x = json.loads(t) if t is not None else None
                    except ValueError:
                        continue
                    if isinstance(x, dict):
                        walk(root, x, seen)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*seen)] if seen else [pa.array([], pa.string())] * 3, ["element", "field", "kind"])

        rows = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "element string, field string, kind string").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} names")
        kinds: dict[tuple[str, str], set[str]] = {}
        for r in rows:
            kinds.setdefault((r["element"], r["field"]), set()).add(r["kind"])
        out = {root: Element(root)}
        for (e, k), ks in sorted(kinds.items()):
            own = out.setdefault(e, Element(e))
            if ks & {"one", "many"}:
                own.edges.append(Edge(k, k, many="many" in ks))
                out.setdefault(k, Element(k))
            else:
                own.scalars[k] = next(iter(ks)) if len(ks) == 1 else "double" if ks == {"bigint", "double"} else "string"
        for e in out.values():
            e.key = key if key in e.scalars else None
        return cls(root, list(out.values()))


class _Typed:
    """Access to nested Spark columns."""

    def __init__(self, schema_of: DataFrame):
        self.df = schema_of

    def get(self, node: Column, name: str, single: bool) -> Column:
        return node if single else node.getField(name)

    def scalar(self, node: Column, name: str, kind: str, single: bool) -> Column:
        return self.get(node, name, single)

    def many(self, node: Column, name: str, single: bool) -> Column:
        return self.get(node, name, single)

    keyed = many

    def present(self, node: Column) -> Column:
        return F.lit(True)


class _Json:
    """Access to variants.  A lone entry may stand without its array; a value of another type is null."""

    def get(self, node: Column, name: str, single: bool) -> Column:
        return F.try_variant_get(node, f"$.{name}", "variant")

    def scalar(self, node: Column, name: str, kind: str, single: bool) -> Column:
        return F.try_variant_get(node, f"$.{name}", kind)

    def many(self, node: Column, name: str, single: bool) -> Column:
        lone = F.try_variant_get(node, f"$.{name}", "variant")
        return F.coalesce(
            F.try_variant_get(node, f"$.{name}", "array<variant>"),
            F.when(lone.isNotNull() & ~F.is_variant_null(lone), F.array(lone)),
        )

    def keyed(self, node: Column, name: str, single: bool) -> Column:
        return F.try_variant_get(node, f"$.{name}", "map<string,variant>")

    def present(self, node: Column) -> Column:
        return node.isNotNull() & ~F.is_variant_null(node)


class Shredded:
    """The flat tables of a nested one, built on demand: ``table(name)``.

    Every table has ``root_id`` (the key of the record), ``row_id`` (the row's path
    in it), ``parent_key`` (the key field of the parent's entry, null where that is null; of
    an element without key field its map key, else its place), ``parent_row`` (the parent's ``row_id``), ``child_no`` (the place, from
    1, over all entries, null ones too) and the inlined fields.  Tables are chains of
    generators over the record, without an exchange.

    * a null or empty array gives no rows, a null entry none but keeps its place;
    * a null inlined element gives null fields; a null record key stays null;
    * repeated records give repeated rows; an empty table gives empty tables.
    """

    def __init__(self, nodes: DataFrame, graph: SchemaGraph, access: _Typed | _Json):
        self.nodes, self.graph, self.access = nodes, graph, access
        self.parents: dict[str, list[tuple[str, list[str], Edge]]] = {}
        for t in graph.tables:
            for path, edge in self._table_edges(t, []):
                self.parents.setdefault(edge.child, []).append((t, path, edge))

    @classmethod
    def typed(cls, df: DataFrame, key: str, graph: SchemaGraph | None = None, keys: dict[str, str] | None = None) -> Shredded:
        graph = graph or SchemaGraph.of(StructType([f for f in df.schema.fields if f.name != key]), "record", keys)
        names = [c for c in df.columns if c != key]
        nodes = df.select(F.col(f"`{key}`").alias(ROOT), F.lit("").alias(ROW), F.struct(*[F.col(f"`{c}`").alias(c) for c in names]).alias("_node"))
        return cls(nodes, graph, _Typed(df))

    @classmethod
    def json(cls, df: DataFrame, key: str, variant: str, graph: SchemaGraph) -> Shredded:
        return cls(df.select(F.col(f"`{key}`").alias(ROOT), F.lit("").alias(ROW), F.col(f"`{variant}`").alias("_node")), graph, _Json())

    def _table_edges(self, name: str, path: list[str]):
        for edge in self.graph.elements[name].edges:
            if edge.child in self.graph.tables:
                yield path, edge
            else:
                yield from self._table_edges(edge.child, [*path, edge.name])

    def _plain(self, name: str) -> bool:
        """A typed element that is a bare value and no struct."""
        e = self.graph.elements[name]
        return isinstance(self.access, _Typed) and name != self.graph.root and [*e.scalars, *(x.name for x in e.edges)] == ["value"]

    def _rows(self, name: str) -> DataFrame:
        if name == self.graph.root:
            none = F.lit(None).cast("string")
            top = self.nodes.select(ROOT, ROW, none.alias(PARENT), none.alias("parent_row"), F.lit(1).alias(POS), none.alias(KEY), "_node")
            if name not in self.graph.recursive:
                return top
            return self._levels(name, top)
        out = [self._children(self._rows(t), t, path, e) for t, path, e in self.parents[name] if t != name]
        rows = out[0]
        for x in out[1:]:
            rows = rows.unionByName(x)
        return self._levels(name, rows) if name in self.graph.recursive else rows

    def _levels(self, name: str, rows: DataFrame) -> DataFrame:
        """All generations of a recursive element, one after another until there is none."""
        own = [(path, e) for t, path, e in self.parents.get(name, []) if t == name]
        every, level = rows, cut_lineage(rows)
        while own:
            new = None
            for path, e in own:
                x = self._children(level, name, path, e)
                new = x if new is None else new.unionByName(x)
            level = cut_lineage(new)
            if level.isEmpty():
                break
            every = every.unionByName(level)
        return every

    def _children(self, rows: DataFrame, parent: str, path: list[str], edge: Edge) -> DataFrame:
        node, single = F.col("_node"), self._plain(parent)
        for p in path:
            node, single = self.access.get(node, p, single), False
        e = self.graph.elements[parent]
        label = F.coalesce(F.col(KEY), F.col(POS).cast("string"))
        if e.key:
            label = self.access.scalar(F.col("_node"), e.key, "string", self._plain(parent)).cast("string")
        mine = [ROOT, label.alias(PARENT), F.col(ROW).alias("parent_row")]
        where = F.concat(F.col("parent_row"), F.lit(f"/{edge.name}:"), F.coalesce(F.col(KEY), F.col(POS).cast("string")))
        if edge.many:
            got = rows.select(*mine, F.posexplode(self.access.many(node, edge.name, single)).alias("_i", "_node")).withColumn(POS, F.col("_i") + 1).withColumn(KEY, F.lit(None).cast("string"))
        elif edge.keyed:
            got = rows.select(*mine, F.explode(self.access.keyed(node, edge.name, single)).alias("_k", "_node")).withColumn(POS, F.lit(1)).withColumn(KEY, F.col("_k").cast("string"))
        else:
            got = rows.select(*mine, self.access.get(node, edge.name, single).alias("_node")).withColumn(POS, F.lit(1)).withColumn(KEY, F.lit(None).cast("string"))
        return got.where(F.col("_node").isNotNull()).where(self.access.present(F.col("_node"))).select(ROOT, where.alias(ROW), PARENT, "parent_row", POS, KEY, "_node")

    def _columns(self, name: str, node: Column, prefix: str, single: bool) -> list[Column]:
        e = self.graph.elements[name]
        out = [self.access.scalar(node, s, kind, single).alias(f"{prefix}{s}") for s, kind in e.scalars.items()]
        for edge in e.edges:
            if edge.child not in self.graph.tables:
                out += self._columns(edge.child, self.access.get(node, edge.name, single), f"{prefix}{edge.name}_", False)
        return out

    def table(self, name: str) -> DataFrame:
        """The flat table of an element; an inlined field is called ``<element>_<field>``."""
        keyed = any(e.keyed for _, _, e in self.parents.get(name, []))
        fields = self._columns(name, F.col("_node"), f"{name}_", self._plain(name))
        return self._rows(name).select(ROOT, ROW, PARENT, "parent_row", POS, *([F.col(KEY).alias("map_key")] if keyed else []), *fields)


def whole_json(text: Column) -> Column:
    """The variant of a text that is one complete JSON value, else null."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    rest = F.try_variant_get(one, "$[1]", "variant")
    return F.when(rest.isNull(), F.try_variant_get(one, "$[0]", "variant"))


def location_parts(location: Column) -> Column:
    """The parts of a feature location in the order written, as ``first..last`` with ``accession.version:`` before those of another record."""
    plain = F.regexp_replace(location, r"[\s<>]+", "")
    parts = F.regexp_extract_all(plain, F.lit(r"((?:[^(),:]+:)?\d+(?:(?:\.\.|\^)\d+)?)(?=[,)]|$)"), F.lit(1))

    def span(p: Column) -> Column:
        p = F.replace(p, F.lit("^"), F.lit(".."))
        return F.when(F.contains(p, F.lit("..")), p).otherwise(F.concat(p, F.lit(".."), F.substring_index(p, ":", -1)))

    return F.transform(parts, span)


LOOKUP = SchemaGraph(
    "Gene",
    [
        Element(
            "Gene",
            {"id": "string", "display_name": "string", "description": "string", "species": "string", "seq_region_name": "string", "strand": "int", "start": "bigint", "end": "bigint"},
            [Edge("Transcript", "Transcript", many=True)],
            key="id",
        ),
        Element(
            "Transcript",
            {"id": "string", "display_name": "string", "biotype": "string", "is_canonical": "int", "strand": "int", "start": "bigint", "end": "bigint"},
            [Edge("Exon", "Exon", many=True), Edge("Translation", "Translation"), Edge("UTR", "UTR", many=True)],
            key="id",
        ),
        Element("Exon", {"id": "string", "start": "bigint", "end": "bigint", "strand": "int", "seq_region_name": "string", "version": "int"}, key="id"),
        Element("Translation", {"id": "string", "length": "int"}),
        Element("UTR", {"object_type": "string", "start": "bigint", "end": "bigint"}),
    ],
)


def lookup_genes(lookups: DataFrame) -> DataFrame:
    """``gene_id, gene`` (variant): of every gene the entry of the payload fetched last.

    Payloads that aren't one complete JSON value, entries that are null, no gene or
    without id don't count; ``raw_id`` and the place in the payload decide between
    equal times.
    """
    entry = F.col("entry")
    whole = lookups.select("raw_id", "fetched_at", whole_json(F.col("payload")).alias("whole"))
    is_gene = F.try_variant_get("whole", "$.object_type", "string")
    entries = F.coalesce(
        F.try_variant_get("whole", "$", "array<variant>"),
        F.when(is_gene.isNotNull(), F.array("whole")),
        F.map_values(F.try_variant_get("whole", "$", "map<string,variant>")),
    )
    rows = whole.select("raw_id", "fetched_at", F.posexplode(entries).alias("place", "entry")).where(F.try_variant_get(entry, "$.object_type", "string") == "Gene")
    rows = rows.withColumn("gene_id", F.try_variant_get(entry, "$.id", "string")).where("gene_id <> ''")
    return rows.groupBy("gene_id").agg(F.max_by("entry", F.struct("fetched_at", "raw_id", "place")).alias("gene"))


def nested_parts(lookups: DataFrame, genbank: DataFrame) -> DataFrame:
    """``kind, root_id, parent_key, child_no, child_key``: exons of genes, location parts and translations of records.

    Entries that are null or lack an id or a letter keep their place but aren't
    listed.  Of a record and of a gene only the latest delivery counts.
    """
    exons = Shredded.json(lookup_genes(lookups), "gene_id", "gene", LOOKUP).table("Exon").where("Exon_id <> ''")
    rows = genbank.select("rec_id", "loaded_at", F.transform("features", lambda f: F.struct(
        f["type"].alias("type"), f["location"].alias("location"), F.map_entries(f["qualifiers"]).alias("qualifiers"))).alias("features"))
    current = latest_rows(rows, ["rec_id"], "loaded_at", ["features"]).select("rec_id", F.transform("features", lambda f: F.struct(
        f["type"].alias("type"), f["location"].alias("location"), F.map_from_entries(f["qualifiers"]).alias("qualifiers"))).alias("features"))
    records = Shredded.typed(current, "rec_id")
    features = records.table("features")
    parts = features.select(ROOT, F.col(POS).cast("string").alias(PARENT), F.posexplode(location_parts(F.col("features_location"))).alias("_i", KEY))
    values = records.table("qualifiers_value")
    letters = F.length(F.regexp_replace(F.col("qualifiers_value_value"), r"[^\p{L}]", ""))
    # row_id is /features:<place>/qualifiers:<name>/value:<place>
    translations = values.where((F.col(PARENT) == "translation") & (letters > 0)).select(
        F.lit("translation").alias("kind"), F.col(ROOT).cast("string").alias(ROOT), F.regexp_extract(F.col(ROW), r"^/features:(\d+)/", 1).alias(PARENT), F.col(POS), letters.cast("string").alias(KEY)
    )
    return (
        exons.select(F.lit("exon").alias("kind"), ROOT, PARENT, POS, F.col("Exon_id").alias(KEY))
        .unionByName(parts.select(F.lit("location").alias("kind"), F.col(ROOT).cast("string").alias(ROOT), PARENT, (F.col("_i") + 1).alias(POS), KEY))
        .unionByName(translations)
    )
