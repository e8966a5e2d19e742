"""Periods and gaps, nested records: against brute force and known values, with awkward input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import islands, nested


def brute(rows):
    out = []
    for k in sorted({r[0] for r in rows}, key=repr):
        covered = set()
        for key, a, b in rows:
            if key == k and a is not None and b is not None:
                covered |= set(range(min(a, b), max(a, b) + 1))
        runs = []
        for x in sorted(covered):
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out += [(k, "period", a, b) for a, b in runs] + [(k, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:])]
    return sorted(out, key=repr)


def got(spark, rows, partitions):
    df = spark.createDataFrame(rows, "k string, start long, end long").withColumn("kind", F.lit("other column"))
    return sorted(map(tuple, islands.periods_and_gaps(df, ["k"], "start", "end", partitions).collect()), key=repr)


def test_periods_against_brute_force(spark):
    rng = random.Random(1)
    for partitions in (1, 3, 9):
        rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), a := rng.randint(1, 400), a + rng.randint(-3, 12)) for _ in range(150)]
        rows += [("long", 1, 900), ("long", 5, 6), ("long", 901, 901), ("one", 3, None), (None, None, 4), ("hot", 7, 7), ("hot", 7, 7)]
        assert got(spark, rows, partitions) == brute(rows)


def test_one_entity_over_many_partitions(spark):
    rows = [("hot", i * 10, i * 10 + 4) for i in range(300)] + [("hot", 500, 1500)]
    assert got(spark, rows, 8) == brute(rows)


def test_no_intervals(spark):
    assert got(spark, [], 3) == []


def test_current_exons(spark):
    t = lambda n: f"2024-01-0{n} 00:00:00"
    rows = [(" transcript:enst1.4 ", "e1", 10, 1, "1", t(1)), ("ENST1", "e1", 5, 8, "1", t(2)), ("ENST1", "e1", 5, 8, "1", t(2)), ("enst1.2", "e2", None, 9, "1", t(1)), ("ENST1", "e3", 12, 12, "1", t(1)), (None, "e4", 1, 2, "1", t(1)), ("ENST1", "e5", 1, 2, "2", t(1))]
    df = spark.createDataFrame(rows, "Parent string, id string, start long, end long, seq_region_name string, loaded_at string").withColumns({"loaded_at": F.to_timestamp("loaded_at"), "exon": F.lit(1)})
    out = sorted(map(tuple, islands.exon_periods(df).collect()))
    assert out == [("ENST1", "1", "gap", 9, 11), ("ENST1", "1", "period", 5, 8), ("ENST1", "1", "period", 12, 12), ("ENST1", "2", "period", 1, 2)]


SCHEMA = "id long, info struct<name:string,size:struct<w:int,h:int>>, parts array<struct<n:string,bits array<int>>>, tags map<string,array<string>>".replace("bits array", "bits:array")


def test_typed_tables(spark):
    df = spark.createDataFrame([(1, ("x", (2, 3)), [("p", [7, 8]), None, ("q", None)], {"t": ["u", None]}), (2, None, None, None), (3, ("y", None), [], {})], SCHEMA)
    s = nested.Shredded.typed(df, "id")
    top = {r["root_id"]: (r["record_info_name"], r["record_info_size_w"]) for r in s.table("record").collect()}
    assert top == {1: ("x", 2), 2: (None, None), 3: ("y", None)}
    assert sorted((r["root_id"], r["child_no"], r["parts_n"]) for r in s.table("parts").collect()) == [(1, 1, "p"), (1, 3, "q")]
    bits = s.table("bits").collect()
    assert sorted((r["parent_key"], r["child_no"], r["bits_value"]) for r in bits) == [("1", 1, 7), ("1", 2, 8)]
    assert {r["parent_row"] for r in bits} <= {r["row_id"] for r in s.table("parts").collect()}
    assert [(r["parent_key"], r["child_no"], r["tags_value_value"]) for r in s.table("tags_value").collect()] == [("t", 1, "u")]
    assert nested.Shredded.typed(df.limit(0), "id").table("parts").count() == 0


def test_shared_and_recursive_elements(spark):
    E, edge = nested.Element, nested.Edge
    g = nested.SchemaGraph("doc", [E("doc", {"t": "string"}, [edge("head", "head"), edge("body", "part", many=True)]), E("head", {"a": "string"}, [edge("note", "note")]), E("part", {"s": "string"}, [edge("part", "part", many=True), edge("note", "note")]), E("note", {"x": "string"})])
    assert set(g.tables) == {"doc", "part", "note"} and g.recursive == {"part"}
    text = json.dumps({"t": "T", "head": {"a": "A", "note": {"x": "n0"}}, "body": [{"s": "1", "part": [{"s": "1.1", "note": {"x": "n1"}}, {"s": "1.2", "part": {"s": "1.2.1"}}]}, None, {"s": "3"}]})
    df = spark.createDataFrame([(5, text)], "k long, j string").select("k", nested.whole_json(F.col("j")).alias("v"))
    s = nested.Shredded.json(df, "k", "v", g)
    assert [(r["doc_t"], r["doc_head_a"]) for r in s.table("doc").collect()] == [("T", "A")]
    assert sorted(r["part_s"] for r in s.table("part").collect()) == ["1", "1.1", "1.2", "1.2.1", "3"]
    assert sorted(r["note_x"] for r in s.table("note").collect()) == ["n0", "n1"]
    rows = {r["row_id"] for r in s.table("part").collect()}
    assert all(r["parent_row"] in rows or r["parent_row"] == "" for r in s.table("part").collect())


def test_whole_json(spark):
    texts = ['{"a": 1}', '{"a": 1', "<html>", "", None, "null", "[1, 2]", '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(nested.whole_json(F.col("t"))).alias("o")).orderBy("i")
    assert [r["o"] for r in df.collect()] == ['{"a":1}', None, None, None, None, "null", "[1,2]", None, None]


def test_location_parts(spark):
    texts = ["join(<4116..4193 ,\ncomplement(4204..>4274),7)", "9^10", "complement(A1.2:3..5)", "", None, "order(1,B2.1:8)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", nested.location_parts(F.col("t")).alias("o")).orderBy("i")
    assert [r["o"] for r in df.collect()] == [["4116..4193", "4204..4274", "7..7"], ["9..10"], ["A1.2:3..5"], [], None, ["1..1", "B2.1:8..8"]]


def test_lookup_and_records(spark):
    exon = lambda i: {"id": i, "object_type": "Exon"}
    gene = lambda e: {"id": "G", "object_type": "Gene", "Transcript": {"id": "T", "Exon": e}}
    payloads = [(1, "2024-01-01", json.dumps(gene([exon("old")]))), (2, "2024-01-02", json.dumps({"G": gene([None, exon("e2"), {"id": None}, {}, exon("e5")]), "H": None})), (3, "2024-01-03", json.dumps(gene([exon("cut")]))[:-3]), (4, "2024-01-03", "null"), (5, "2024-01-01", json.dumps([{"id": "K", "object_type": "Gene", "Transcript": [{"id": "T2", "Exon": exon("lone")}, None, {"id": "T3", "Exon": None}]}, None]))]
    look = spark.createDataFrame(payloads, "raw_id long, t string, payload string").select("raw_id", F.to_timestamp("t").alias("fetched_at"), "payload")
    feats = "array<struct<type:string,location:string,qualifiers:map<string,array<string>>>>"
    gb = spark.createDataFrame([(1, [("CDS", "1..3", {"translation": ["M K*", "", None]}), ("gene", None, None)], "2024-01-02"), (1, [("CDS", "7", None)], "2024-01-01"), (2, None, "2024-01-01")], f"rec_id long, features {feats}, t string").select("rec_id", "features", F.to_timestamp("t").alias("loaded_at"))
    out = sorted(map(tuple, nested.nested_parts(look, gb).collect()))
    assert out == sorted([("exon", "G", "T", 2, "e2"), ("exon", "G", "T", 5, "e5"), ("exon", "K", "T2", 1, "lone"), ("location", "1", "1", 1, "1..3"), ("translation", "1", "1", 1, "2")])
    assert nested.nested_parts(look.limit(0), gb.limit(0)).count() == 0


def test_graph_of_json_texts(spark):
    texts = [
        '{"id": "g", "n": 1, "Kid": [{"id": "a", "x": 1}, null, {"id": "b", "x": 2.5, "Toy": {"w": true}}], "tags": ["p", "q"], "none": null}',
        '{"id": "h", "n": "two", "Kid": {"id": "c", "Kid": [{"id": "d"}]}, "Toy": {"w": false, "id": 3}, "empty": []}', None, '{"id": ', "[1]",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    graph = nested.SchemaGraph.of_json(df, "t", "Top")
    kinds = {e.name: (e.scalars, {(x.name, x.many) for x in e.edges}, e.key) for e in graph.elements.values()}
    assert kinds == {
        "Top": ({"id": "string", "n": "string", "tags": "string"}, {("Kid", True), ("Toy", False)}, "id"),
        "Kid": ({"id": "string", "x": "double"}, {("Kid", True), ("Toy", False)}, "id"),
        "Toy": ({"id": "bigint", "w": "boolean"}, set(), "id"),
    }
    assert graph.recursive == {"Kid"} and set(graph.tables) == {"Top", "Kid", "Toy"}
    rows = df.select("i", nested.whole_json(F.col("t")).alias("v")).where("v is not null and i < 2")
    kids = nested.Shredded.json(rows, "i", "v", graph).table("Kid")
    assert sorted((r["root_id"], r["parent_key"], r["child_no"], r["Kid_id"], r["Kid_x"]) for r in kids.collect()) == [(0, "g", 1, "a", 1.0), (0, "g", 3, "b", 2.5), (1, "c", 1, "d", None), (1, "h", 1, "c", None)]
    assert nested.SchemaGraph.of_json(df.limit(0), "t", "Top").tables == ["Top"]
    with pytest.raises(ValueError):
        nested.SchemaGraph.of_json(df, "t", "Top", most=3)
