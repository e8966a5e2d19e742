"""Every query outside llm against its SQL, on the smallest tables."""

from pathlib import Path

import oracle
import pytest

from nucleoframe.operators import seeds
from nucleoframe.queries import core

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = core.queries(), core.oracle_sql()


#: Queries that find nothing in the smallest tables.
EMPTY: set[str] = set()


def far(least):
    return lambda r: len(r["members"]) == r["size"] > 1 and all(sum(x != y for x, y in zip(a, b)) >= least for a in r["members"] for b in r["members"] if a < b)


def probe(r):
    arms = r["padlock_seq"][:20] + r["padlock_seq"][-20:]
    return not set(arms) - set("ACGT") and all(8 <= sum(c in "GC" for c in x) <= 13 for x in (arms[:20], arms[20:])) and r["score"] >= 95 and r["idx"] >= 0


#: What must hold of each row of a query that has no SQL.
HOLDS = {
    "p4_json_graph": lambda r: r["field"] != "Exon" or (r["element"], r["kind"]) == ("Transcript", "many"),
    "s6_random_sequence": lambda r: len(r["out"]) == r["n"] == 30 and not set(r["out"]) - set("ACGT"),
    "s7_weighted_random_sequence": lambda r: len(r["out"]) == 30 and not set(r["out"]) - set("ACGT"),
    "w6_all_repeats": lambda r: len(r["repeat"]) >= 12 and len(r["places"]) > 1 and r["places"] == sorted(set(r["places"])) and not set(r["repeat"]) - set("ACGT"),
    "x10_digest_circular": lambda r: len(r["fragment"]) == r["end_idx"] - r["start_idx"] and (r["overhang"] is not None or r["frag_no"] == 1),
    "e11_generate_padlocks": lambda r: probe(r) and 0 <= r["idx"] - r["group_start"] <= 60,
    "e12_design_of_sequences": probe,
    "e12_design_padlocks": lambda r: probe(r) and r["barcode"] in r["padlock_seq"],
    "g6_find_cliques": far(3),
    "d7_find_seeds": lambda r: r["seed"].count("#") == r["weight"] and seeds.check_seed(r["seed"], 10) >= 1,
    "d8_find_seed_pairs": lambda r: seeds.check_seeds(r["family"], 9, 2, 2) == 2,
    "x2_aligned_overhang": lambda r: r["overhang"] is not None,
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert oracle.difference(df, con, SQL[name]) == ""
    else:
        rows = df.collect()
        assert rows or name in EMPTY
        assert all(HOLDS[name](r.asDict()) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
