import random

import brute
import pyarrow.parquet as pq
import pytest
from tables import frame, result, rows

from annalist.llm import groups

DIR = "/root/testdata/sf0.001"


def _pairs(spark, edges):
    e = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    return spark.createDataFrame(sorted(e) or [], "a string, b string")


def _want(edges):
    return brute.p1([], [{"alias": a, "canonical": b, "is_match": True} for a, b in edges])


SHAPES = {
    "one pair": [("a", "b")],
    "star": [("hub", f"x{i}") for i in range(40)],
    "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)],
    "ring": [(f"r{i}", f"r{(i + 1) % 15}") for i in range(15)],
    "triangle": [("a", "b"), ("b", "c"), ("a", "c")],
    "clique": [(f"k{i}", f"k{j}") for i in range(7) for j in range(i)],
    "grid": [(f"g{x}-{y}", f"g{x + 1}-{y}") for x in range(5) for y in range(6)] + [(f"g{x}-{y}", f"g{x}-{y + 1}") for x in range(6) for y in range(5)],
    "core with tails": [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)] + [(f"k{i}", f"t{i}") for i in range(6)] + [("t0", "u0"), ("u0", "v0")],
}


SHAPES["loop on a hub"] = SHAPES["clique"] + [("k0", "l0"), ("l0", "l1"), ("l1", "l2"), ("l2", "k0"), ("k1", "m0"), ("m0", "k2"), ("k3", "z0"), ("z0", "a0"), ("a0", "a1")]


def test_shapes(spark):
    """All shapes at once, with names of their own."""
    edges = [(f"{k}:{a}", f"{k}:{b}") for k, e in SHAPES.items() for a, b in e]
    assert result(groups.components(_pairs(spark, edges))) == _want(edges)


def test_walks_reach_both_ends_of_a_chain(spark):
    low = spark.createDataFrame([("a", 1, "b", "b"), ("b", 2, "a", "c"), ("c", 2, "b", "d"), ("d", 2, "c", "hub"), ("r", 2, "s", "t"), ("s", 2, "r", "t"), ("t", 2, "r", "s")], "u string, n long, n1 string, n2 string")
    got = {(r["u"], r["w"]): (r["end"], r["end_leaf"], r["steps"]) for r in groups._walks(low).where("a IS NULL").collect()}
    assert got == {("a", "b"): ("hub", False, 4), ("b", "a"): ("a", True, 1), ("b", "c"): ("hub", False, 3), ("c", "b"): ("a", True, 2), ("c", "d"): ("hub", False, 2), ("d", "c"): ("a", True, 3), ("d", "hub"): ("hub", False, 1)}


@pytest.mark.parametrize("core", [groups.CORE, 0])
def test_random_graph_with_separate_groups(spark, monkeypatch, core):
    monkeypatch.setattr(groups, "CORE", core)
    rng = random.Random(5)
    edges = [(f"v{rng.randint(0, 150)}", f"v{rng.randint(0, 150)}") for _ in range(140)] + SHAPES["clique"] + SHAPES["ring"]
    assert result(groups.components(_pairs(spark, edges))) == _want(edges)


def test_dirty_rows(spark):
    e = rows("entities", [{"id": " SVC-a", "aliases": ["svc-B ", "A name", None, "", "svc-a"]}, {"id": "svc-b", "aliases": None}, {"id": None, "aliases": ["svc-x"]}])
    links = rows("alias_links", [{"alias": "svc-b", "canonical": "feat-Z", "is_match": True}] * 3 + [{"alias": "svc-q", "canonical": "svc-r", "is_match": v} for v in (False, None)] + [{"alias": "", "canonical": "svc-r", "is_match": True}, {"alias": "svc-s", "canonical": " SVC-s", "is_match": True}, {"alias": "no prefix", "canonical": "adr-1", "is_match": True}])
    got = result(groups.found(frame(spark, "entities", e, extra=True), frame(spark, "alias_links", links, extra=True)))
    assert got == brute.p1(e, links) and ("svc-a", "feat-z") in got


def test_empty(spark):
    assert result(groups.found(frame(spark, "entities", []), frame(spark, "alias_links", []))) == set()


def test_small_tables(spark):
    t = {n: pq.read_table(f"{DIR}/{n}.parquet").to_pylist() for n in ("entities", "alias_links")}
    got = groups.found(spark.read.parquet(f"{DIR}/entities.parquet"), spark.read.parquet(f"{DIR}/alias_links.parquet"))
    assert result(got) == brute.p1(t["entities"], t["alias_links"])
