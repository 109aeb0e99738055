"""Problem 1: consolidating pairwise matches into groups.

The graph of matches is reduced round by round: vertices of degree one are stripped and chains of degree-two vertices are
compressed by list ranking, that is pointer doubling from every chain vertex to both ends of its chain.  A chain that
ends in a leaf goes as a whole, any other becomes one edge, so a round takes all chains whatever their length, and trees
vanish in O(log n) rounds.  What is left is a core of vertices with three or more neighbours and of plain cycles.  A core
of at most CORE edges is solved exactly by one worker; a larger one is contracted by random mating, after which there are
leaves and chains again.  Every removed vertex remembers one vertex that outlived it.  These memories form a forest whose
depth is the number of rounds; labels are restored along it by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id, is_entity_id
from annalist.operators.skew import join_unique
from annalist.session import cut, cut_counted, ship

MAX_ROUNDS = 200
#: Edges of a core that one worker solves (its memory then holds at most twice as many ids).
CORE = 500_000


def match_pairs(entities: DataFrame, alias_links: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of linked ids.

    The aliases of an entity link it where they are ids; rows of ``alias_links`` link both their ids if ``is_match`` is
    true (rejected and undecided pairs do not).  Null and empty ids and self pairs link nothing.
    """
    e = entities.select(clean_id(F.col("id")).alias("x"), F.explode("aliases").alias("alias")).select("x", clean_id(F.col("alias")).alias("y")).where(is_entity_id(F.col("y")))
    m = alias_links.where("is_match").select(clean_id(F.col("alias")).alias("x"), clean_id(F.col("canonical")).alias("y"))
    d = e.unionByName(m).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    return d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _walks(low: DataFrame) -> DataFrame:
    """List ranking of all chains at once: for each vertex ``u`` of degree one or two and each way ``w`` out of it, where the
    way ends: ``end``, whether that is a leaf, and ``steps``.  Ways around a plain cycle have no end and null here.

    A way (u, w) goes on with (w, x) where w is a chain vertex with the other neighbour x, which the way (w, u) tells: ways
    meet ways by both their vertices, so a hub beside many chains is no hot key.  Pointer doubling then skips 2^k vertices
    in round k.
    """
    ways = low.select("u", F.explode(F.when(F.col("n") == 2, F.array(F.struct(F.col("n1").alias("w"), F.col("n2").alias("x")), F.struct(F.col("n2").alias("w"), F.col("n1").alias("x")))).otherwise(F.array(F.struct(F.col("n1").alias("w"), F.lit(None).cast("string").alias("x"))))).alias("e")).select("u", "e.w", "e.x")
    back = ways.select(F.col("u").alias("w"), F.col("w").alias("u"), F.col("x").alias("next"), F.lit(True).alias("is_low"))
    d = ways.select("u", "w").join(back, ["u", "w"], "left")
    ended = F.col("next").isNull()
    # (a, b) is the way that this one goes on with, null when it has ended.
    d = d.select("u", "w", F.when(~ended, F.col("w")).alias("a"), F.col("next").alias("b"), F.when(ended, F.col("w")).alias("end"), F.when(ended, F.coalesce("is_low", F.lit(False))).alias("end_leaf"), F.lit(1).cast("bigint").alias("steps"))
    d, left = cut_counted(d, "ways", "a IS NOT NULL")
    while left:
        on = d.select(F.col("u").alias("a"), F.col("w").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("end").alias("end2"), F.col("end_leaf").alias("leaf2"), F.col("steps").alias("steps2"))
        moved = d.where("a IS NOT NULL").join(on, ["a", "b"]).select("u", "w", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("end2").alias("end"), F.col("leaf2").alias("end_leaf"), (F.col("steps") + F.col("steps2")).alias("steps"))
        d, now = cut_counted(d.where("a IS NULL").unionByName(moved), "ways", "a IS NOT NULL", d)
        # The vertices of a chain are 1, 2, 3, ... steps from its end, so each round ends some way of every chain that is
        # open; if none ended, only plain cycles are left.
        if now == left:
            break
        left = now
    return d


def _reduce(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One round of stripping and compressing: (edges left, removed vertices ``v`` with ``up``, how many).

    Chains that end in a leaf hang on their other end and go with it; all others become one edge between their ends.
    """
    # Degree and the two outermost neighbours come from one map-side combined aggregation, so hubs are never joined.
    low, n_low = cut_counted(_both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("n1"), F.max("v").alias("n2")).where("n <= 2"), "low")
    if not n_low:
        return edges, low.select(F.col("u").alias("v"), F.col("n1").alias("up")).limit(0), 0
    ends = F.sort_array(F.collect_list(F.struct("end_leaf", "end")))
    # One or two ways per vertex; those of plain cycles stay for the core.
    d = _walks(low).where("a IS NULL").groupBy("u").agg(ends.alias("e"))
    d = d.select("u", F.col("e")[0].alias("p"), F.get("e", F.lit(1)).alias("q")).join(low, "u")
    leaf = F.col("n") == 1
    # A leaf hangs on the end of its way, and stays where that is a larger leaf.  A chain vertex hangs on an end that is no
    # leaf if there is one (those come first), else on the smaller leaf.
    up = F.when(leaf & F.col("p.end_leaf") & (F.col("u") < F.col("p.end")), None).when(leaf, F.col("p.end")).otherwise(F.col("p.end"))
    bridge = F.when(~leaf & ~F.col("q.end_leaf") & (F.col("p.end") != F.col("q.end")), F.struct(*_pair(F.col("p.end"), F.col("q.end"))))
    gone, n = cut_counted(d.select("u", "n", "n1", "n2", up.alias("up"), bridge.alias("bridge")), "gone", "up IS NOT NULL", low)
    ways = F.array(F.struct(*_pair(F.col("u"), F.col("n1"))), F.struct(*_pair(F.col("u"), F.col("n2"))))
    old = gone.select(F.explode(ways).alias("e")).select("e.a", "e.b")
    new = gone.where("bridge IS NOT NULL").select("bridge.a", "bridge.b")
    left = edges.join(old, ["a", "b"], "left_anti").unionByName(new).distinct()
    return left, gone.where("up IS NOT NULL").select(F.col("u").alias("v"), "up"), n


def _solve(edges: DataFrame) -> DataFrame:
    """``v`` -> ``up`` (the smallest vertex of its component) of a core of at most CORE edges, by one worker."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def find(x: str) -> str:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up[x]
            return top

        for pdf in parts:
            for a, b in zip(pdf["a"], pdf["b"]):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        out = [(x, find(x)) for x in list(up)]
        yield pd.DataFrame([r for r in out if r[0] != r[1]], columns=["v", "up"])

    ship(edges.sparkSession)
    return cut(edges.coalesce(1).mapInPandas(run, "v string, up string"), "core")


def _contract(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One round of random mating on the core: each tail joins its smallest neighbour that is a head."""
    head = lambda c: F.xxhash64(c, F.lit(-1 - k)) % 2 == 0
    mates = cut(_both_ways(edges).where(~head("u") & head("v")).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up")), "mates")
    to = mates.select(F.col("v").alias("m"), "up")
    d = join_unique(edges.withColumnRenamed("a", "m"), to, "m", "left").select(F.coalesce("up", "m").alias("a"), "b")
    d = join_unique(d.withColumnRenamed("b", "m"), to, "m", "left").select("a", F.coalesce("up", "m").alias("b"))
    return d.where("a <> b").select(*_pair(F.col("a"), F.col("b"))).distinct(), mates


def components(pairs: DataFrame) -> DataFrame:
    """``id`` and ``group_id`` (smallest id of the group) of every id in ``pairs`` (distinct, ``a`` < ``b``)."""
    edges, left = cut_counted(pairs.select("a", "b"), "edges")
    removed = []
    for k in range(MAX_ROUNDS):
        if not left:
            break
        d, r, n = _reduce(edges)
        if n:
            removed.append(r)
            edges, left = cut_counted(d, "edges", drop=edges)
        if n * 20 >= left or not left:
            continue
        # Little of degree one or two is left: this is the core.
        if left <= CORE:
            removed.append(_solve(edges))
            break
        d, r = _contract(edges, k)
        removed.append(r)
        edges, left = cut_counted(d, "edges", drop=edges)
    else:
        raise RuntimeError("the reduction did not end")
    if not removed:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("group_id")).limit(0)
    forest = cut(reduce(DataFrame.unionByName, removed), "forest")
    while True:
        # up <- up of up; a vertex that was never removed is the end of the line.
        step = forest.select(F.col("v").alias("up"), F.col("up").alias("up2"))
        moved = join_unique(forest, step, "up", "left").select("v", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("open"))
        moved, still = cut_counted(moved, "forest", "open")
        forest = moved.select("v", "up")
        if not still:
            break
    names = forest.groupBy("up").agg(F.min("v").alias("least")).select("up", F.least("up", "least").alias("group_id"))
    members = join_unique(forest, names, "up").select(F.col("v").alias("id"), "group_id")
    return members.unionByName(names.select(F.col("up").alias("id"), "group_id"))


def found(entities: DataFrame, alias_links: DataFrame) -> DataFrame:
    """p1_found: every id in a group of two or more.  Empty tables give no rows."""
    return components(match_pairs(entities, alias_links))


def sizes(groups: DataFrame) -> DataFrame:
    """How many groups there are of each size."""
    n = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_ids"))
    return n.groupBy("n_ids").agg(F.count(F.lit(1)).alias("n_groups"))
