"""Problem 5: parent-child links to full hierarchies of unknown depth, with cycles.

Subtree sizes are summed upward, sibling ranges are allocated downward by prefix sums, and the resulting nested sets
(``lft`` .. ``rgt`` in the preorder of a root) answer ancestor and descendant questions: an ancestor is a range that
encloses the place of a node, and the path of a node is the list of its ancestors by their width.  Both sweeps move by
doubling: in round k every node knows its ancestor 2^k levels up, so a chain of depth d takes log2(d) + 1 rounds instead
of d.  Nodes that a sweep never finishes lie in a cycle or below one.  Each round is cut off by a written table.

Ranges meet places by equality: a range is cut into aligned blocks of 1, 2, 4, ... up to 2^BLOCK_BITS places, no two of
the same range overlapping, and a place lies in one block of each width.  So every pair of ancestor and descendant meets
exactly once, nothing else is compared, and a block holds at most 2^BLOCK_BITS places however large its tree is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.operators.skew import hot_keys, join_unique, largest
from annalist.session import cut, cut_counted

#: Siblings of one parent that are numbered in one task; more are split by hash into chunks.
SIBLINGS_PER_CHUNK = 100_000
MAX_CHUNKS = 1024
#: Widest block that a range is cut into, as a power of two.
BLOCK_BITS = 12
#: Below so many open nodes no parent can be hot, so none is looked for.
LEAST = 10_000


def links(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct ``id`` -> ``parent``.

    The parent is ``superseded_by`` of the entity (of several rows the one with the smallest row_id that gives it),
    else the first derived entity of the event (the first by arrival and row_id) whose ``supersedes`` names the id.
    Null and empty ids and parents are no links; a link of an id to itself is kept.
    """
    e = entities.select(clean_id(F.col("id")).alias("id"), clean_id(F.col("superseded_by")).alias("parent"), F.struct(F.lit(0).alias("rank"), F.lit(None).cast("timestamp_ntz").alias("at"), "row_id").alias("o"))
    named = events.where(F.size("supersedes") > 0).select(F.explode("supersedes").alias("c"), F.get(F.col("derived_entities"), F.lit(0))["id"].alias("p"), "seen_at", "row_id")
    v = named.select(clean_id(F.col("c")).alias("id"), clean_id(F.col("p")).alias("parent"), F.struct(F.lit(1).alias("rank"), F.col("seen_at").alias("at"), "row_id").alias("o"))
    d = e.unionByName(v).where("id IS NOT NULL AND parent IS NOT NULL")
    return d.groupBy("id").agg(F.min_by("parent", "o").alias("parent"))


def _nodes(links_: DataFrame) -> DataFrame:
    """All ids with their parent (null for roots)."""
    tops = links_.select(F.col("parent").alias("id")).distinct().join(links_.select("id"), "id", "left_anti")
    return links_.select("id", "parent").unionByName(tops.withColumn("parent", F.lit(None).cast("string")))


def subtree_sizes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``parent``, ``size``) of all nodes in trees, and the ids in or below cycles.

    ``size`` counts the node itself.  In round k a node's size covers its descendants less than 2^k levels down; the
    sizes of those exactly 2^k levels down are added to it.  As long as a tree is unfinished every round finishes some
    node of it, so when a round finishes none, the rest are in or below cycles.
    """
    d = nodes.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size"))
    d, open_before = cut_counted(d, "sizes", "up IS NOT NULL")
    while open_before:
        below = d.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        jump = d.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        # Later on most nodes have one of few roots above them: those rows are not shuffled.
        old, hot = d, [] if open_before < LEAST else hot_keys(d.where("up IS NOT NULL"), "up")
        d = join_unique(d.join(below, "id", "left"), jump, "up", "left", hot=hot)
        d = d.select("id", "parent", F.col("up2").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        d, now = cut_counted(d, "sizes", "up IS NOT NULL", old)
        if now == open_before:
            break
        open_before = now
    return d.where("up IS NULL").select("id", "parent", "size"), d.where("up IS NOT NULL").select("id")


def sibling_offsets(sized: DataFrame) -> DataFrame:
    """Adds ``step``: the preorder distance of a node from its parent, 1 + the sizes of the siblings before it.

    Siblings are ordered by (hash chunk, id); a parent with very many children has its children numbered in chunks and
    the chunk totals summed over at most MAX_CHUNKS rows.
    """
    n = sized.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SIBLINGS_PER_CHUNK)
    split = n.select("parent", F.least(F.lit(MAX_CHUNKS), F.ceil(F.col("n") / SIBLINGS_PER_CHUNK)).cast("bigint").alias("split"))
    split = cut(split, "split")
    d = join_unique(sized, split, "parent", "left", hot=largest(split, "parent", "split", least=1)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("split", F.lit(1).cast("bigint"))))
    inner = Window.partitionBy("parent", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("parent", "chunk").agg(F.sum("size").alias("total"))
    outer = Window.partitionBy("parent").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.where("parent IS NOT NULL").withColumn("base", F.coalesce(F.sum("total").over(outer), F.lit(0)))
    # Siblings of one chunk are at most about SIBLINGS_PER_CHUNK rows, so this join has no hot key.
    placed = d.where("parent IS NOT NULL").withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(totals, ["parent", "chunk"])
    placed = placed.select("id", "parent", "size", (F.lit(1) + F.col("before") + F.col("base")).alias("step"))
    return placed.unionByName(sized.where("parent IS NULL").select("id", "parent", "size", F.lit(0).cast("bigint").alias("step")))


def nested_sets(links_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hierarchy of every node in a tree, and the ids in or below cycles.

    The first has ``id``, ``root_id``, ``depth``, ``lft``, ``rgt`` (preorder range below its root, from 0) and
    ``n_descendants``.
    """
    sized, stuck = subtree_sizes(_nodes(links_))
    d = sibling_offsets(sized)
    d = d.select("id", F.coalesce("parent", "id").alias("root_id"), F.col("parent").alias("up"), F.col("size"), F.col("step").alias("lft"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    d, left = cut_counted(d, "ranges", "up IS NOT NULL")
    while left:
        above = d.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"), F.col("lft").alias("lft2"), F.col("depth").alias("depth2"))
        open_ = d.where("up IS NOT NULL")
        moved = join_unique(open_, above, "up", hot=[] if left < LEAST else hot_keys(open_, "up"))
        moved = moved.select("id", F.col("root2").alias("root_id"), F.col("up2").alias("up"), "size", (F.col("lft") + F.col("lft2")).alias("lft"), (F.col("depth") + F.col("depth2")).alias("depth"))
        d, left = cut_counted(d.where("up IS NULL").unionByName(moved), "ranges", "up IS NOT NULL", d)
    full = d.select("id", "root_id", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"))
    return full, stuck


def _blocks(sets: DataFrame, keep: list) -> DataFrame:
    """``keep`` and the blocks (``root_id``, ``w``, ``b``) of the places below each node: lft + 1 .. rgt.

    Going up from width 1, an odd left border and an even right one close a block each; between the borders that are left
    at the widest width all blocks are taken.
    """
    lo, hi = F.col("lft") + 1, F.col("rgt") + 1
    parts = []
    for w in range(BLOCK_BITS):
        a = F.call_function("div", lo + F.lit((1 << w) - 1), F.lit(1 << w))
        end = F.call_function("div", hi, F.lit(1 << w))
        # Borders in blocks of this width, rounded inwards; what rounding left out was closed at smaller widths.
        parts.append(F.when((a < end) & (a % 2 == 1), F.struct(F.lit(w).alias("w"), a.alias("b"))))
        parts.append(F.when((a < end) & (end % 2 == 1) & ~((a % 2 == 1) & (a == end - 1)), F.struct(F.lit(w).alias("w"), (end - 1).alias("b"))))
    wide = F.lit(1 << BLOCK_BITS)
    first, last = F.call_function("div", lo + wide - 1, wide), F.call_function("div", hi, wide) - 1
    whole = F.when(first <= last, F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(BLOCK_BITS).alias("w"), b.alias("b"))))
    none = F.from_json(F.lit("[]"), "array<struct<w:int,b:bigint>>")
    all_ = F.concat(F.filter(F.array(*parts), lambda x: x.isNotNull()), F.coalesce(whole, none))
    return sets.where("rgt > lft").select(*keep, "root_id", F.inline(all_))


def _places(sets: DataFrame, keep: list) -> DataFrame:
    """``keep`` and the block of each width in which a node lies; roots lie below nothing."""
    at = F.array(*[F.struct(F.lit(w).alias("w"), F.call_function("div", F.col("lft"), F.lit(1 << w)).alias("b")) for w in range(BLOCK_BITS + 1)])
    return sets.where("lft > 0").select(*keep, "root_id", F.inline(at))


def descendants(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(``id``, ``descendant_id``) for the ids in ``of`` (all if None): places of the same root that their ranges enclose."""
    a = sets if of is None else sets.join(of.select("id").distinct(), "id", "left_semi")
    return _blocks(a, ["id"]).join(_places(sets, [F.col("id").alias("descendant_id")]), ["root_id", "w", "b"]).select("id", "descendant_id")


def ancestors(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(``id``, ``ancestor_id``, ``ancestor_depth``) for the ids in ``of`` (all if None): the ranges that enclose their place."""
    a = sets if of is None else sets.join(of.select("id").distinct(), "id", "left_semi")
    up = _blocks(sets, [F.col("id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth")])
    return _places(a, ["id"]).join(up, ["root_id", "w", "b"]).select("id", "ancestor_id", "ancestor_depth")


def paths(sets: DataFrame) -> DataFrame:
    """``id``, ``root_id``, ``depth`` and ``path`` (ids from the root on, an array): the ancestors in order, then the node."""
    up = ancestors(sets).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor_id"))).alias("up"))
    d = sets.where("depth > 0").select("id", "root_id", "depth").join(up, "id")
    d = d.select("id", "root_id", "depth", F.concat(F.transform("up", lambda x: x["ancestor_id"]), F.array("id")).alias("path"))
    return d.unionByName(sets.where("depth = 0").select("id", "root_id", "depth", F.array("id").alias("path")))


def found(entities: DataFrame, events: DataFrame) -> DataFrame:
    """p5_found: root, depth and path of each entity that is superseded by or supersedes another, or itself.

    Entities in or below a cycle get root '', depth -1 and path ''.  Empty tables give no rows.
    """
    full, stuck = nested_sets(cut(links(entities, events), "links"))
    good = paths(full).select("id", "root_id", "depth", F.array_join("path", ">").alias("path"))
    bad = stuck.select("id", F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit("").alias("path"))
    return good.unionByName(bad)
