"""Traversal of the relation graph: hubs, bounded neighbourhoods, alias roots, temporal closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.session import cut, cut_counted

# From which degree on a node is a hub.
HUB_FACTOR, HUB_FLOOR = 20, 25
TEMPORAL = ("reverts", "supersedes", "superseded_by", "caused_by")
NODE_REF_KINDS = ("commit", "pr", "adr", "entity", "event", "file", "doc")


def degrees(relations: DataFrame) -> DataFrame:
    """``id``, ``degree``: ends of relations at each node; a self-loop counts twice."""
    return relations.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hub_limit(relations: DataFrame) -> int:
    """Hubs have more ends than this: 20 times the upper median degree, at least 25.

    The median is read off the histogram of degrees, which has few rows whatever the size of the graph.
    """
    h = degrees(relations).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree")
    h = h.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    median = h.where("upto > total div 2").agg(F.min("degree")).first()[0]
    return max(HUB_FACTOR * (median or 0), HUB_FLOOR)


def hubs(relations: DataFrame) -> DataFrame:
    return degrees(relations).where(F.col("degree") > hub_limit(relations)).select("id", "degree")


def subgraph(relations: DataFrame, centers: DataFrame, hops: int = 2, through_hubs: bool = False) -> DataFrame:
    """Relations within ``hops`` of the ids in ``centers``.

    Centers always expand; a hub may be the end of a relation but is not walked through.  ``relations`` has one row per
    triple.  Each hop is one semi-join per direction with the frontier, cut off by a written table.
    """
    stop = None if through_hubs else cut(hubs(relations).select("id"), "hubs")
    frontier = nodes = cut(centers.select("id").distinct(), "frontier")
    picked = None
    for hop in range(hops):
        out = relations.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi").select(*relations.columns)
        back = relations.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi").select(*relations.columns)
        step = out.unionByName(back)
        picked = step if picked is None else picked.unionByName(step)
        picked = cut(picked.dropDuplicates(["source", "predicate", "target"]), "picked")
        if hop + 1 == hops:
            break
        reached = picked.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes, "id", "left_anti")
        if stop is not None:
            reached = reached.join(stop, "id", "left_anti")
        frontier = cut(reached, "frontier")
        nodes = nodes.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return picked


def held_back(relations: DataFrame, centers: DataFrame, hops: int = 2) -> DataFrame:
    """One row: relations shown, and further ones that only hubs lead to."""
    near = subgraph(relations, centers, hops).select("source", "predicate", "target")
    far = subgraph(relations, centers, hops, through_hubs=True).select("source", "predicate", "target")
    both = near.withColumn("held", F.lit(0).cast("bigint")).unionByName(far.join(near, ["source", "predicate", "target"], "left_anti").withColumn("held", F.lit(1).cast("bigint")))
    return both.agg(F.count_if(F.col("held") == 0).alias("shown"), F.count_if(F.col("held") == 1).alias("held"))


def profile_candidates(relations: DataFrame, entities: DataFrame, sources: DataFrame, top: int = 12, least: int = 3) -> DataFrame:
    """The best connected entities by degree + events, with at least ``least`` events, secrets left out."""
    ev = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n_events"))
    d = entities.where("type <> 'secret-ref'").select("id", "type").join(ev, "id").where(F.col("n_events") >= least).join(degrees(relations), "id", "left")
    d = d.withColumn("weight", F.coalesce("degree", F.lit(0)) + F.col("n_events"))
    return d.select("id", "type", "n_events", F.coalesce("degree", F.lit(0)).alias("degree"), "weight").orderBy(F.desc("weight"), "id").limit(top)


def alias_roots(aliases: DataFrame) -> DataFrame:
    """``alias`` -> the root of its chain (``alias``, ``canonical``, one target per alias).

    Aliases that form a cycle have no root and are left out; those that lead into one get the member they reach first.
    """
    d, total = cut_counted(aliases.select(F.col("alias").alias("id"), F.col("canonical").alias("up")), "alias")
    k = 0
    far = d
    while (1 << k) <= total:
        far, left = cut_counted(far.join(far.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")), "far")
        k += 1
        if not left:
            break
    # Whoever can still be reached after more steps than there are aliases lies in a cycle.
    cycle = far.select(F.col("up").alias("id")).distinct()
    d = cut(d.join(cycle, "id", "left_anti"), "alias")
    while True:
        up = d.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        moved, left = cut_counted(d.join(up, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("open")), "alias", "open")
        d = moved.select("id", "up")
        if not left:
            break
    return d.select(F.col("id").alias("alias"), F.col("up").alias("canonical"))


def touch_ids(log: DataFrame) -> DataFrame:
    """``event_id``, ``node``: what puts an event into a topic: itself, what it refers to (but urls), the ends of its
    temporal edges, and what it supersedes."""
    refs = F.transform(F.filter(F.coalesce("refs", F.from_json(F.lit("[]"), "array<struct<kind:string,id:string>>")), lambda r: r["kind"].isin(*NODE_REF_KINDS)), lambda r: clean_id(r["id"]))
    rels = F.filter("derived_relations", lambda r: r["predicate"].isin(*TEMPORAL))
    none = F.array().cast("array<string>")
    nodes = F.concat(F.array("id"), refs, F.coalesce(F.transform(rels, lambda r: clean_id(r["source"])), none), F.coalesce(F.transform(rels, lambda r: clean_id(r["target"])), none), F.coalesce(F.transform("supersedes", clean_id), none))
    return log.select(F.col("id").alias("event_id"), F.explode(F.array_distinct(nodes)).alias("node")).where("node IS NOT NULL")


def temporal_events(log: DataFrame, relations: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Ids of the events of a topic: those that touch its nodes, grown over references and temporal edges.

    ``seeds`` (``id``) are the matched entities, their events and the events matched by title.  There are max(hops, 1) + 1
    rounds.  A round goes through the log in order, by raw stamp and id: an event that touches the topic joins it, and
    what it refers to counts for the events after it in the same round, for those before it from the next round on.  Then
    temporal edges lead one step further.  Instead of event by event a round runs in waves: a wave takes all events that
    lie behind the earliest event which brought in one of their nodes, until a wave takes none.
    """
    at = F.struct("ts", "id")
    touch = cut(touch_ids(log).join(log.select(F.col("id").alias("event_id"), at.alias("pos")), "event_id"), "touch")
    refs = log.select("id", F.explode(F.filter("refs", lambda r: r["kind"].isin(*NODE_REF_KINDS))).alias("r")).select(F.col("id").alias("event_id"), clean_id(F.col("r.id")).alias("node")).where("node IS NOT NULL")
    brings = cut(refs.unionByName(log.select(F.col("id").alias("event_id"), F.col("id").alias("node"))).distinct(), "brings")
    moving = relations.where(F.col("predicate").isin(*TEMPORAL)).select("source", "target")
    edges = cut(moving.unionByName(moving.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "edges")
    nodes, size = cut_counted(seeds.select(F.col("id").alias("node")).distinct(), "nodes")
    for _ in range(max(hops, 1) + 1):
        taken, wave_size = cut_counted(touch.join(nodes, "node", "left_semi").select("event_id", "pos").distinct(), "wave")
        wave = taken
        while wave_size:
            # The earliest event of the wave that brought a node in; nodes of the topic were there before.
            new = brings.join(wave, "event_id").groupBy("node").agg(F.min("pos").alias("since")).join(nodes, "node", "left_anti")
            more = touch.join(new, "node").where("pos > since").select("event_id", "pos").distinct().join(taken.select("event_id"), "event_id", "left_anti")
            wave, wave_size = cut_counted(more, "wave")
            taken = taken.unionByName(wave)
        grown = cut(nodes.unionByName(brings.join(taken.select("event_id"), "event_id", "left_semi").select("node")).distinct(), "grown")
        along = edges.join(grown.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"))
        nodes, now = cut_counted(grown.unionByName(along).distinct(), "nodes")
        if now == size:
            break
        size = now
    return touch.select(F.col("event_id").alias("id")).distinct().join(nodes.withColumnRenamed("node", "id"), "id", "left_semi")
