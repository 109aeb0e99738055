"""Temperature of knowledge, tiers, and selection under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import TOKEN_MARGIN, estimate_tokens, slugify, token_runs
from annalist.functions.timestamps import with_instant
from annalist.operators.skew import join_unique
from annalist.session import cut

# Fixed values of the score.
WEIGHTS = {"recency": 0.4, "impact": 0.3, "domain": 0.2, "access": 0.1}
HALF_LIFE_DAYS = 90.0
HOT, WARM, COOLED = 0.55, 0.30, 0.3
RESOLVED = ("superseded", "achieved", "dropped")
MAP_TYPES = ("service", "external", "incident")
DROP_FACTS = ("extensions", "adapter")
FACT_KEEP = 2
CITES = 2
BUDGET = int(0.25 * 200_000)
INLINE_WIDTH, SAMPLES_KEEP, SAMPLE_WIDTH = 72, 3, 60
#: Token runs of the two lines above the topology.
TOPOLOGY_HEAD = 6
_FETCH = 10_000


def recency(instant_us: Column, now_us: int, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halves with every half life of age; nothing for what was never touched, never more than 1."""
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - instant_us) / F.lit(86_400_000_000))
    return F.when(instant_us.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def domain_weight(domains: Column, weights: dict[str, float]) -> Column:
    """Largest weight of the domains; 0.5 where no weights are configured."""
    if not weights:
        return F.lit(0.5)
    m = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(domains, lambda d: F.coalesce(F.element_at(m, d), F.lit(0.0)))), F.lit(0.0))


def tier_of(score: Column) -> Column:
    return F.when(score >= HOT, "hot").when(score >= WARM, "warm").otherwise("cold")


def scores(entities: DataFrame, now_us: int, domain_weights: dict[str, float] | None = None, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Adds ``score`` (six digits) and ``tier``.

    Resolved knowledge cools to a third; open goals and documents of high impact stay hot.  Unreadable stamps count as
    never touched.
    """
    d = with_instant(entities, "last_touched", out="touched_us")
    impact = F.when(F.col("impact") == "high", 1.0).when(F.col("impact") == "medium", 0.6).otherwise(0.3)
    s = WEIGHTS["recency"] * recency(F.col("touched_us"), now_us, half_life) + WEIGHTS["impact"] * impact + WEIGHTS["domain"] * domain_weight(F.coalesce("domains", F.array().cast("array<string>")), domain_weights or {})
    keeps = (F.col("type") == "goal") | ((F.col("type") == "doc") & (F.col("impact") == "high"))
    s = F.when(F.col("status").isin(*RESOLVED), s * COOLED).when(keeps, F.greatest(s, F.lit(HOT))).otherwise(s)
    return d.withColumn("score", F.round(s, 6)).drop("touched_us").withColumn("tier", tier_of(F.col("score")))


def domain_tiers(scored: DataFrame) -> DataFrame:
    """Entities, hot ones and the best score per domain label; those without a domain are ``general``."""
    d = scored.select("id", "score", "tier", F.explode(F.when(F.size("domains") > 0, F.col("domains")).otherwise(F.array(F.lit("general")))).alias("raw"))
    d = d.select("id", "score", "tier", F.coalesce(F.nullif(slugify(F.col("raw")), F.lit("")), F.lit("general")).alias("domain"))
    return d.groupBy("domain").agg(F.count(F.lit(1)).alias("n_entities"), F.sum((F.col("tier") == "hot").cast("bigint")).alias("n_hot"), F.max("score").alias("best"))


def is_map_entity(distilled: Column) -> Column:
    """Incidents and corpora always; services and externals unless only distillation knows them."""
    return F.startswith(F.col("id"), F.lit("corpus-")) | (F.col("type") == "incident") | (F.col("type").isin(*MAP_TYPES) & ~distilled)


def distilled_only(entities: DataFrame, sources: DataFrame, log: DataFrame) -> DataFrame:
    """Ids of entities with source events of which every one that the log holds is a distilled one.

    An entity none of whose source events is in the log counts as well.  ``sources``: ``id``, ``event_id``.
    """
    s = sources.join(log.select(F.col("id").alias("event_id"), "source"), "event_id", "left")
    return s.groupBy("id").agg(F.min(F.coalesce(F.col("source") == "study", F.lit(True))).alias("all_study")).where("all_study").select("id")


def blocks(scored: DataFrame) -> DataFrame:
    """Adds ``cost``: estimated tokens of an entity's line in the map."""
    high = F.when(F.col("impact") == "high", ", impact=high").otherwise("")
    line = F.concat(F.lit("- **"), "id", F.lit("** ("), "type", high, F.lit("): "), F.coalesce(F.nullif("description", F.lit("")), F.col("name")))
    return scored.withColumn("cost", estimate_tokens(line))


def fill(costed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Greedy choice in score order: what does not fit is skipped and later, smaller items may still enter.

    ``costed`` has id, type, score, cost.  Adds ``kept``.  Only items that still fit are fetched, in order and by the
    block; each block gives up at least its first item, and the items kept are bounded by the budget.
    """
    order = ["neg", "type", "id"]
    d = costed.withColumn("neg", -F.col("score"))
    room, after, kept = budget, None, []
    while room > 0:
        c = d.where(F.col("cost") <= room)
        if after is not None:
            c = c.where(F.struct(*order) > F.struct(*[F.lit(x) for x in after]))
        rows = c.orderBy(*order).select(*order, "cost").limit(_FETCH).collect()
        if not rows:
            break
        for r in rows:
            if r["cost"] <= room:
                room -= r["cost"]
                kept.append((r["id"],))
        after = tuple(rows[-1][k] for k in order)
    spark = costed.sparkSession
    # At most one id per token of the budget.
    chosen = spark.createDataFrame(kept, "id string").withColumn("kept", F.lit(True))
    return costed.join(F.broadcast(chosen), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def citations(entities: DataFrame) -> DataFrame:
    """The last two source events of each entity: ``id``, ``event_id``, ``nth``."""
    last = F.slice("source_events", F.greatest(F.lit(1), F.size("source_events") - CITES + 1), CITES)
    return entities.where(F.size("source_events") > 0).select("id", F.posexplode(last).alias("nth", "event_id"))


def topology(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between services and externals that are both among ``entities`` (one row per id)."""
    d = relations.where(" AND ".join(f"({c} LIKE 'svc-%' OR {c} LIKE 'ext-%')" for c in ("source", "target")))
    known = entities.where("id LIKE 'svc-%' OR id LIKE 'ext-%'").select("id")
    for end in ("source", "target"):
        d = join_unique(d, known.select(F.col("id").alias(end), F.lit(True).alias("known_")), end).where("known_").drop("known_")
    return d


def legend(entities: DataFrame, log: DataFrame, relations: DataFrame | None = None, chosen: bool = False) -> DataFrame:
    """Citations that are carried twice or more by entities and, where ``relations`` are given, by those that connect
    two services or externals among the entities.

    ``chosen`` says that the relations are the topology already.  Numbered by the smallest entity that carries them; those that only relations carry come after, by the smallest of
    these.
    """
    c = citations(entities).select("event_id", F.lit(False).alias("rel"), F.col("id").alias("first"))
    if relations is not None:
        c = c.unionByName((relations if chosen else topology(relations, entities)).select(F.col("provenance").alias("event_id"), F.lit(True).alias("rel"), F.concat_ws(" ", "source", "predicate", "target").alias("first")))
    n = c.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rel", "first")).alias("f")).where("n >= 2")
    n = n.join(log.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_id", "n", "f.*")
    # Numbered chunk by chunk of equal beginnings with carried totals, so that no task orders all citations.
    n = n.withColumn("part", F.substring("first", 1, 8))
    size = n.groupBy("rel", "part").agg(F.count(F.lit(1)).alias("k"))
    base = size.select("rel", "part", F.coalesce(F.sum("k").over(Window.orderBy("rel", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    r = F.row_number().over(Window.partitionBy("rel", "part").orderBy("first", "event_id"))
    return n.withColumn("r", r).join(base, ["rel", "part"]).select("event_id", "n", (F.col("r") + F.col("before")).alias("tag"))


def trimmed_facts(entities: DataFrame) -> DataFrame:
    """Facts of each entity with at most two per key, and how many more there are: ``id``, ``key``, ``nth``, ``fact``, ``more``."""
    f = entities.select("id", F.posexplode("key_facts").alias("pos", "fact")).where("fact IS NOT NULL")
    f = f.withColumn("key", F.lower(F.btrim(F.split("fact", ":", 2)[0]))).where(~F.col("key").isin(*DROP_FACTS))
    w = Window.partitionBy("id", "key")
    f = f.withColumn("nth", F.row_number().over(w.orderBy("pos")).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    return f.where(F.col("nth") <= FACT_KEEP).select("id", "key", "nth", "fact", F.greatest(F.col("n") - FACT_KEEP, F.lit(0)).alias("more"))


def citation() -> Column:
    """How an event of the log is cited: id, day and title."""
    return F.concat("id", F.lit(" ("), F.substring("ts", 1, 10), F.lit(") "), "title")


def _cited(entities: DataFrame, log: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Adds ``marks`` (tags of the legend) and ``cites`` (citations without a tag) of the last two events of each entity."""
    told = log.select(F.col("id").alias("event_id"), citation().alias("cite"))
    c = citations(entities).join(told, "event_id")
    c = c.join(tags.select("event_id", "tag"), "event_id", "left") if tags is not None else c.withColumn("tag", F.lit(None).cast("bigint"))
    # Two rows per entity at most.
    c = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "tag", "cite"))).alias("c"))
    marks = F.array_join(F.transform(F.filter("c", lambda x: x["tag"].isNotNull()), lambda x: F.concat(F.lit("[c"), x["tag"].cast("string"), F.lit("]"))), "")
    rest = F.transform(F.filter("c", lambda x: x["tag"].isNull()), lambda x: x["cite"])
    none = F.array().cast("array<string>")
    return entities.join(c.select("id", marks.alias("marks"), rest.alias("cites")), "id", "left").withColumns({"marks": F.coalesce("marks", F.lit("")), "cites": F.coalesce("cites", none)})


def trimmed_samples(fact: Column) -> Column:
    """A list of samples behind its key, cut to three of sixty characters."""
    key, rest = F.split_part(fact, F.lit(":"), F.lit(1)), F.substring(fact, F.locate(":", fact) + 1, F.length(fact))
    items = F.filter(F.transform(F.split(F.when(F.locate(":", fact) > 0, rest).otherwise(""), ";"), lambda x: F.substring(F.btrim(x), 1, SAMPLE_WIDTH)), lambda x: x != "")
    return F.concat(key, F.lit(": "), F.array_join(F.slice(items, 1, SAMPLES_KEEP), "; "))


def map_blocks(entities: DataFrame, log: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``id``, ``block``: an entity of the map with its facts (two per key, short ones on one line) and citations."""
    none = F.array().cast("array<string>")
    d = _cited(entities, log, tags).withColumn("f", F.filter(F.coalesce("key_facts", none), lambda x: x.isNotNull()))
    d = d.withColumn("f", F.transform("f", lambda x: F.struct(F.lower(F.btrim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), x.alias("x"))))
    d = d.withColumn("f", F.filter("f", lambda x: ~x["k"].isin(*DROP_FACTS))).withColumn("k", F.transform("f", lambda x: x["k"]))
    kept = F.filter("f", lambda x, i: F.size(F.filter(F.slice(F.col("k"), F.lit(1), i + 1), lambda k: k == x["k"])) <= FACT_KEEP)
    d = d.withColumn("kept", kept)
    short = lambda x: (x["k"] != "samples") & (F.length(x["x"]) <= INLINE_WIDTH)
    more = F.filter(F.transform(F.array_distinct("k"), lambda k: F.struct(k.alias("k"), (F.size(F.filter("k", lambda q: q == k)) - FACT_KEEP).alias("n"))), lambda x: x["n"] > 0)
    inline = F.concat(F.transform(F.filter("kept", short), lambda x: x["x"]), F.transform(more, lambda x: F.concat(x["k"], F.lit(": +"), x["n"].cast("string"), F.lit(" more"))))
    own = F.transform(F.filter("kept", lambda x: ~short(x)), lambda x: F.when(x["k"] == "samples", trimmed_samples(x["x"])).otherwise(x["x"]))
    head = F.concat(F.lit("- **"), "id", F.lit("** ("), "type", F.when(F.col("impact") == "high", ", impact=high").otherwise(""), F.lit(")"), "marks", F.lit(": "), F.coalesce(F.nullif("description", F.lit("")), F.col("name")))
    below = F.concat(F.when(F.col("summary") != "", F.array("summary")).otherwise(none), F.when(F.size(inline) > 0, F.array(F.array_join(inline, " | "))).otherwise(none), own, F.transform("cites", lambda x: F.concat(F.lit("cite: "), x)))
    return d.select("id", F.array_join(F.concat(F.array(head), F.transform(below, lambda x: F.concat(F.lit("  - "), x))), "\n").alias("block"))


def entity_blocks(entities: DataFrame, log: DataFrame) -> DataFrame:
    """``id``, ``block``: an entity of the warm tier with its first three facts and last two citations."""
    none = F.array().cast("array<string>")
    d = _cited(entities, log, None)
    head = F.concat(F.lit("- **"), "id", F.lit("** ("), "type", F.lit(", impact="), "impact", F.lit("): "), F.coalesce(F.nullif("description", F.lit("")), F.col("name")))
    below = F.concat(F.when(F.col("summary") != "", F.array("summary")).otherwise(none), F.filter(F.slice(F.coalesce("key_facts", none), 1, 3), lambda x: x.isNotNull()), F.transform("cites", lambda x: F.concat(F.lit("cite: "), x)))
    return d.select("id", F.array_join(F.concat(F.array(head), F.transform(below, lambda x: F.concat(F.lit("  - "), x))), "\n").alias("block"))


def relation_rows(relations: DataFrame, log: DataFrame, tags: DataFrame) -> DataFrame:
    """``source``, ``predicate``, ``target``, ``row``: a relation of the topology with its tag or its own citation."""
    told = log.select(F.col("id").alias("provenance"), citation().alias("cite")).join(tags.select(F.col("event_id").alias("provenance"), "tag"), "provenance", "left")
    d = relations.join(told, "provenance", "left")
    mark = F.when(F.col("tag").isNotNull(), F.concat(F.lit("[c"), F.col("tag").cast("string"), F.lit("]"))).when(F.col("cite").isNotNull(), F.concat(F.lit("\n  - cite: "), "cite")).otherwise("")
    return d.select("source", "predicate", "target", F.concat(F.lit("- **"), "source", F.lit("** "), "predicate", F.lit(" **"), "target", F.lit("**"), mark).alias("row"))


def hot_map(scored: DataFrame, log: DataFrame, relations: DataFrame, distilled: DataFrame, budget: int = BUDGET, head: str = "") -> DataFrame:
    """The map under a token budget: ``section``, ``key``, ``text``, ``kept``.

    The legend of repeated citations (section 0) and open goals (1) always stand in it and count first.  Entities of the
    map (2) enter in score order as far as they fit; those that do not are demoted.  The topology between services and
    externals of the map (3) enters as a whole or not at all.  ``distilled`` has the ids only distillation knows.
    """
    goals = scored.where("type = 'goal' AND status = 'active'")
    d = scored.join(distilled.select("id").distinct().withColumn("d", F.lit(True)), "id", "left").withColumn("d", F.coalesce("d", F.lit(False)))
    mapped = cut(d.where(is_map_entity(F.col("d"))).drop("d"), "mapped")
    both = goals.unionByName(mapped)
    topo = topology(relations, mapped)
    tags = cut(legend(both, log, topo, True), "tags")
    cited = tags.join(log.select(F.col("id").alias("event_id"), citation().alias("cite")), "event_id").select(F.lit(0).alias("section"), "event_id", F.concat(F.lit("- [c"), F.col("tag").cast("string"), F.lit("] "), "cite").alias("text")).withColumnRenamed("event_id", "key")
    always = cut(cited.unionByName(map_blocks(goals, log, tags).select(F.lit(1).alias("section"), F.col("id").alias("key"), F.col("block").alias("text"))), "always")
    rows = cut(relation_rows(topo, log, tags).select(F.lit(3).alias("section"), F.concat_ws(" ", "source", "predicate", "target").alias("key"), F.col("row").alias("text")), "topology")
    runs = lambda t: t.agg(F.coalesce(F.sum(token_runs(F.col("text"))), F.lit(0))).first()[0]
    margin = lambda n: max(1, int(n * TOKEN_MARGIN))
    first = margin(runs(always.unionByName(log.sparkSession.createDataFrame([(0, "", head)], "section int, key string, text string"))))
    costed = mapped.join(map_blocks(mapped, log, tags), "id").select("id", "type", "score", "block", estimate_tokens(F.col("block")).alias("cost"))
    filled = cut(fill(costed, budget - first), "filled")
    used = first + (filled.where("kept").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    n = runs(rows)
    whole = n > 0 and used + margin(n + TOPOLOGY_HEAD) <= budget
    out = filled.select(F.lit(2).alias("section"), F.col("id").alias("key"), F.col("block").alias("text"), "kept")
    return always.withColumn("kept", F.lit(True)).unionByName(out).unionByName(rows.withColumn("kept", F.lit(whole)))


def index_lines(scored: DataFrame, demoted: DataFrame | None = None) -> DataFrame:
    """One line per entity: tier (warm if demoted), id, type, mark of superseded ones, description or name."""
    d = scored
    if demoted is not None:
        d = d.join(demoted.select("id").withColumn("down", F.lit(True)), "id", "left").withColumn("tier", F.when(F.col("down"), "warm").otherwise(F.col("tier"))).drop("down")
    mark = F.when(F.col("status") == "superseded", " (superseded)").otherwise("")
    return d.select("id", "type", "score", F.concat(F.lit("- ["), "tier", F.lit("] "), "id", F.lit(" ("), "type", F.lit(")"), mark, F.lit(": "), F.coalesce(F.nullif("description", F.lit("")), F.col("name"))).alias("line"))
