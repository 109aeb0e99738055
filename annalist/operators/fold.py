"""The ordered fold of the event log into entities, relations and notes.

The log's total order is the raw stamp as text, then the event id; inside an event its derived entities come first,
then its relations, its references, and what it supersedes.  Each attribute of an entity is an aggregate over the ops
that bear on it, so the fold needs no per-entity loop and no array of all events of an entity: first-wins is ``min_by``,
last-wins ``max_by``, provenance and facts are tables with one row per item.  The one true state machine, the status, is
closed over its last op and, for the superseder, over the op before each (an ordered scan in month chunks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.operators.chunked import lag_across
from annalist.operators.skew import hot_keys, join_unique

# What else makes an end of a relation an id.
END_PREFIX = r"^(svc-|feat-|ext-|env-|team-|secret-|goal-|adr-|inc-|evt-|doc-|principle-|module-|person-|PR-|pr-|task-)"
IMPACT_RANK = {"low": 0, "medium": 1, "high": 2}
RESOLVED = ("achieved", "dropped")


@dataclass
class Graph:
    """The folded graph.

    ``entities``: id, type, name, description, summary, status, superseded_by, impact, last_touched.
    ``facts``: id, fact, ts, event_id of its first mention.  ``aliases``, ``domains``: id with alias or domain.
    ``sources``: id, event_id, ts.  ``relations``: source, predicate, target, ts, provenance.
    ``notes``: event_id, ts, target, outcome (superseded, disputed, unknown, again), primary.
    """

    entities: DataFrame
    facts: DataFrame
    aliases: DataFrame
    domains: DataFrame
    sources: DataFrame
    relations: DataFrame
    notes: DataFrame


def impact_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def _canon(d: DataFrame, col: str, aliases: DataFrame | None) -> DataFrame:
    if aliases is None:
        return d
    m = aliases.select(F.col("alias").alias(col), F.col("canonical").alias("canon__"))
    return d.join(m, col, "left").withColumn(col, F.coalesce("canon__", col)).drop("canon__")


def replay(log: DataFrame, as_of: str = "", aliases: DataFrame | None = None) -> Graph:
    """Fold the log (see ``store.event_log``), up to a date if one is given: events whose stamp begins after it, as
    text, are left out, so a partial date leaves out all of its period.

    ``aliases`` (``alias``, ``canonical``) folds duplicate entities; targets of ``supersedes`` are not folded.  An
    empty log gives empty tables.
    """
    if as_of:
        log = log.where(F.substring("ts", 1, 10) <= as_of)
    base = ["ts", F.col("id").alias("event_id"), F.col("type").alias("event_type"), "impact", "trust", F.col("domains").alias("event_domains")]
    asserted = log.select(*base, F.posexplode("derived_entities").alias("pos", "e")).select(
        "*", clean_id(F.col("e.id")).alias("id"), clean_id(F.col("e.id")).alias("own_id"), F.coalesce("e.type", F.lit("")).alias("type"), F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.profile.summary", F.lit("")).alias("summary"), F.coalesce("e.profile.key_facts", F.array().cast("array<string>")).alias("key_facts"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("e.domains", F.array().cast("array<string>")).alias("domains"),
        F.coalesce(F.nullif("e.status", F.lit("")), F.lit("active")).alias("status"), F.coalesce(clean_id(F.col("e.superseded_by")), F.lit("")).alias("superseded_by"),
    ).where("id IS NOT NULL").drop("e")
    asserted = _canon(asserted, "id", aliases)
    at = F.struct("ts", "event_id", "pos")
    given = lambda c: F.max_by(c, F.when(F.col(c) != "", at))
    core = asserted.groupBy("id").agg(F.min(at).alias("first"), F.min_by("type", at).alias("type"), F.min_by("name", at).alias("name"), given("description").alias("description"), given("summary").alias("summary"), F.count(F.lit(1)).alias("n"))
    born = core.select("id", F.col("first.ts").alias("born_ts"), F.col("first.event_id").alias("born_id"))

    # Hot ids are looked for once, over all that is joined below.
    named_ids = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (F.transform("derived_relations", lambda r: clean_id(r["source"])), F.transform("derived_relations", lambda r: clean_id(r["target"])), F.transform("refs", lambda r: clean_id(r["id"])), F.transform("supersedes", clean_id))])
    hot = hot_keys(log.select(F.explode(named_ids).alias("id")), "id")

    def known(d: DataFrame, col: str, out: str) -> DataFrame:
        """Whether the entity named by ``col`` has been derived by this event or an earlier one."""
        b = born.withColumnRenamed("id", col)
        d = join_unique(d, b, col, "left", hot=hot)
        return d.withColumn(out, F.coalesce((F.col("born_ts") < F.col("ts")) | ((F.col("born_ts") == F.col("ts")) & (F.col("born_id") <= F.col("event_id"))), F.lit(False))).drop("born_ts", "born_id")

    r = log.select(*base, F.posexplode("derived_relations").alias("pos", "r")).select(*base[:1], "event_id", "impact", "event_domains", "pos", clean_id(F.col("r.source")).alias("source"), F.coalesce("r.predicate", F.lit("")).alias("predicate"), clean_id(F.col("r.target")).alias("target"), F.nullif("r.ts", F.lit("")).alias("own_ts"), clean_id(F.col("r.provenance")).alias("own_prov"))
    r = _canon(_canon(r.where("source IS NOT NULL AND target IS NOT NULL"), "source", aliases), "target", aliases).where("source <> target")
    r = known(known(r, "source", "s_known"), "target", "t_known")
    loose = lambda c: F.col(c).rlike(END_PREFIX) | F.contains(F.col(c), F.lit("/"))
    r = r.withColumn("s_ok", F.col("s_known") | loose("source")).withColumn("t_ok", F.col("t_known") | loose("target"))
    admitted = r.where("s_ok AND t_ok")
    demoted = r.where("NOT (s_ok AND t_ok)")
    holder = F.when(F.col("s_ok"), F.col("source")).otherwise(F.col("target"))
    held = F.when(F.col("s_ok"), F.col("s_known")).otherwise(F.col("t_known"))
    fact = F.when(F.col("s_ok"), F.concat_ws(": ", "predicate", "target")).otherwise(F.concat_ws(" ", "source", "predicate", F.lit("this")))
    told = demoted.where(held).select(holder.alias("id"), fact.alias("fact"), F.struct("ts", "event_id", F.lit(1).alias("phase"), "pos", F.lit(0).alias("i")).alias("o"))
    listed = asserted.select("id", "ts", "event_id", "pos", F.posexplode("key_facts").alias("i", "fact")).where("fact IS NOT NULL").select("id", "fact", F.struct("ts", "event_id", F.lit(0).alias("phase"), "pos", "i").alias("o"))
    facts = listed.unionByName(told).groupBy("id", "fact").agg(F.min("o").alias("o")).select("id", "fact", F.col("o.ts").alias("ts"), F.col("o.event_id").alias("event_id"))

    ends = admitted.select("ts", "event_id", "impact", "event_domains", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("s_known").alias("k")), F.struct(F.col("target").alias("id"), F.col("t_known").alias("k")))).alias("x")).where("x.k").select("x.id", "ts", "event_id", "impact", "event_domains")
    refs = log.select(*base, F.explode("refs").alias("ref")).where(F.lower("ref.kind") == "entity").select("ts", "event_id", "impact", "event_domains", clean_id(F.col("ref.id")).alias("id")).where("id IS NOT NULL")
    refs = known(_canon(refs, "id", aliases), "id", "k").where("k").select("id", "ts", "event_id", "impact", "event_domains")
    touched = asserted.select("id", "ts", "event_id", "impact", "event_domains").unionByName(ends).unionByName(refs)
    sources = touched.groupBy("id", "event_id").agg(F.min("ts").alias("ts"))
    heat = touched.groupBy("id").agg(F.max("ts").alias("last_touched"), F.max(impact_rank(F.col("impact"))).alias("rank"))
    domains = asserted.select("id", F.explode("domains").alias("domain")).unionByName(touched.select("id", F.explode("event_domains").alias("domain"))).where("domain IS NOT NULL").distinct()

    # Aliases: those asserted, names that differ from the first, and the ids and names that were folded away.
    named = asserted.join(core.select("id", F.col("name").alias("first_name"), "first"), "id")
    extra = F.when((F.col("name") != F.col("first_name")) & (F.struct("ts", "event_id", "pos") > F.col("first")) & (F.col("name") != ""), F.array("name")).otherwise(F.array().cast("array<string>"))
    folded = F.when(F.col("own_id") != F.col("id"), F.array("own_id", "name")).otherwise(F.array().cast("array<string>"))
    alias = named.select("id", F.explode(F.concat("aliases", extra, folded)).alias("alias")).where("alias IS NOT NULL").distinct()

    # Supersessions: unknown target, distrusted, or done.
    primary = F.coalesce(clean_id(F.get(F.col("derived_entities"), F.lit(0))["id"]), F.col("id"))
    sup = log.select(*base, primary.alias("primary"), F.posexplode("supersedes").alias("pos", "target")).withColumn("target", clean_id(F.col("target"))).where("target IS NOT NULL")
    sup = known(sup, "target", "k").withColumn("outcome", F.when(~F.col("k"), "unknown").when(F.col("trust") == "low", "disputed").otherwise("done"))

    # Status: every op that sets it, in order; phase 0 is an assertion, phase 1 a supersession.
    sets = asserted.where("status <> 'active'").select("id", "ts", "event_id", F.lit(0).alias("phase"), "pos", "status", F.col("superseded_by").alias("by"), F.lit("").alias("primary"))
    sets = sets.unionByName(sup.where("outcome = 'done'").select(F.col("target").alias("id"), "ts", "event_id", F.lit(1).alias("phase"), "pos", F.lit("superseded").alias("status"), F.lit("").alias("by"), "primary"))
    sets = sets.withColumn("chunk", F.substring("ts", 1, 7))
    sets = lag_across(sets, "id", ["ts", "event_id", "phase", "pos"], "status", "before")
    effective = (F.col("phase") == 1) & F.coalesce(F.col("before") != "superseded", F.lit(True))
    sets = sets.withColumn("effective", effective).withColumn("gives", F.when(effective, F.col("primary")).when((F.col("phase") == 0) & (F.col("by") != ""), F.col("by")))
    o = F.struct("ts", "event_id", "phase", "pos")
    last = sets.groupBy("id").agg(F.max_by("status", o).alias("status"), F.max(o).alias("set_at"), F.max_by("gives", F.when(F.col("gives").isNotNull(), o)).alias("superseded_by"))
    plans = asserted.where("event_type = 'plan' AND status = 'active'").groupBy("id").agg(F.max(F.struct("ts", "event_id", F.lit(0).alias("phase"), "pos")).alias("plan_at"))
    state = last.join(plans, "id", "left").select("id", F.when(F.col("status").isin(*RESOLVED) & (F.col("plan_at") > F.col("set_at")), "active").otherwise(F.col("status")).alias("status"), "superseded_by")

    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rank = F.when(F.col("rank") == 2, "high").when(F.col("rank") == 1, "medium").otherwise("low")
    entities = core.join(heat, "id", "left").join(state, "id", "left").select("id", "type", "name", blank("description"), blank("summary"), F.coalesce("status", F.lit("active")).alias("status"), blank("superseded_by"), rank.alias("impact"), blank("last_touched"))

    done = sets.where("phase = 1").select(F.col("id").alias("target"), "event_id", "pos", "effective")
    notes = sup.join(done, ["target", "event_id", "pos"], "left").select("event_id", "ts", "target", F.when(F.col("outcome") != "done", F.col("outcome")).when(F.col("effective"), "superseded").otherwise("again").alias("outcome"), "primary")
    born_edges = admitted.select("source", "predicate", "target", F.struct("ts", "event_id", F.lit(0).alias("phase"), "pos").alias("o"), F.coalesce("own_ts", "ts").alias("r_ts"), F.coalesce("own_prov", "event_id").alias("prov"))
    made = sup.join(done.where("effective"), ["target", "event_id", "pos"], "left_semi").select(F.col("primary").alias("source"), F.lit("supersedes").alias("predicate"), "target", F.struct("ts", "event_id", F.lit(1).alias("phase"), "pos").alias("o"), F.col("ts").alias("r_ts"), F.col("event_id").alias("prov"))
    relations = born_edges.unionByName(made).groupBy("source", "predicate", "target").agg(F.min_by(F.struct("r_ts", "prov"), "o").alias("x")).select("source", "predicate", "target", F.col("x.r_ts").alias("ts"), F.col("x.prov").alias("provenance"))
    return Graph(entities, facts, alias, domains, sources, relations, notes)


def with_profiles(graph: Graph, profiles: DataFrame) -> Graph:
    """Overlay of summaries and further facts (``id``, ``summary``, ``key_facts``); unknown ids are ignored."""
    p = profiles.join(graph.entities.select("id"), "id", "left_semi")
    e = graph.entities.join(p.select("id", F.col("summary").alias("p")), "id", "left").withColumn("summary", F.coalesce(F.nullif("p", F.lit("")), F.col("summary"))).drop("p")
    f = p.select("id", F.explode("key_facts").alias("fact"), F.lit("9999").alias("ts"), F.lit("").alias("event_id"))
    return Graph(e, graph.facts.unionByName(f.join(graph.facts.select("id", "fact"), ["id", "fact"], "left_anti").dropDuplicates(["id", "fact"])), graph.aliases, graph.domains, graph.sources, graph.relations, graph.notes)


def questions(notes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Open questions, one per text, not asked before: ``text``, ``ts`` of the first event that raised it."""
    unknown = F.format_string("question: %s supersedes unknown entity '%s'", "event_id", "target")
    disputed = F.format_string("disputed: %s tried to supersede '%s'", "event_id", "target")
    d = notes.where("outcome IN ('unknown', 'disputed')").select(F.when(F.col("outcome") == "unknown", unknown).otherwise(disputed).alias("text"), "ts")
    d = d.groupBy("text").agg(F.min("ts").alias("ts"))
    return d.join(asked.select("text"), "text", "left_anti") if asked is not None else d


def name_collisions(entities: DataFrame) -> DataFrame:
    """Names claimed by more than one entity that is not superseded: each later claimant beside the first (smallest id).

    ``entities`` has id, name, aliases, status.  One row per claimant, not per pair.
    """
    n = entities.where("status <> 'superseded'").select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    n = n.where("name IS NOT NULL AND name <> ''").select("id", F.lower("name").alias("name")).distinct()
    owner = n.groupBy("name").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "owner")
    return n.join(owner, "name").where("id <> owner").select("name", "owner", F.col("id").alias("claimant"))
