"""The history of a topic: its events in order, what each did, and the state that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.functions.text import clip, tokens
from annalist.operators import fold, graph, search
from annalist.session import cut

# Actions that change a state; all others are context.
TRANSITIONS = ("added", "status", "SUPERSEDED", "REVERTED", "supersedes", "caused_by")
MAX_CONTEXT = 4
NO_REASON = 20
BOILERPLATE = r"(?i)^(?:(?:Reverts|This reverts commit)\s+[0-9a-f]{7,40}[,.]?\s*)+"


def _edges() -> Column:
    """Relations of an event as (predicate, source, target), never null."""
    none = F.from_json(F.lit("[]"), "array<struct<predicate:string,source:string,target:string>>")
    e = F.transform("derived_relations", lambda r: F.struct(r["predicate"].alias("predicate"), F.coalesce(clean_id(r["source"]), F.lit("")).alias("source"), F.coalesce(clean_id(r["target"]), F.lit("")).alias("target")))
    return F.coalesce(e, none)


def citation() -> Column:
    """The first commit an event refers to, else its first pull request, else the event."""
    of = lambda kind: F.get(F.filter("refs", lambda r: r["kind"] == kind), F.lit(0))["id"]
    return F.coalesce(of("commit"), of("pr"), F.col("id"))


def undone() -> Column:
    """What an event reverts: '' if it reverts something it does not name, null if it reverts nothing."""
    return F.get(F.filter("edges", lambda e: e["predicate"] == "reverts"), F.lit(0))["target"]


def reason_recorded() -> Column:
    """Whether an event says why, beyond its own title and the boilerplate of a revert."""
    text = F.regexp_replace(F.btrim(F.concat_ws("\n", "summary", "body")), BOILERPLATE, "")
    own = tokens(F.col("title"))
    kept = F.filter(F.split(F.btrim(text), r"\s+"), lambda w: F.size(F.array_except(tokens(w), own)) > 0)
    return F.length(F.array_join(kept, " ")) >= NO_REASON


def reverted_what() -> Column:
    return F.btrim(F.regexp_extract("title", r"(?i)\breverted\s+(.+)$", 1))


def status_note() -> Column:
    """'entity = status' of an event that observes a status, null for others: a ``status=`` fact before a plain status."""
    of = F.transform("derived_entities", lambda e: F.struct(clean_id(e["id"]).alias("id"), F.regexp_extract(F.coalesce(F.get(F.filter(e["profile"]["key_facts"], lambda f: f.startswith("status=")), F.lit(0)), F.lit("")), r"^status=(.*?)(?: as of .*)?$", 1).alias("fact"), F.coalesce(e["status"], F.lit("")).alias("status")))
    hit = F.get(F.filter(of, lambda x: (x["fact"] != "") | (x["status"] != "")), F.lit(0))
    return F.when(hit.isNotNull(), F.concat(hit["id"], F.lit(" = "), F.when(hit["fact"] != "", hit["fact"]).otherwise(hit["status"])))


def sequence(log: DataFrame, relations: DataFrame, matched: list[str], titled: list[str], own_events: DataFrame, hops: int = 2) -> DataFrame:
    """The events of a topic (see ``graph.temporal_events``), from matched entities, their events and matched titles."""
    spark = log.sparkSession
    # A handful of ids: bounded by the limits of matching.
    seeds = spark.createDataFrame([(x,) for x in [*matched, *titled]], "id string").unionByName(own_events.select("id"))
    ids = graph.temporal_events(log, relations, seeds, hops)
    return log.join(ids.unionByName(spark.createDataFrame([(x,) for x in titled], "id string")).distinct(), "id", "left_semi")


def transitions(seq: DataFrame, matched: list[str], aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity ``eid`` -> event ``created`` that first derived it in the topic, event ``id`` -> ``eid``, ``old``, ``new``).

    The status after an event is folded as of that event; the first entity that an event moves counts.
    """
    g = fold.replay(seq, aliases=aliases)
    d = seq.select("id", "ts", F.col("type").alias("event_type"), "trust", "supersedes", F.posexplode_outer("derived_entities").alias("pos", "e"))
    created = d.select(clean_id(F.col("e.id")).alias("eid"), "ts", "id").where("eid IS NOT NULL").groupBy("eid").agg(F.min(F.struct("ts", "id")).alias("c")).select("eid", F.col("c.id").alias("created"), F.col("c").alias("born"))
    said = d.select(clean_id(F.col("e.id")).alias("eid"), "ts", "id", F.lit(0).alias("phase"), F.coalesce(F.nullif("e.status", F.lit("")), F.lit("active")).alias("status"), (F.col("event_type") == "plan").alias("plan"), "pos")
    done = g.notes.where("outcome IN ('superseded', 'again')").select(F.col("target").alias("eid"), "ts", F.col("event_id").alias("id"), F.lit(1).alias("phase"), F.lit("superseded").alias("status"), F.lit(False).alias("plan"), F.lit(0).alias("pos"))
    ops = said.unionByName(done).where(F.col("eid").isin(matched)).join(created, "eid")
    first = (F.struct("ts", "id") == F.col("born")) & (F.col("phase") == 0)
    # Only what can move a status is put in order; mere mentions, the bulk of a busy entity, are not.
    ops = ops.where((F.col("status") != "active") | F.col("plan") | first)
    w = Window.partitionBy("eid").orderBy("ts", "id", "phase", "pos")
    set_ = F.when((F.col("status") != "active") | first, F.col("status"))
    ops = ops.withColumn("before", F.last(set_, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opened = (F.col("status") == "active") & F.col("plan") & F.col("before").isin("achieved", "dropped")
    ops = ops.withColumn("step", F.when(opened, "active").otherwise(set_)).withColumn("old", F.last("step", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    moved = ops.where("step IS NOT NULL AND old IS NOT NULL AND step <> old")
    per = moved.groupBy("id", "eid").agg(F.min_by("old", F.struct("phase", "pos")).alias("old"), F.max_by("step", F.struct("phase", "pos")).alias("new")).where("old <> new")
    return created.select("eid", "created"), per.groupBy("id").agg(F.min(F.struct("eid", "old", "new")).alias("m")).select("id", "m.eid", "m.old", "m.new")


def rows(seq: DataFrame, matched: list[str], created: DataFrame, changed: DataFrame) -> DataFrame:
    """One row per event: ``ts``, ``id``, ``action``, ``detail``, ``citation``, ``no_reason``; rules in order, the first holds."""
    tracked = F.array(*[F.lit(m) for m in matched]).cast("array<string>")
    d = seq.withColumn("edges", _edges()).withColumn("citation", citation()).withColumn("undone", undone()).withColumn("primary", F.coalesce(clean_id(F.get(F.col("derived_entities"), F.lit(0))["id"]), F.col("id")))
    born = created.where(F.col("eid").isin(matched)).groupBy(F.col("created").alias("id")).agg(F.collect_set("eid").alias("born"))
    d = d.join(changed, "id", "left").join(born, "id", "left")
    # What later rows undid, and what is cited on a row: both bounded by the topic's own events.
    gone = d.where("undone <> ''").select(F.col("undone").alias("sha")).distinct()
    hit = d.select("id", F.explode(F.filter("refs", lambda r: r["kind"] == "commit")).alias("r")).select("id", F.col("r.id").alias("sha")).join(gone, "sha", "left_semi").select("id").distinct().withColumn("was_undone", F.lit(True))
    shown = d.select(F.col("citation").alias("undone")).distinct().withColumn("on_row", F.lit(True))
    d = d.join(hit, "id", "left").join(shown, "undone", "left")
    inside = lambda c: F.array_contains(tracked, c)
    pick = lambda cond: F.get(F.filter("edges", cond), F.lit(0))
    by = pick(lambda e: ((e["predicate"] == "supersedes") & inside(e["target"]) & (e["source"] != e["target"])) | ((e["predicate"] == "superseded_by") & inside(e["source"]) & (e["source"] != e["target"])))
    by_who = F.when(by["predicate"] == "supersedes", by["source"]).otherwise(by["target"])
    birth = F.when((by["predicate"] == "supersedes") & F.coalesce(F.array_contains("born", by["target"]), F.lit(False)), " (at creation)").otherwise("")
    named = F.exists(F.coalesce(F.transform("supersedes", clean_id), F.array().cast("array<string>")), lambda s: F.coalesce(inside(s), F.lit(False)))
    over = pick(lambda e: ((e["predicate"] == "supersedes") & inside(e["source"])) | ((e["predicate"] == "caused_by") & (inside(e["source"]) | inside(e["target"]))))
    first_line = F.coalesce(F.get(F.filter(F.transform(F.split(F.regexp_replace(F.btrim(F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("body"))), BOILERPLATE, ""), "\n"), lambda x: F.btrim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    told = F.array_join(F.filter(F.array(reverted_what(), first_line), lambda x: x != ""), ": ")
    undoes = F.when((F.col("undone") != "") & F.col("on_row").isNull(), F.concat(F.lit(" (undoes "), F.col("undone"), F.lit(")"))).otherwise("")
    note = status_note()
    cases = [
        (F.col("undone").isNotNull(), "REVERTED", F.concat(F.when(told != "", told).otherwise(F.col("title")), undoes)),
        (F.coalesce("was_undone", F.lit(False)), "added", F.col("title")),
        (by.isNotNull(), "SUPERSEDED", F.concat(F.lit("by "), by_who, birth, F.lit(": "), "title")),
        (named, "SUPERSEDED", F.concat(F.lit("by "), "primary", F.lit(": "), "title")),
        (over["predicate"] == "supersedes", "supersedes", F.concat(over["target"], F.lit(": "), "title")),
        (over["predicate"] == "caused_by", "caused_by", F.concat(over["source"], F.lit(" caused by "), over["target"], F.lit(": "), "title")),
        (F.col("eid").isNotNull(), "status", F.concat("eid", F.lit(": "), "old", F.lit(" -> "), "new")),
        (F.col("born").isNotNull(), "added", F.col("title")),
        (note.isNotNull(), "status", note),
    ]
    action, detail = F.col("type"), F.col("title")
    for cond, a, t in reversed(cases):
        ok = F.coalesce(cond, F.lit(False))
        action, detail = F.when(ok, F.lit(a)).otherwise(action), F.when(ok, t).otherwise(detail)
    out = d.select("ts", "id", action.alias("action"), clip(F.regexp_replace(detail, "\n", " ")).alias("detail"), "citation", (~reason_recorded()).alias("silent"))
    return out.select("ts", "id", "action", "detail", "citation", (F.col("silent") & F.col("action").isin("REVERTED", "SUPERSEDED")).alias("no_reason"))


def capped(rows_: DataFrame, most: int = MAX_CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(rows shown, one row ``omitted``): every change of a state, and only the newest ``most`` rows of context."""
    context = ~F.col("action").isin(*TRANSITIONS)
    newest = rows_.where(context).orderBy(F.desc("ts"), F.desc("id")).limit(most)
    shown = rows_.where(~context).unionByName(newest)
    return shown, rows_.where(context).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("omitted"))


def verdicts(seq: DataFrame, graph_: fold.Graph, matched: list[str], titled: list[str], created: DataFrame, changed: DataFrame) -> DataFrame:
    """The resulting state, one row per matched entity and first one for a topic that was undone as such: ``id``, ``state``,
    ``ts``, ``citation``, ``by``, ``what``.

    Superseded before reverted before the folded status.  A revert makes an entity absent only if the event that created it
    names exactly one commit, and it is that one.
    """
    s = seq.withColumn("edges", _edges()).withColumn("citation", citation()).withColumn("undone", undone()).withColumn("primary", F.coalesce(clean_id(F.get(F.col("derived_entities"), F.lit(0))["id"]), F.col("id")))
    e = graph_.entities.where(F.col("id").isin(matched)).select(F.col("id").alias("eid"), "status", "superseded_by")
    ev = F.struct("ts", "id", "citation")
    own = graph_.sources.where(F.col("id").isin(matched)).select(F.col("id").alias("eid"), F.col("event_id").alias("id")).join(s.select("id", "ts", "citation"), "id").groupBy("eid").agg(F.max(ev).alias("own"))
    last = s.agg(F.max(ev)).first()[0]
    latest = F.struct(*[F.lit(last[k] if last else None).cast("string").alias(k) for k in ("ts", "id", "citation")])
    move = changed.join(s.select("id", "ts", "citation"), "id").groupBy("eid").agg(F.max(ev).alias("moved"))
    gone = s.select(ev.alias("x"), "primary", F.explode("supersedes").alias("t")).select("x", clean_id(F.col("t")).alias("eid"), F.col("primary").alias("who"))
    edge = s.select(ev.alias("x"), F.explode("edges").alias("g"))
    gone = gone.unionByName(edge.where("g.predicate = 'supersedes'").select("x", F.col("g.target").alias("eid"), F.col("g.source").alias("who"))).unionByName(edge.where("g.predicate = 'superseded_by'").select("x", F.col("g.source").alias("eid"), F.col("g.target").alias("who")))
    # The event that recorded the supersession by the superseder that stuck, else the first that recorded any.
    sup = gone.join(e, "eid").groupBy("eid").agg(F.min_by("x", F.struct(F.col("who") != F.col("superseded_by"), F.col("x.ts"), F.col("x.id"))).alias("sup"))
    shas = created.where(F.col("eid").isin(matched)).join(s.select(F.col("id").alias("created"), F.array_distinct(F.transform(F.filter("refs", lambda r: r["kind"] == "commit"), lambda r: r["id"])).alias("shas")), "created").where("size(shas) = 1").select("eid", F.col("shas")[0].alias("sha"))
    undo = s.where("undone <> ''").select(ev.alias("x"), F.col("undone"), F.substring("undone", 1, 7).alias("k"))
    rev = shas.withColumn("k", F.substring("sha", 1, 7)).join(undo, "k").where(F.expr("startswith(undone, sha) OR startswith(sha, undone)")).groupBy("eid").agg(F.max("x").alias("rev"))
    d = e.join(own, "eid", "left").join(move, "eid", "left").join(sup, "eid", "left").join(rev, "eid", "left").withColumn("latest", latest)
    is_sup, is_rev = F.col("status") == "superseded", F.col("rev").isNotNull()
    at = F.when(is_sup, F.coalesce("sup", "moved", "own", "latest")).when(is_rev, F.col("rev")).otherwise(F.coalesce("moved", "own", "latest"))
    state = F.when(is_sup, "SUPERSEDED").when(is_rev, "NOT PRESENT").otherwise(F.upper("status"))
    lines = d.select("eid", state.alias("state"), at.alias("at"), F.when(is_sup, F.col("superseded_by")).otherwise("").alias("by"), F.lit("").alias("what"))
    used = d.where(~is_sup & is_rev).select(F.col("rev.id").alias("id"))
    topic = s.where(F.col("id").isin(titled) & F.col("undone").isNotNull()).join(used, "id", "left_anti").orderBy(F.desc("ts"), F.desc("id")).limit(1)
    topic = topic.select(F.lit("").alias("eid"), F.lit("NOT PRESENT").alias("state"), ev.alias("at"), F.lit("").alias("by"), clip(F.when(reverted_what() != "", reverted_what()).otherwise(F.col("title"))).alias("what"))
    out = topic.unionByName(lines)
    return out.select(F.col("eid").alias("id"), "state", F.col("at.ts").alias("ts"), F.col("at.citation").alias("citation"), "by", "what")


def timeline(log: DataFrame, text: str, hops: int = 2, limit: int = 5, as_of: str = "", aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Verdicts, shown rows and the number of omitted context rows for a query text, as of a date if one is given."""
    if as_of:
        log = log.where(F.substring("ts", 1, 10) <= as_of)
    g = fold.replay(log, aliases=aliases)
    # Each part is used several times below; the folded graph is large, what follows from it is a topic.
    g = fold.Graph(cut(g.entities, "entities"), g.facts, g.aliases, g.domains, cut(g.sources, "sources"), cut(g.relations, "relations"), g.notes)
    listed = g.aliases.groupBy("id").agg(F.collect_set("alias").alias("aliases"))
    named = cut(g.entities.select("id", "name").join(listed, "id", "left"), "named")
    matched = [r["id"] for r in search.match_entities(named, text, limit).collect()]
    vocab = cut(search.vocabulary(named, log), "vocab")
    titled = [r["id"] for r in search.title_events(log, text, vocab, rare_only=True).collect()]
    own = g.sources.where(F.col("id").isin(matched)).select(F.col("event_id").alias("id")).distinct()
    seq = cut(sequence(log, g.relations, matched, titled, own, hops), "topic")
    created, changed = transitions(seq, matched, aliases)
    created, changed = cut(created, "created"), cut(changed, "changed")
    all_rows = cut(rows(seq, matched, created, changed), "rows")
    shown, omitted = capped(all_rows)
    return {"verdicts": verdicts(seq, g, matched, titled, created, changed), "rows": all_rows, "shown": shown, "omitted": omitted}
