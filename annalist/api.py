"""A knowledge base in one folder: the verbs of daily use as methods that return DataFrames.

What a model or a version control tool would supply (expansions of a query, alias verdicts, profiles, commits, files)
comes in as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text import lint
from annalist.operators import anchors, fold, graph, memory, render, search, store, timeline
from annalist.sources import discover, toon


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A stored table, empty where it was never written; a table that is there but cannot be read is an error."""
        path = f"{self.path}/{name}"
        return self.spark.read.parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _put(self, name: str, df: DataFrame) -> None:
        """Replace a table through a copy, so that it may be computed from itself."""
        from annalist.session import cut

        cut(df, name).write.mode("overwrite").parquet(f"{self.path}/{name}")

    # -- writing ------------------------------------------------------------------------------------------------
    def append(self, events: DataFrame) -> None:
        """Store events (one row per id); those that may not be written raise an error before anything is stored."""
        bad = store.valid_events(events).where("problem IS NOT NULL").select("id", "problem").limit(5).collect()
        if bad:
            raise ValueError("events that may not be written: " + ", ".join(f"{r['id']} ({r['problem']})" for r in bad))
        store.append(store.event_log(events), f"{self.path}/log")

    def ingest(self, events: DataFrame) -> DataFrame:
        """Append the events whose ids the log lacks; returns them."""
        from annalist.session import cut

        log = store.event_log(events)
        old = self.log()
        new = cut(store.new_events(log, old) if old is not None else log, "new")
        store.append(new, f"{self.path}/log")
        return new

    def pack(self) -> None:
        store.compact(f"{self.path}/log")

    def resolve(self, aliases: DataFrame) -> None:
        """Add alias verdicts (``alias``, ``canonical``); chains are collapsed to their roots."""
        both = self.aliases().unionByName(aliases.select("alias", "canonical")).where("alias <> canonical")
        one = both.groupBy("alias").agg(F.min("canonical").alias("canonical"))
        self._put("aliases", graph.alias_roots(one))

    def profile(self, profiles: DataFrame) -> None:
        old = self.profiles().join(profiles.select("id"), "id", "left_anti")
        self._put("profiles", old.unionByName(profiles.select("id", "summary", "key_facts")))

    def index(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace the code graph (``repo``, ``id``, ``name``; ``repo``, ``source``, ``target``, ``label``)."""
        self._put("nodes", nodes)
        self._put("edges", edges)

    def seed_anchors(self) -> DataFrame:
        a = anchors.seed(self.named(), self._table("nodes", "repo string, id string, name string"))
        self._put("anchors", self._table("anchors", "entity string, repo string, node string, kind string").unionByName(a).dropDuplicates(["entity", "repo", "node"]))
        return self._table("anchors", "entity string, repo string, node string, kind string")

    # -- reading ------------------------------------------------------------------------------------------------
    def log(self) -> DataFrame | None:
        """The log, None where no event was stored yet."""
        path = f"{self.path}/log"
        return self.spark.read.parquet(path) if store.exists(self.spark, path) else None

    def aliases(self) -> DataFrame:
        return self._table("aliases", "alias string, canonical string")

    def profiles(self) -> DataFrame:
        return self._table("profiles", "id string, summary string, key_facts array<string>")

    def rebuild(self, as_of: str = "") -> fold.Graph:
        """The graph folded from the log, as of a date if one is given; profiles are not dated."""
        return fold.with_profiles(fold.replay(self._log(), as_of, self.aliases()), self.profiles())

    def _log(self) -> DataFrame:
        log = self.log()
        if log is None:
            raise LookupError("the log is empty")
        return log

    def named(self, as_of: str = "") -> DataFrame:
        """Entities with their aliases and domains as arrays."""
        return self._named(self.rebuild(as_of))

    @staticmethod
    def _named(g: fold.Graph) -> DataFrame:
        a = g.aliases.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        d = g.domains.groupBy("id").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
        none = F.array().cast("array<string>")
        return g.entities.join(a, "id", "left").join(d, "id", "left").withColumns({"aliases": F.coalesce("aliases", none), "domains": F.coalesce("domains", none)})

    def vocab(self, *stems: str) -> DataFrame:
        return search.near(search.vocabulary(self.named(), self._log()), [s.lower() for s in stems]).orderBy("n", "token")

    def query(self, text: str, hops: int = 2, limit: int = 5, as_of: str = "", expansion: list[str] | None = None) -> dict[str, DataFrame]:
        """Matched entities, relations around them, their newest events, titles that match, and a hint for weak matches.

        ``expansion`` (words of the vocabulary, six at most) is appended where no title owes its match to a rare word.
        """
        from annalist.session import cut

        log, g = self._log(), self.rebuild(as_of)
        # Both are read several times below.
        named, relations = cut(self._named(g), "named"), cut(g.relations, "relations")
        if as_of:
            log = log.where(F.substring("ts", 1, 10) <= as_of)
        vocab = search.vocabulary(named, log)
        if expansion and not search.titles_discriminate(log, text, vocab).first()[0]:
            text = " ".join([text, *expansion[:6]])
        ids = [r["id"] for r in search.match_entities(named, text, limit).collect()]
        matched = named.where(F.col("id").isin(ids))
        centers = self.spark.createDataFrame([(i,) for i in ids], "id string")
        near = graph.subgraph(relations, centers, hops)
        own = g.sources.where(F.col("id").isin(ids)).select(F.col("event_id").alias("id")).distinct()
        events = log.join(own, "id", "left_semi").orderBy(F.desc("ts"), F.desc("id")).limit(12)
        titled = search.title_events(log, text, vocab, exclude=events.orderBy(F.desc("ts"), F.desc("id")).limit(5))
        return {"entities": matched, "relations": near.orderBy("source", "predicate", "target"), "events": events, "titles": titled, "hint": search.vocab_hint(vocab, text), "facts": g.facts.where(F.col("id").isin(ids)), "graph": relations, "centers": centers}

    def answer(self, text: str, hops: int = 2, limit: int = 5, as_of: str = "") -> str:
        """``query`` as text; every section is capped and says what it leaves out."""
        d = self.query(text, hops, limit, as_of)
        first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "fact"))), lambda x: x["fact"]), 1, render.MAX_FACTS)
        entities = d["entities"].join(d["facts"].groupBy("id").agg(first.alias("facts")), "id", "left").orderBy("id").collect()
        own = self._log().withColumn("edges", timeline._edges()).select("id", "type", timeline.undone().alias("undone"), timeline.citation().alias("citation"))
        titles = d["titles"].select("id", "score").join(self._log().select("id", "ts", "title"), "id").join(own, "id").orderBy(F.desc("score"), F.desc("ts"), F.desc("id")).collect()
        shown = d["relations"].limit(render.MAX_RELATIONS).collect()
        counts = graph.held_back(d["graph"], d["centers"], hops).first()
        events = d["events"].collect()
        return render.answer(entities, titles, shown, counts["shown"], counts["held"], events, len(events), hops)

    def timeline_text(self, text: str, hops: int = 2, limit: int = 5, as_of: str = "") -> str:
        """``timeline`` as text: every change of a state, the newest context, and how much context was left out."""
        d = self.timeline(text, hops, limit, as_of)
        return render.timeline(d["shown"].collect(), d["omitted"].first()["omitted"])

    def set_goal(self, goal: str, status: str, day: str) -> None:
        """Record that a goal has a status (active, achieved or dropped) from a day on, as a plan event."""
        if status not in ("active", *memory.RESOLVED[1:]):
            raise ValueError(f"no status of a goal: {status}")
        known = self.rebuild().entities.where((F.col("id") == goal) & (F.col("type") == "goal")).first()
        if known is None:
            raise LookupError(f"no such goal: {goal}")
        schema = "id string, type string, ts string, title string, summary string, impact string, domains array<string>, actors array<string>, trust string, refs array<struct<kind:string,id:string>>, supersedes array<string>, body string, source string, disputed boolean, derived_entities array<struct<id:string,type:string,name:string,description:string,aliases:array<string>,domains:array<string>,status:string,superseded_by:string,profile:struct<summary:string,key_facts:array<string>>>>, derived_relations array<struct<source:string,predicate:string,target:string,ts:string,provenance:string>>, row_id bigint"
        entity = (goal, "goal", known["name"], known["description"], [], [], status, "", None)
        row = (f"evt-{day.replace('-', '')}-{goal}-{status}", "plan", day, f"{goal} is {status}", "", "medium", [], [], "normal", [], [], "", "manual", False, [entity], [], 0)
        self.append(self.spark.createDataFrame([row], schema).withColumn("seen_at", F.lit(f"{day} 00:00:00").cast("timestamp_ntz")))

    def timeline(self, text: str, hops: int = 2, limit: int = 5, as_of: str = "") -> dict[str, DataFrame]:
        return timeline.timeline(self._log(), text, hops, limit, as_of, self.aliases())

    def questions(self) -> DataFrame:
        return fold.questions(self.rebuild().notes)

    def goals(self) -> DataFrame:
        e = self.rebuild().entities.where("type = 'goal'")
        return e.orderBy(F.col("status") != "active", "id")

    def tiers(self, now_us: int, domain_weights: dict[str, float] | None = None, budget: int = memory.BUDGET) -> dict[str, DataFrame]:
        """Scores and tiers of all entities, the map that fits the budget, and the domains."""
        from annalist.session import cut

        g = self.rebuild()
        e = cut(self._named(g), "named")
        scored = memory.scores(e, now_us, domain_weights)
        study = memory.distilled_only(e, g.sources, self._log()).withColumn("distilled", F.lit(True))
        mapped = scored.join(study, "id", "left").withColumn("distilled", F.coalesce("distilled", F.lit(False))).where(memory.is_map_entity(F.col("distilled")))
        return {"scores": scored, "hot": memory.fill(memory.blocks(mapped), budget), "index": memory.index_lines(scored), "domains": memory.domain_tiers(scored)}

    def doctor(self) -> DataFrame:
        """Ends of relations that are no known entity and no reference of a kind that needs none."""
        g = self.rebuild()
        exempt = r"^(PR-|pr-|evt-|adr-|task-|inc-)"
        ends = g.relations.select(F.explode(F.array("source", "target")).alias("id"), "provenance").where(~F.col("id").rlike(exempt) & ~F.contains(F.col("id"), F.lit("/")))
        return ends.join(g.entities.select("id"), "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("provenance").alias("example"))

    def check_files(self, path: str) -> DataFrame:
        """Files of the at-rest format that cannot be read (``parse``) or hold values of secrets (``secret``): ``path``,
        ``kind``, ``detail``."""
        files = self.spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.toon").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        bad = toon.decoded(files).where("error IS NOT NULL").select("path", F.lit("parse").alias("kind"), F.col("error").alias("detail"))
        return bad.unionByName(files.select("path", F.lit("secret").alias("kind"), F.explode(lint(F.col("text"))).alias("detail")))

    def plan_sources(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kept, dropped) sources among the directories of ``files`` (``path``)."""
        return discover.plan(discover.candidates(discover.directory_stats(files)))
