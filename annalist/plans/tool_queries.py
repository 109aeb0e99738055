"""Small parsers, text layouts, checks of proposals, manifests and evaluation records over whole tables.

Where a rule reads files or messages that the tables lack, its input is put together from their columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import anchors, benchfiles, evalkit, fold, grounding, memory, search, store, timeline
from annalist.plans import fold_queries
from annalist.plans import graph_queries as G
from annalist.plans.source_queries import SQL as SOURCE_SQL
from annalist.plans.source_queries import _COM, _DATE, _FILES, _TITLE, _commits, _files, _nodes, _NODES, _para
from annalist.plans.sqlkit import ENT, LOG, NAMES, REL, VOCAB, cid, slug
from annalist.session import cut, table
from annalist.sources import commits as C
from annalist.sources import discover as D
from annalist.sources import documents as X
from annalist.sources import manifests, toon


def _ent(s, d):
    return store.entities(table(s, d, "entities"))


def _log(s, d):
    return store.event_log(table(s, d, "event_log"))


def _rel(s, d):
    return store.relations(table(s, d, "relations"))


def _vocab(s, d):
    return search.vocabulary(_ent(s, d), _log(s, d))


# ---------------------------------------------------------------- parsers


def k_lists(s, d):
    c = T.csv_list(F.concat_ws(" , ", "domains", F.lit(""), "actors"))
    return table(s, d, "event_log").select("row_id", F.array_join(c, "|").alias("items"), F.size(c).cast("bigint").alias("n"))


def k_refs(s, d):
    r = table(s, d, "event_log").select("row_id", F.explode("refs").alias("r")).select("row_id", T.parse_ref(F.concat_ws(":", "r.kind", "r.id")).alias("p"))
    return r.select("row_id", F.coalesce("p.kind", F.lit("")).alias("kind"), F.coalesce("p.id", F.lit("")).alias("id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def k_entities(s, d):
    e = table(s, d, "event_log").select("row_id", F.explode("derived_entities").alias("e")).select("row_id", T.parse_entity(F.concat_ws(":", F.coalesce("e.id", F.lit("")), F.coalesce("e.type", F.lit("")), F.coalesce("e.name", F.lit("")), F.coalesce("e.description", F.lit("")))).alias("p"))
    return e.select("row_id", "p.id", "p.type", "p.name", "p.description")


def k_relations(s, d):
    none = F.lit("")
    r = table(s, d, "relations").select("row_id", T.parse_relation(F.concat_ws(":", F.coalesce("source", none), F.coalesce("predicate", none), F.coalesce("target", none))).alias("p"))
    return r.select("row_id", "p.source", "p.predicate", "p.target")


def k_valid(s, d):
    c = table(s, d, "commits").select("row_id", F.coalesce("sha", F.lit("")).alias("sha"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("date", F.lit("")).alias("date"))
    return c.select("row_id", T.valid_sha(F.col("sha")).alias("sha_ok"), T.valid_ref(F.col("repo")).alias("ref_ok"), T.valid_ref(F.concat(F.lit("a..b/"), "repo")).alias("range_ok"), T.calendar_date(F.col("date")).alias("date_ok"))


def k_json(s, d):
    """A value stands in front of each text, once as it is, once in a fence behind a bracket, and once cut short."""
    one = F.concat(F.lit('{"row": ['), F.col("row_id").cast("string"), F.lit("]}"))
    body = F.coalesce("body", F.lit(""))
    plain, fenced, broken = F.concat(F.lit("result "), one, F.lit(" (ref [2]) and more } "), body), F.concat(F.lit("see [x]\n```json\n"), one, F.lit("\n```\n")), F.concat(F.lit('{"row": ['), F.col("row_id").cast("string"), F.lit(" "), F.regexp_replace(body, r"[\[\]{}]", ""))
    e = table(s, d, "event_log")
    return e.select("row_id", T.extract_json(plain).alias("plain"), T.extract_json(fenced, "{").alias("fenced"), T.extract_json(broken).isNull().alias("broken"))


def t_event_notes(s, d):
    """What each event of the log says on a timeline by itself."""
    e = _log(s, d).withColumn("edges", timeline._edges())
    n = lambda c: F.coalesce(c, F.lit(""))
    return e.select("id", timeline.citation().alias("citation"), F.coalesce(timeline.undone(), F.lit("-")).alias("undone"), timeline.reason_recorded().alias("reason"), timeline.reverted_what().alias("what"), n(timeline.status_note()).alias("status"), T.clip(F.col("title"), 24).alias("short"), F.size("edges").cast("bigint").alias("n_edges"))


# ---------------------------------------------------------------- texts of the map


def m_map_blocks(s, d):
    e, log = _ent(s, d), _log(s, d)
    return memory.map_blocks(e, log, memory.legend(e, log)).select("id", F.md5("block").alias("block_md5"))


def m_entity_blocks(s, d):
    return memory.entity_blocks(_ent(s, d), _log(s, d)).select("id", F.md5("block").alias("block_md5"))


def m_relation_rows(s, d):
    e, log, r = _ent(s, d), _log(s, d), _rel(s, d)
    return memory.relation_rows(memory.topology(r, e), log, memory.legend(e, log, r)).select("source", "predicate", "target", F.md5("row").alias("row_md5"))


def _distilled(s, d):
    e = _ent(s, d)
    return memory.distilled_only(e, e.select("id", F.explode("source_events").alias("event_id")).distinct(), _log(s, d))


def m_distilled(s, d):
    return _distilled(s, d)


def m_hot_map(s, d):
    h = memory.hot_map(memory.scores(_ent(s, d), G.NOW_US, G.DOMAINS), _log(s, d), _rel(s, d), _distilled(s, d), memory.BUDGET)
    return h.select(F.col("section").cast("bigint").alias("section"), "key", "kept")


# ---------------------------------------------------------------- documents and commits


def x_notes(s, d):
    n = X.notes(_files(s, d))
    return n.select("path", "id", "doc_id", "title", F.md5("summary").alias("summary_md5"))


def x_reference_ids(s, d):
    f = _files(s, d).select("path").distinct()
    return f.select("path", X.reference_id(F.col("path")).alias("adr_id"), X.reference_id(F.concat(F.lit("https://host.example/adr/"), "path")).alias("linked"))


def x_observed(s, d):
    t = F.coalesce("text", F.lit(""))
    f = _files(s, d).select("path", X.find_date(t).alias("found"), "day")
    return f.select("path", X.status_observation(F.col("found"), F.col("day"), F.lit("2026-01-01"), F.coalesce(F.nullif("found", F.lit("")), F.col("day"))).alias("observed"))


def x_tables(s, d):
    e = _ent(s, d)
    cols = F.transform(F.filter(F.coalesce("key_facts", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.create_map(F.lit("name"), F.btrim(F.split_part(x, F.lit(":"), F.lit(1))), F.lit("type"), F.lit("fact")))
    t = X.described_tables(e.select(F.lit("x").alias("path"), F.col("name").alias("table"), F.col("description"), cols.alias("columns"), F.col("id").alias("own")).drop("own"))
    return t.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join("key_facts", "|")).alias("facts"), F.max("description").alias("description"))


def c_reverted(s, d):
    c = _commits(s, d)
    body = F.concat("subject", F.lit("\n\nThis reverts commit "), "sha", F.lit(" and "), F.reverse("sha"), F.lit(".\n\n- "), F.md5("sha"), F.lit(": more"))
    return c.select("sha", F.array_join(C.reverted_shas(body, F.col("subject").rlike("^Revert")), ",").alias("shas"))


def c_decisions(s, d):
    c = _commits(s, d).withColumn("subject", F.concat("subject", F.lit(" (ADR-"), F.coalesce("repo", F.lit("x")), F.lit("-two)")))
    return C.decision_commits(c).select("event_id", "sha", "adr_id")


def c_releases(s, d):
    tags = _commits(s, d).select(F.concat(F.lit("v"), F.substring("sha", 1, 6)).alias("tag"), "date", "subject").groupBy("tag").agg(F.min("date").alias("date"), F.min("subject").alias("subject"))
    return C.releases(tags, "Copper Repo").select("id", "type", "ts", "title")


def c_pull_requests(s, d):
    p = table(s, d, "commits").select(F.col("row_id").alias("number"), F.col("subject").alias("title"), F.col("date").alias("mergedAt"), F.coalesce("repo", F.lit("")).alias("headRefName"), F.lit("https://host.example/pr").alias("url"), F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.struct(f.alias("path"))).alias("files"))
    q = C.pull_requests(p, "Copper Repo")
    return q.select("id", "type", "ts", "title")


# ---------------------------------------------------------------- graphs, anchors, proposals


def f_profiles(s, d):
    g = fold.replay(_log(s, d))
    p = _ent(s, d).where("summary <> ''").select("id", F.concat(F.lit("now: "), "summary").alias("summary"), "key_facts")
    return fold.with_profiles(g, p).entities.select("id", "summary")


def a_cross_edges(s, d):
    e = store.entities(table(s, d, "map_entities")).unionByName(_ent(s, d))
    return anchors.cross_repo_edges(anchors.seed(e, _nodes(s, d)), e)


def n_expansion(s, d):
    words = table(s, d, "documents").select("doc_id", F.posexplode(F.slice(T.tokens(F.col("text")), 1, 50)).alias("p", "token")).select((F.col("doc_id") * 100 + F.col("p")).alias("pos"), "token")
    return grounding.expansion(words, _vocab(s, d)).select("token")


def n_aliases(s, d):
    a = table(s, d, "alias_links")
    pairs = a.select(F.lower(F.btrim("alias")).alias("alias"), F.lower(F.btrim("canonical")).alias("canonical"))
    return grounding.aliases(pairs, _ent(s, d), store.alias_map(a.where("score > 0.9")))


def n_links(s, d):
    nodes = _nodes(s, d).select("repo", F.col("name").alias("id"), "name")
    edges = _nodes(s, d).select("repo", F.col("name").alias("source"), F.lit("x").alias("target"))
    short = cut(grounding.node_shortlist(nodes, edges, 20), "short")
    proposed = short.select(F.explode(F.array(F.lit("svc-copper-ledger"), F.lit("svc-none"))).alias("entity"), "repo", F.col("name").alias("node"))
    return grounding.links(proposed, short, store.entities(table(s, d, "map_entities")).unionByName(_ent(s, d)))


def n_relations(s, d):
    return grounding.relations(_rel(s, d).select("source", "predicate", "target"), _ent(s, d))


def n_plan(s, d):
    c = D.candidates(D.directory_stats(_files(s, d).select("path"))).select(F.col("dir").alias("path"), F.when(F.col("adapter") == "", "doc").otherwise(F.col("adapter")).alias("adapter"), "kind", "depth")
    v = c.select("path", F.when(F.length("path") % 3 == 0, "drop").when(F.length("path") % 3 == 1, "override").otherwise("add").alias("action"), F.lit("incident").alias("adapter"), F.lit("checked").alias("kind"), F.array(F.lit("*/tmp/*"), F.lit("*/tmp/*"), F.lit("*.bak")).alias("exclude"))
    out = grounding.apply_verdicts(c.where("depth = 1").drop("depth"), v, c)
    return out.select("path", "adapter", "kind", F.array_join("exclude", ",").alias("exclude"))


def n_workspace(s, d):
    plan = D.candidates(D.directory_stats(_files(s, d).select("path"))).where("adapter <> ''").select(F.col("dir").alias("path"), "adapter", "kind")
    e, r = grounding.workspace_entities(C.repo_facts(_commits(s, d)).where("repo <> ''"), plan)
    return e.select("id", "type", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("key_facts", "; ").alias("facts")).unionByName(r.select(F.col("source").alias("id"), "predicate", "target", F.lit("").alias("aliases"), F.lit("").alias("facts")).toDF("id", "type", "name", "aliases", "facts"))


def d_planted(s, d):
    """Statistics where some files lie in skipped and hidden directories and one directory is a repository of its own."""
    where = F.when(F.col("doc_id") % 5 == 0, "vendor/").when(F.col("doc_id") % 5 == 1, "deep/.cache/").when(F.col("doc_id") % 5 == 2, "inner/src/").otherwise("")
    f = table(s, d, "documents").select(F.concat(where, F.coalesce("path", F.lit(""))).alias("path"))
    return D.directory_stats(f, s.createDataFrame([("inner",)], "repo string")).select("dir", "here", "tree", "readmes", "has_index", "depth")


def d_extensions(s, d):
    c = _commits(s, d).select(F.explode("files").alias("path")).distinct()
    return D.extensions(c).select("dir", "extension", "n", F.col("rank").cast("bigint").alias("rank"))


def d_samples(s, d):
    return D.samples(_files(s, d).select("path").distinct())


def d_repos(s, d):
    c = _commits(s, d).select(F.explode("files").alias("path")).distinct()
    r = c.select(F.element_at(F.split("path", "/"), 1).alias("repo")).unionByName(c.select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("repo"))).where("repo <> ''").distinct()
    return D.assigned_repo(c, r)


# ---------------------------------------------------------------- files made from the tables


def x_codec(s, d):
    """Entities written as files of the at-rest format, one per type, and read back."""
    e = _ent(s, d).withColumn("row", F.to_json(F.struct("id", "name", F.col("description").alias("about, in short"), "summary", F.coalesce("key_facts", F.array().cast("array<string>")).alias("key_facts")), {"ignoreNullFields": "false"}))
    files = toon.encoded(e.select(F.concat(F.coalesce(F.nullif("type", F.lit("")), F.lit("none")), F.lit("-"), F.substring(F.md5("id"), 1, 1)).alias("path"), F.xxhash64("id").alias("pos"), "row"), "entities", "path")
    back = toon.decoded(files, "entities").withColumn("r", F.from_json("row", "id string, name string, `about, in short` string, summary string, key_facts array<string>"))
    return back.select("r.id", "r.name", F.col("r.about, in short").alias("description"), "r.summary", F.array_join("r.key_facts", "|").alias("facts"), F.coalesce("error", F.lit("")).alias("error"))


def x_code_graphs(s, d):
    """Code graphs of the changed files of each repository, written as documents and read back."""
    c = _commits(s, d).where("repo <> ''").select("repo", F.explode("files").alias("f")).distinct()
    row = F.to_json(F.struct(F.col("f").alias("id"), F.when(F.length("f") % 2 == 0, F.element_at(F.split("f", "/"), -1)).alias("label")))
    made = toon.encoded(c.select("repo", F.xxhash64("f").alias("pos"), row.alias("row")), "nodes", "repo")
    nodes, _ = toon.code_graphs(made.withColumn("path", F.lit("graph.toon")))
    return nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"))


def _manifests(s, d):
    e = _ent(s, d).where("type IN ('service', 'module')").select("id", F.regexp_replace("name", r"[^A-Za-z0-9 -]", "").alias("name"))
    spec = F.to_json(F.struct(F.lit("Deployment").alias("kind"), F.struct("name", F.when(F.length("id") % 2 == 0, "acme-prod-eu").otherwise("acme-dev").alias("namespace")).alias("metadata"), F.struct(F.struct(F.concat("name", F.lit(" key")).alias("name")).alias("secretKeyRef")).alias("spec")))
    return e.select(F.concat(F.lit("repo-"), F.substring("id", 5, 1)).alias("repo"), F.concat(F.lit("deploy/"), "id", F.when(F.length("id") % 5 == 0, ".txt").otherwise(".yaml")).alias("path"), spec.alias("text"))


def x_manifest_entities(s, d):
    return manifests.snapshot(_manifests(s, d))[0].select("id", "type", F.array_join("source_events", ",").alias("events"))


def x_manifest_relations(s, d):
    return manifests.snapshot(_manifests(s, d))[1].select("source", "predicate", "target", "provenance")


def x_build_dependencies(s, d):
    r = _commits(s, d).where("repo <> ''").select("repo").distinct()
    dep = r.select("repo", F.explode(F.array(F.concat(F.lit("org/"), "repo", F.lit("-client")), F.lit("unknown"))).alias("dependency")).unionByName(r.select(F.lit("Umbrella").alias("repo"), F.upper("repo").alias("dependency")))
    return manifests.build_dependencies(dep, r)


def v_questions(s, d):
    e = _ent(s, d)
    flat = lambda c: F.btrim(F.regexp_replace(F.col(c), r"[\s*#>_]+", " "))
    block = F.concat(F.lit("## Q"), F.col("row_id").cast("string"), F.lit(". "), flat("name"), F.lit("\n\n> "), flat("description"), F.lit("\n> second line\n\n**Gold:** "), flat("summary"), F.lit("\n\n**Required:**\n- "), flat("name"), F.lit("\n- status "), "status", F.lit("\n\n**Abstain:** yes\n"))
    files = e.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("# Rubric text\n\nabout\n---\n"), block).alias("text"))
    q = benchfiles.questions(files)
    return q.select("qid", "title", "prompt", "gold", F.array_join("required", "|").alias("required"), "abstain", "usable")


def _messages(s, d):
    """Sessions of messages from the stream table: purchases end a turn, errors may be those of a quota."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "tool_result").otherwise("assistant")
    said = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "Rate limit reached").otherwise("broken pipe")).when(F.col("event_type") == "click", F.when(F.col("event_id") % 3 == 0, "use has been denied").otherwise("fine")).otherwise(F.concat(F.lit("answer "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), kind.alias("type"), F.when(F.col("event_type") == "view", "grep").alias("tool"), said.alias("text"), F.when(F.col("event_type") == "purchase", F.col("event_id").cast("double")).alias("total_cost"))


def v_transcripts(s, d):
    return benchfiles.transcripts(_messages(s, d))


def v_turns(s, d):
    t = evalkit.turns(_messages(s, d)).where("type = 'result'")
    return evalkit.turn_costs(t).select("session", "turn", "turn_cost")


def _runs(s, d):
    l = table(s, d, "doc_labels").groupBy("doc_id", "rater").agg(F.max("toxic").alias("toxic"))
    return l.select(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("qid"), F.col("rater").alias("arm"), F.when(F.col("doc_id") % 7 == 0, "error").otherwise("completed").alias("status"), F.when(F.col("toxic") == 0, (F.col("doc_id") % 3 + 1).cast("int")).alias("turns_to_correct"), (F.col("doc_id") % 50).cast("double").alias("seconds_to_correct"), (F.col("doc_id") % 11 == 0).alias("single_shot"), (F.col("doc_id") % 2).cast("int").alias("nudges_sent"), (F.col("doc_id") % 20).cast("double").alias("wall_clock_turn1_s"), (F.col("doc_id") % 4).cast("double").alias("cost"), F.lit(0.5).alias("judge_cost"), F.when(F.col("toxic") == 0, " Correct ").when(F.col("doc_id") % 2 == 0, "partial").otherwise("fine").alias("accuracy"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise((F.col("doc_id") % 5 - 2).cast("string")).alias("fabrication"))


def v_iterations(s, d):
    r = _runs(s, d)
    return evalkit.iteration_stats(r, benchfiles.normalised_verdicts(r).where("length(qid) % 2 = 0"))


def v_verdicts(s, d):
    return benchfiles.normalised_verdicts(_runs(s, d)).select("qid", "arm", "accuracy", F.col("fabrication").cast("bigint").alias("fabrication"))


def v_to_judge(s, d):
    r = _runs(s, d)
    return benchfiles.to_judge(r, r.where("cost = 0"), evalkit.SEED).select("qid", "arm")


def v_spent(s, d):
    return benchfiles.spent(_runs(s, d), 1.5)


def v_checks(s, d):
    r = _runs(s, d)
    c = r.select(F.concat("qid", F.lit("/"), "arm").alias("run"), F.explode(F.array(F.struct(F.lit("clean").alias("name"), (F.col("cost") > 0).alias("ok"), F.lit("fatal").alias("severity")), F.struct(F.lit("quick").alias("name"), (F.col("nudges_sent") == 0).alias("ok"), F.lit("warn").alias("severity")))).alias("c")).select("run", "c.*")
    return benchfiles.checks_passed(c)


def v_assignments(s, d):
    q = _runs(s, d).select("qid").distinct()
    return evalkit.assignments(q, ["plain", "graph"]).select("qid", "arm")


def v_fingerprint(s, d):
    f = _files(s, d).select("path", "text")
    a, b = evalkit.fingerprint(f), evalkit.fingerprint(f.orderBy(F.desc("path")))
    return a.unionByName(b).groupBy("n").agg(F.countDistinct("fingerprint").alias("n_prints"))


QUERIES = {
    f.__name__: f
    for f in (
        k_lists, k_refs, k_entities, k_relations, k_valid, k_json, t_event_notes, m_map_blocks, m_entity_blocks, m_relation_rows, m_distilled, m_hot_map, x_notes, x_reference_ids, x_observed, x_tables,
        c_reverted, c_decisions, c_releases, c_pull_requests, f_profiles, a_cross_edges, n_expansion, n_aliases, n_links, n_relations, n_plan, n_workspace, d_planted, d_extensions, d_samples, d_repos,
        x_codec, x_code_graphs, x_manifest_entities, x_manifest_relations, x_build_dependencies, v_questions, v_transcripts, v_turns, v_iterations, v_verdicts, v_to_judge, v_spent, v_checks, v_assignments, v_fingerprint,
    )
}

_J = "'{\"row\": [' || row_id || ']}'"
_UNDONE = "list_filter(coalesce(derived_relations, []), lambda r: r.predicate = 'reverts')"
_WHY = rf"regexp_replace(trim(summary || chr(10) || body, ' '), '{timeline.BOILERPLATE}', '')"
_TOK = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_FACT = "regexp_extract(coalesce(list_filter(coalesce(e.profile.key_facts, []), lambda f: starts_with(f, 'status='))[1], ''), '^status=(.*?)(?: as of .*)?$', 1)"
_CITE = "id || ' (' || substr(ts, 1, 10) || ') ' || title"
_LEG = f"""cit AS (SELECT id, generate_subscripts(source_events[-2:], 1) AS nth, unnest(source_events[-2:]) AS event_id FROM ent WHERE len(source_events) > 0),
  told AS (SELECT id AS event_id, {_CITE} AS cite FROM log)"""
_TAGS = "leg AS (SELECT event_id, min(id) AS first_id FROM cit WHERE event_id IN (SELECT id FROM log) GROUP BY event_id HAVING count(*) >= 2), tags AS (SELECT event_id, row_number() OVER (ORDER BY first_id, event_id) AS tag FROM leg)"
_TOPO = "ends AS (SELECT id FROM ent WHERE regexp_matches(id, '^(svc|ext)-')), topo AS (SELECT * FROM rel WHERE source IN (SELECT id FROM ends) AND target IN (SELECT id FROM ends))"
_TAGS_R = """allc AS (SELECT event_id, false AS r, id AS f FROM cit UNION ALL SELECT provenance, true, source || ' ' || predicate || ' ' || target FROM topo),
  leg AS (SELECT event_id, min(f) FILTER (NOT r) AS f1, min(f) AS f2 FROM allc WHERE event_id IN (SELECT id FROM log) GROUP BY event_id HAVING count(*) >= 2), tags AS (SELECT event_id, row_number() OVER (ORDER BY f1 IS NULL, coalesce(f1, f2), event_id) AS tag FROM leg)"""
_MARKED = "marked AS (SELECT cit.id, coalesce(string_agg('[c' || tag || ']', '' ORDER BY nth) FILTER (WHERE tag IS NOT NULL), '') AS marks, list(cite ORDER BY nth) FILTER (WHERE tag IS NULL) AS cites FROM cit JOIN told USING (event_id) LEFT JOIN tags USING (event_id) GROUP BY cit.id)"
_HEAD = "'- **' || ent.id || '** (' || type || CASE WHEN impact = 'high' THEN ', impact=high' ELSE '' END || ')' || coalesce(marks, '') || ': ' || coalesce(nullif(description, ''), name)"
_SAMP = "split_part(x, ':', 1) || ': ' || array_to_string(list_filter(list_transform(string_split(CASE WHEN contains(x, ':') THEN substr(x, instr(x, ':') + 1) ELSE '' END, ';'), lambda q: substr(trim(q), 1, 60)), lambda q: q <> '')[:3], '; ')"
_BLOCKS = f"""fk AS (SELECT id, list_filter(list_transform(list_filter(coalesce(key_facts, []), lambda x: x IS NOT NULL), lambda x: {{'k': lower(trim(split_part(x, ':', 1))), 'x': x}}), lambda f: f.k NOT IN ('extensions', 'adapter')) AS f FROM ent),
  fe AS (SELECT id, unnest(f).k AS k, unnest(f).x AS x, generate_subscripts(f, 1) AS pos FROM fk), fn AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id, k) AS n, min(pos) OVER (PARTITION BY id, k) AS first FROM fe),
  inl AS (SELECT id, string_agg(t, ' | ' ORDER BY o) AS inline FROM (SELECT id, x AS t, row(0, pos) AS o FROM fn WHERE nth <= 2 AND k <> 'samples' AND length(x) <= 72 UNION ALL SELECT id, k || ': +' || (n - 2) || ' more', row(1, first) FROM fn WHERE n > 2 AND nth = 1) GROUP BY id),
  own AS (SELECT id, string_agg(chr(10) || '  - ' || CASE WHEN k = 'samples' THEN {_SAMP} ELSE x END, '' ORDER BY pos) AS own FROM fn WHERE nth <= 2 AND (k = 'samples' OR length(x) > 72) GROUP BY id),
  blocks AS (SELECT ent.id, {_HEAD} || CASE WHEN summary <> '' THEN chr(10) || '  - ' || summary ELSE '' END || coalesce(chr(10) || '  - ' || inline, '') || coalesce(own, '') || coalesce(chr(10) || '  - cite: ' || array_to_string(cites, chr(10) || '  - cite: '), '') AS block FROM ent LEFT JOIN marked USING (id) LEFT JOIN inl USING (id) LEFT JOIN own USING (id))"""
_DIST = "dist AS (SELECT id FROM (SELECT DISTINCT e.id, x.event_id FROM ent e, (SELECT id, unnest(source_events) AS event_id FROM ent) x WHERE x.id = e.id) s LEFT JOIN log ON log.id = s.event_id GROUP BY s.id HAVING bool_and(coalesce(log.source = 'study', true)))".replace("SELECT id FROM (SELECT DISTINCT e.id", "SELECT s.id FROM (SELECT DISTINCT e.id")
_RUNS = lambda x: rf"coalesce(list_sum(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN ceil(length(r) / 3.0) ELSE 1 END)), 0)"
_HOT = f"""{_DIST}, mapped AS (SELECT * FROM scored WHERE starts_with(id, 'corpus-') OR type = 'incident' OR (type IN ('service', 'external', 'incident') AND id NOT IN (SELECT id FROM dist))), goals AS (SELECT * FROM scored WHERE type = 'goal' AND status = 'active'),
  chosen AS (SELECT id FROM goals UNION ALL SELECT id FROM mapped), {_LEG.replace("FROM ent WHERE", "FROM (SELECT ent.id, ent.source_events FROM ent JOIN chosen USING (id)) WHERE")}, ends AS (SELECT id FROM mapped WHERE regexp_matches(id, '^(svc|ext)-')), topo AS (SELECT * FROM rel WHERE source IN (SELECT id FROM ends) AND target IN (SELECT id FROM ends)), {_TAGS_R}, {_MARKED}, {_BLOCKS},
  legend AS (SELECT event_id AS key, '- [c' || tag || '] ' || cite AS text FROM tags JOIN told USING (event_id)),
  first AS (SELECT greatest(1, floor(1.2 * (SELECT coalesce(sum({_RUNS('text')}), 0) FROM (SELECT text FROM legend UNION ALL SELECT block FROM goals JOIN blocks USING (id)))))::bigint AS n),
  cost AS (SELECT id, greatest(1, floor({_RUNS('block')} * 1.2))::bigint AS cost, row_number() OVER (ORDER BY -score, type, id) AS rn FROM mapped JOIN blocks USING (id)),
  fill AS (SELECT 0::bigint AS rn, {memory.BUDGET} - (SELECT n FROM first) AS room, ''::varchar AS id, false AS kept UNION ALL SELECT c.rn, CASE WHEN c.cost <= w.room THEN w.room - c.cost ELSE w.room END, c.id, c.cost <= w.room FROM fill w JOIN cost c ON c.rn = w.rn + 1),
  trow AS (SELECT topo.*, '- **' || source || '** ' || predicate || ' **' || target || '**' || coalesce('[c' || tag || ']', chr(10) || '  - cite: ' || cite, '') AS r FROM topo LEFT JOIN told ON told.event_id = topo.provenance LEFT JOIN tags ON tags.event_id = topo.provenance AND told.cite IS NOT NULL),
  tsum AS (SELECT coalesce(sum({_RUNS('r')}), 0) AS n FROM trow)"""


def _reference(x: str) -> str:
    """SQL of the decision that a reference means."""
    r = f"regexp_replace(trim({x}, ' \"''()<>'), '/+$', '')"
    r = f"CASE WHEN contains({r}, '://') THEN regexp_extract({r}, '/(?:keps|adr|adrs|decisions)/(.+)$', 1) ELSE {r} END"
    stem = rf"regexp_replace(coalesce(list_filter(string_split({r}, '/'), lambda p: p NOT IN ('', '.', '..') AND lower(p) NOT IN ('readme.md', 'index.md', 'readme', 'index'))[-1], ''), '(?i)\.(md|markdown|ya?ml)$', '')"
    k = slug(stem)
    num = rf"regexp_extract({k}, '^\d{{3,5}}-(.+)$', 1)"
    return rf"CASE WHEN lower(trim({x})) IN {X.JUNK_REFS} OR regexp_matches({stem}, '(?i)^(?:kep[-\s_]?)?\d+$') OR {stem} = '' THEN '' WHEN starts_with({k}, 'adr-') THEN {k} WHEN {num} <> '' THEN 'adr-' || {num} WHEN {k} <> '' THEN 'adr-' || {k} ELSE '' END"


_RUN = """runs AS (SELECT 'Q' || doc_id AS qid, rater AS arm, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'completed' END AS status, CASE WHEN toxic = 0 THEN (doc_id % 3 + 1)::int END AS turns, (doc_id % 50)::double AS secs, doc_id % 11 = 0 AS single, (doc_id % 2)::int AS nudges, (doc_id % 20)::double AS wall, (doc_id % 4)::double AS cost,
  CASE WHEN toxic = 0 THEN 'correct' WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'wrong' END AS accuracy, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest(0, doc_id % 5 - 2) END AS fabrication FROM (SELECT doc_id, rater, max(toxic) AS toxic FROM doc_labels GROUP BY ALL))"""
_MSG = """msg AS (SELECT user_id AS session, event_id AS pos, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' WHEN 'click' THEN 'tool_result' ELSE 'assistant' END AS type, event_type, event_id FROM events)"""
_MAN = "man AS (SELECT DISTINCT id AS own, 'repo-' || substr(id, 5, 1) AS repo, regexp_replace(name, '[^A-Za-z0-9 -]', '', 'g') AS name, CASE WHEN length(id) % 2 = 0 THEN 'acme-prod-eu' ELSE 'acme-dev' END AS ns, CASE WHEN length(id) % 2 = 0 THEN 'env-production' ELSE 'env-dev' END AS env FROM ent WHERE type IN ('service', 'module') AND length(id) % 5 <> 0)"
_TREE = f"""up AS (SELECT path, string_split(path, '/')[-1] AS name, path LIKE 'inner/%' AS inn, unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/')))) AS dir FROM f WHERE len(list_filter(string_split(path, '/')[:-2], lambda x: starts_with(x, '.') OR lower(x) IN {D.SKIP_DIRS})) = 0)"""
_EXT = r"CASE WHEN regexp_extract(name, '[^.](\.[^.]+)$', 1) <> '' THEN regexp_extract(name, '[^.](\.[^.]+)$', 1) WHEN name IN ('README', 'OWNERS') THEN name ELSE '(none)' END"
_CF = f"{_COM}, f AS (SELECT DISTINCT unnest(files) AS path FROM com)"
_FLAT = lambda c: rf"trim(regexp_replace({c}, '[\s*#>_]+', ' ', 'g'))"

SQL: dict[str, str] = {
    "k_lists": "SELECT row_id, array_to_string(l, '|') AS items, len(l) AS n FROM (SELECT row_id, list_filter(list_transform(string_split(array_to_string(list_concat(coalesce(domains, []), [''], coalesce(actors, [])), ' , '), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM event_log)",
    "k_refs": "SELECT kind, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT coalesce(split_part(t, ':', 1), '') AS kind, CASE WHEN contains(t, ':') THEN substr(t, instr(t, ':') + 1) ELSE '' END AS id FROM (SELECT concat_ws(':', r.kind, r.id) AS t FROM (SELECT unnest(refs) AS r FROM event_log))) GROUP BY kind",
    "k_entities": r"SELECT row_id, p[1] AS id, p[2] AS type, p[3] AS name, p[4] AS description FROM (SELECT row_id, regexp_extract_all(t, '(?s)^([^:]*):([^:]*):([^:]*):(.*)$', 0) AS m, [regexp_extract(t, '(?s)^([^:]*):([^:]*):([^:]*):(.*)$', 1), regexp_extract(t, '(?s)^([^:]*):([^:]*):([^:]*):(.*)$', 2), regexp_extract(t, '(?s)^([^:]*):([^:]*):([^:]*):(.*)$', 3), regexp_extract(t, '(?s)^([^:]*):([^:]*):([^:]*):(.*)$', 4)] AS p FROM (SELECT row_id, coalesce(e.id, '') || ':' || coalesce(e.type, '') || ':' || coalesce(e.name, '') || ':' || coalesce(e.description, '') AS t FROM (SELECT row_id, unnest(derived_entities) AS e FROM event_log)))",
    "k_relations": r"SELECT row_id, regexp_extract(t, '(?s)^([^:]*):', 1) AS source, regexp_extract(t, '(?s)^[^:]*:([^:]*):', 1) AS predicate, regexp_extract(t, '(?s)^[^:]*:[^:]*:(.*)$', 1) AS target FROM (SELECT row_id, coalesce(source, '') || ':' || coalesce(predicate, '') || ':' || coalesce(target, '') AS t FROM relations)",
    "k_valid": "SELECT row_id, regexp_full_match(coalesce(sha, ''), '[0-9a-fA-F]{7,40}') AS sha_ok, regexp_full_match(coalesce(repo, ''), '[A-Za-z0-9_][A-Za-z0-9._/+-]*') AND NOT contains(repo, '..') AND NOT ends_with(repo, '.lock') AS ref_ok, false AS range_ok, regexp_full_match(coalesce(date, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(date AS date) IS NOT NULL AS date_ok FROM commits".replace("AND NOT contains(repo, '..')", "AND NOT contains(coalesce(repo, ''), '..')").replace("ends_with(repo,", "ends_with(coalesce(repo, ''),"),
    "k_json": f"SELECT row_id, {_J} AS plain, {_J} AS fenced, true AS broken FROM event_log",
    "t_event_notes": rf"""WITH {LOG} SELECT id, coalesce(list_filter(coalesce(refs, []), lambda r: r.kind = 'commit')[1].id, list_filter(coalesce(refs, []), lambda r: r.kind = 'pr')[1].id, id) AS citation, CASE WHEN len({_UNDONE}) > 0 THEN coalesce({cid(f'{_UNDONE}[1].target')}, '') ELSE '-' END AS undone,
      length(array_to_string(list_filter(regexp_split_to_array(trim({_WHY}), '\s+'), lambda w: len(list_filter({_TOK('w')}, lambda t: NOT list_contains({_TOK('title')}, t))) > 0), ' ')) >= 20 AS reason,
      trim(regexp_extract(title, '(?i)\breverted\s+(.+)$', 1)) AS what,
      coalesce((SELECT {cid('e.id')} || ' = ' || CASE WHEN {_FACT} <> '' THEN {_FACT} ELSE e.status END FROM (SELECT unnest(derived_entities) AS e, generate_subscripts(derived_entities, 1) AS pos) WHERE {_FACT} <> '' OR coalesce(e.status, '') <> '' ORDER BY pos LIMIT 1), '') AS status,
      CASE WHEN length(title) > 24 THEN substr(title, 1, 21) || '...' ELSE title END AS short, len(coalesce(derived_relations, [])) AS n_edges FROM log""",
    "m_map_blocks": f"WITH {ENT}, {LOG}, {_LEG}, {_TAGS}, {_MARKED}, {_BLOCKS} SELECT id, md5(block) AS block_md5 FROM blocks",
    "m_entity_blocks": f"""WITH {ENT}, {LOG}, {_LEG}, marked AS (SELECT cit.id, list(cite ORDER BY nth) AS cites FROM cit JOIN told USING (event_id) GROUP BY cit.id)
      SELECT id, md5('- **' || id || '** (' || type || ', impact=' || impact || '): ' || coalesce(nullif(description, ''), name) || CASE WHEN summary <> '' THEN chr(10) || '  - ' || summary ELSE '' END || array_to_string(list_transform(list_concat(list_filter(coalesce(key_facts, [])[:3], lambda x: x IS NOT NULL), list_transform(coalesce(cites, []), lambda c: 'cite: ' || c)), lambda x: chr(10) || '  - ' || x), '')) AS block_md5 FROM ent LEFT JOIN marked USING (id)""",
    "m_relation_rows": f"""WITH {ENT}, {LOG}, {REL}, {_LEG}, {_TOPO}, {_TAGS_R} SELECT source, predicate, target, md5('- **' || source || '** ' || predicate || ' **' || target || '**' || coalesce('[c' || tag || ']', chr(10) || '  - cite: ' || cite, '')) AS row_md5 FROM topo LEFT JOIN told ON told.event_id = topo.provenance LEFT JOIN tags ON tags.event_id = topo.provenance""",
    "m_distilled": f"WITH {ENT}, {LOG}, {_DIST} SELECT id FROM dist",
    "m_hot_map": f"""WITH RECURSIVE {G._SCORED}, {LOG}, {REL}, {_HOT} SELECT 0::bigint AS section, key, true AS kept FROM legend UNION ALL SELECT 1, id, true FROM goals UNION ALL SELECT 2, id, kept FROM fill WHERE rn > 0
      UNION ALL SELECT 3, source || ' ' || predicate || ' ' || target, (SELECT (SELECT n FROM first) + coalesce((SELECT sum(cost) FROM fill JOIN cost USING (id) WHERE kept), 0) + floor(1.2 * (n + {memory.TOPOLOGY_HEAD})) <= {memory.BUDGET} FROM tsum) FROM trow""",
    "x_notes": f"WITH {_FILES}, g AS (SELECT *, {_TITLE} AS title FROM f) SELECT path, 'evt-doc-' || {slug('title')} || '-' || substr(digest, 1, 8) AS id, 'doc-' || {slug('title')} AS doc_id, title, md5({_para(40)}) AS summary_md5 FROM g WHERE title <> ''",
    "x_reference_ids": f"SELECT DISTINCT path, {_reference('path')} AS adr_id, {_reference(chr(40) + chr(39) + 'https://host.example/adr/' + chr(39) + ' || path)')} AS linked FROM (SELECT coalesce(path, '') AS path FROM documents)",
    "x_observed": rf"WITH {_FILES}, g AS (SELECT path, day, {_DATE} AS fd FROM f) SELECT path, greatest(CASE WHEN try_cast(nullif(fd, '') AS date) IS NOT NULL THEN fd WHEN try_cast(day AS date) IS NOT NULL THEN day ELSE '2026-01-01' END, coalesce(nullif(fd, ''), day)) AS observed FROM g",
    "x_tables": f"""WITH {ENT}, t AS (SELECT 'table-' || {slug('name')} AS id, name, coalesce(nullif(description, ''), 'Database table ' || name) AS description, array_to_string(list_transform(list_filter(coalesce(key_facts, []), lambda x: x IS NOT NULL), lambda x: 'column ' || trim(split_part(x, ':', 1)) || ': type=fact'), '|') AS facts FROM ent WHERE name <> '')
      SELECT id, name, count(*) AS n, max(facts) AS facts, max(description) AS description FROM t GROUP BY id, name""",
    "c_reverted": f"WITH {_COM} SELECT sha, array_to_string(list_distinct_ordered, ',') AS shas FROM (SELECT sha, list_transform(CASE WHEN regexp_matches(subject, '^Revert') THEN [sha, reverse(sha), md5(sha)] ELSE [sha, reverse(sha)] END, lambda x: substr(x, 1, 12)) AS list_distinct_ordered FROM com)",
    "c_decisions": rf"WITH {_COM}, x AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(subject || ' (ADR-' || repo || '-two)'), '{C.ADR_ID}', 1))) AS ids FROM com) SELECT 'evt-' || replace(date, '-', '') || '-' || {slug('repo')} || '-' || substr(sha, 1, 8) AS event_id, sha, unnest(ids) AS adr_id FROM x",
    "c_releases": f"WITH {_COM}, t AS (SELECT 'v' || substr(sha, 1, 6) AS tag, min(date) AS date FROM com GROUP BY 1) SELECT 'evt-' || coalesce(nullif(replace(date, '-', ''), ''), 'undated') || '-copper-repo-release-' || {slug('tag')} AS id, 'release' AS type, coalesce(nullif(date, ''), '1970-01-01') AS ts, 'Copper Repo release ' || tag AS title FROM t",
    "c_pull_requests": "SELECT 'evt-' || replace(day, '-', '') || '-copper-repo-pr' || row_id AS id, 'pr_merged' AS type, day AS ts, 'Copper Repo PR-' || row_id || ': ' || substr(coalesce(subject, ''), 1, 120) AS title FROM (SELECT *, coalesce(nullif(substr(date, 1, 10), ''), '1970-01-01') AS day FROM commits)",
    "a_cross_edges": f"""WITH {_NODES}, x AS (SELECT DISTINCT 'svc-' || {slug('repo')} AS source, nms.id AS target, repo, nms.id AS entity FROM nms JOIN nodes ON contains(lower(nodes.name), nms.name) WHERE type = 'service' AND nms.id <> 'svc-' || {slug('repo')}),
      eq AS (SELECT DISTINCT id AS entity, repo, min(nodes.name) AS node FROM nms JOIN nodes ON lower(nodes.name) = nms.name WHERE type NOT IN ('secret-ref', 'env') GROUP BY id, repo, nms.name), wit AS (SELECT nms.id AS entity, repo, min(nodes.name) AS node FROM nms JOIN nodes ON contains(lower(nodes.name), nms.name) WHERE type = 'service' AND nms.id <> 'svc-' || {slug('repo')} GROUP BY ALL)
      SELECT DISTINCT 'svc-' || {slug('repo')} AS source, 'references_in_code' AS predicate, entity AS target FROM wit WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.entity = wit.entity AND eq.repo = wit.repo AND eq.node = wit.node) AND 'svc-' || {slug('repo')} IN (SELECT id FROM es)""",
    "f_profiles": fold_queries._sql(f", {ENT.replace('ent AS', 'prof AS')} SELECT core.id, CASE WHEN coalesce(prof.summary, '') <> '' THEN 'now: ' || prof.summary ELSE core.summary END AS summary FROM core LEFT JOIN prof USING (id)"),
    "n_links": f"WITH {_NODES}, r AS (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY name) AS r FROM (SELECT DISTINCT repo, name FROM nodes)) SELECT 'svc-copper-ledger' AS entity, repo, name AS node, 'link' AS kind FROM r WHERE r <= 20 AND 'svc-copper-ledger' IN (SELECT id FROM es)",
    "n_plan": f"""WITH cand AS ({SOURCE_SQL['d_candidates']}), c AS (SELECT dir AS path, CASE WHEN adapter = '' THEN 'doc' ELSE adapter END AS adapter, kind, len(string_split(dir, '/')) AS depth, length(dir) % 3 AS v FROM cand)
      SELECT path, CASE WHEN v = 1 THEN 'incident' ELSE adapter END AS adapter, CASE WHEN v = 1 THEN 'checked' ELSE kind END AS kind, '*/tmp/*,*.bak' AS exclude FROM c WHERE depth = 1 AND v <> 0 UNION ALL (SELECT path, 'incident', 'checked', '' FROM c WHERE depth > 1 AND v = 2 ORDER BY path LIMIT 8)""",
    "n_workspace": f"""WITH cand AS ({SOURCE_SQL['d_candidates']}), rf AS ({SOURCE_SQL['c_repo_facts']})
      SELECT 'svc-' || {slug('repo', 64)} AS id, 'service' AS type, repo AS name, '' AS aliases, concat_ws('; ', 'commits: ' || n_commits, 'first: ' || nullif(first, ''), 'last: ' || nullif(last, ''), 'language: ' || nullif(language, '')) AS facts FROM rf WHERE repo <> ''
      UNION ALL SELECT 'corpus-' || {slug('dir', 64)}, 'doc', dir, '', 'adapter: ' || adapter FROM cand WHERE adapter <> '' UNION ALL SELECT 'corpus-' || {slug('dir', 64)}, 'documented_in', dir, '', '' FROM cand WHERE adapter <> ''""",
    "n_aliases": f"""WITH {ENT}, p AS (SELECT DISTINCT lower(trim(alias)) AS alias, lower(trim(canonical)) AS canonical FROM alias_links), done AS (SELECT {cid('alias')} AS alias FROM alias_links WHERE is_match AND score > 0.9 AND {cid('alias')} IS NOT NULL AND {cid('canonical')} IS NOT NULL AND {cid('alias')} <> {cid('canonical')})
      SELECT p.alias, min(p.canonical) AS canonical FROM p JOIN ent a ON a.id = p.alias JOIN ent b ON b.id = p.canonical WHERE p.alias <> p.canonical AND a.type = b.type AND p.alias NOT IN (SELECT alias FROM done) GROUP BY p.alias""",
    "n_relations": f"WITH {ENT}, {REL} SELECT DISTINCT source, predicate, target FROM rel WHERE predicate IN {grounding.PREDICATES} AND source <> target AND source IN (SELECT id FROM ent) AND target IN (SELECT id FROM ent)",
    "n_expansion": f"""WITH {LOG}, {ENT}, {NAMES}, {VOCAB}, w AS (SELECT doc_id * 100 + generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT doc_id, (list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))[:50] AS t FROM documents))
      SELECT token FROM (SELECT token, min(pos) AS pos FROM w WHERE token IN (SELECT token FROM voc) GROUP BY token) ORDER BY pos, token LIMIT 6""",
    "d_planted": f"""WITH f AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'deep/.cache/' WHEN 2 THEN 'inner/src/' ELSE '' END || coalesce(path, '') AS path FROM documents), {_TREE}
      SELECT dir, sum(((name LIKE '%.md' OR name = 'README') AND CASE WHEN dir = '.' THEN name = path ELSE dir || '/' || name = path END)::bigint)::bigint AS here, sum((name LIKE '%.md' OR name = 'README')::bigint)::bigint AS tree, sum((name = 'README')::bigint)::bigint AS readmes,
        bool_or(lower(name) IN {D.INDEX_FILES} AND CASE WHEN dir = '.' THEN name = path ELSE dir || '/' || name = path END) AS has_index, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) - CASE WHEN inn THEN 1 ELSE 0 END END AS depth FROM up WHERE NOT inn OR dir = 'inner' OR starts_with(dir, 'inner/') GROUP BY dir, inn""",
    "d_extensions": f"""WITH {_CF}, {_TREE}, n AS (SELECT dir, {_EXT} AS extension, count(*) AS n FROM up GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, extension) AS rank FROM n) SELECT dir, extension, n, rank FROM r WHERE rank <= 6""",
    "d_samples": f"""WITH f AS (SELECT DISTINCT coalesce(path, '') AS path FROM documents), {_TREE}, k AS (SELECT dir, CASE WHEN dir = '.' THEN path ELSE substr(path, length(dir) + 2) END AS sample FROM up WHERE name LIKE '%.md' OR name = 'README'),
      o AS (SELECT *, list_transform(string_split(sample, '/'), lambda x, i: CASE WHEN i = len(string_split(sample, '/')) THEN '0' ELSE '1' END || x) AS ord FROM k), r AS (SELECT dir, sample, row_number() OVER (PARTITION BY dir ORDER BY ord) AS pos FROM o) SELECT dir, sample, pos FROM r WHERE pos <= 5""",
    "d_repos": f"""WITH {_CF}, rp AS (SELECT DISTINCT unnest([string_split(path, '/')[1], regexp_extract(path, '^([^/]+/[^/]+)/', 1)]) AS repo FROM f) SELECT f.path, coalesce(max_by(repo, length(repo)), '.') AS repo FROM f LEFT JOIN rp ON repo <> '' AND starts_with(f.path, repo || '/') GROUP BY f.path""",
    "x_codec": f"WITH {ENT} SELECT id, name, description, summary, array_to_string(coalesce(key_facts, []), '|') AS facts, '' AS error FROM ent",
    "x_code_graphs": f"WITH {_COM}, c AS (SELECT DISTINCT repo, unnest(files) AS f FROM com WHERE repo <> '') SELECT repo, count(*) AS n, count(DISTINCT CASE WHEN length(f) % 2 = 0 THEN string_split(f, '/')[-1] ELSE f END) AS n_names FROM c GROUP BY repo",
    "x_manifest_entities": f"WITH {ENT}, {_MAN}, x AS (SELECT 'svc-' || {slug('name')} AS id, 'service' AS type, repo FROM man UNION SELECT env, 'env', repo FROM man UNION SELECT 'secret-' || {slug(chr(40) + 'name || ' + chr(39) + ' key' + chr(39) + chr(41))}, 'secret-ref', repo FROM man) SELECT id, type, string_agg(DISTINCT 'code@' || repo, ',' ORDER BY 'code@' || repo) AS events FROM x GROUP BY id, type",
    "x_manifest_relations": f"WITH {ENT}, {_MAN}, x AS (SELECT 'svc-' || {slug('name')} AS source, 'deployed_to' AS predicate, env AS target, repo FROM man UNION ALL SELECT 'svc-' || {slug('name')}, 'reads_secret', 'secret-' || {slug(chr(40) + 'name || ' + chr(39) + ' key' + chr(39) + chr(41))}, repo FROM man) SELECT source, predicate, target, min('code@' || repo) AS provenance FROM x GROUP BY ALL",
    "x_build_dependencies": f"""WITH {_COM}, r AS (SELECT DISTINCT repo FROM com WHERE repo <> ''), dp AS (SELECT repo, 'org/' || repo || '-client' AS dep FROM r UNION SELECT 'Umbrella', upper(repo) FROM r)
      SELECT DISTINCT 'svc-' || regexp_replace(lower(dp.repo), '[^a-z0-9]+', '-', 'g') AS source, 'depends_on' AS predicate, 'svc-' || regexp_replace(lower(r.repo), '[^a-z0-9]+', '-', 'g') AS target FROM dp JOIN r ON (contains(lower(dep), lower(r.repo)) AND length(r.repo) >= 5) OR lower(dep) = lower(r.repo) WHERE dp.repo <> r.repo""",
    "v_questions": rf"""WITH {ENT} SELECT 'Q' || row_id AS qid, {_FLAT('name')} AS title, trim({_FLAT('description')} || chr(10) || 'second line', ' ' || chr(10)) AS prompt, {_FLAT('summary')} AS gold, {_FLAT('name')} || '|status ' || status AS required, true AS abstain, {_FLAT('summary')} <> '' AS usable FROM ent""",
    "v_transcripts": f"""WITH {_MSG} SELECT session, 'answer ' || max(pos) FILTER (WHERE type = 'assistant') AS answer, count(*) FILTER (WHERE event_type = 'view') AS n_tools, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 0) AS n_denied, coalesce(max(event_id::double) FILTER (WHERE type = 'result'), 0) AS cost, count(*) FILTER (WHERE type = 'error' AND event_id % 2 = 0) AS n_quota FROM msg GROUP BY session""",
    "v_turns": f"WITH {_MSG}, r AS (SELECT session, pos, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS turn FROM msg WHERE type = 'result') SELECT session, turn, (pos - coalesce(lag(pos) OVER (PARTITION BY session ORDER BY turn), 0))::double AS turn_cost FROM r",
    "v_iterations": f"""WITH {_RUN}, j AS (SELECT r.*, CASE WHEN length(qid) % 2 = 0 THEN accuracy = 'correct' ELSE false END AS fixed FROM runs r WHERE status <> 'error'), k AS (SELECT *, CASE WHEN fixed THEN 1 ELSE turns END AS t, CASE WHEN fixed AND coalesce(turns, 0) <> 1 THEN wall ELSE secs END AS s FROM j)
      SELECT arm, count(*) FILTER (NOT single) AS multi, count(*) FILTER (single) AS single, count(*) FILTER (single AND t = 1) AS single_correct, count(*) FILTER (NOT single AND t = 1) AS at_turn_1, count(*) FILTER (NOT single AND t = 2) AS at_turn_2, count(*) FILTER (NOT single AND t = 3) AS at_turn_3, count(*) FILTER (NOT single AND t IS NULL) AS never,
        coalesce(round(median(t::double) FILTER (NOT single), 3), 0) AS turns_median, coalesce(round(median(s) FILTER (NOT single AND t IS NOT NULL), 3), 0) AS seconds_median, sum(nudges)::bigint AS nudges, count(*) FILTER (NOT single AND t > 1) AS improved FROM k GROUP BY arm""",
    "v_verdicts": f"WITH {_RUN} SELECT qid, arm, accuracy, fabrication FROM runs",
    "v_to_judge": f"WITH {_RUN} SELECT qid, arm FROM runs WHERE status = 'completed' AND cost <> 0",
    "v_spent": f"WITH {_RUN} SELECT sum(cost + 0.5) - 1.5 AS spent FROM runs",
    "v_checks": f"WITH {_RUN} SELECT qid || '/' || arm AS run, cost > 0 AS passed, concat_ws(',', CASE WHEN cost = 0 THEN 'clean' END, CASE WHEN nudges > 0 THEN 'quick' END) AS failed FROM runs",
    "v_assignments": f"WITH {_RUN} SELECT DISTINCT qid, unnest(['plain', 'graph']) AS arm FROM runs",
    "v_fingerprint": "SELECT count(*) AS n, 1::bigint AS n_prints FROM documents",
}
