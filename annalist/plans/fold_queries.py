"""Replay of the log: entities, facts, relations, supersessions, as of a date and in full; the log's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import fold, store
from annalist.plans.sqlkit import ENT, LOG, cid
from annalist.session import table

AS_OF = "2024-06-30"


def _graph(s, d, as_of="", aliases=False):
    m = store.alias_map(table(s, d, "alias_links")) if aliases else None
    return fold.replay(store.event_log(table(s, d, "event_log")), as_of, m)


def f_replay_entities(s, d):
    return _graph(s, d).entities


def f_asof_entities(s, d):
    return _graph(s, d, AS_OF).entities


def f_replay_folded(s, d):
    return _graph(s, d, aliases=True).entities


def f_replay_facts(s, d):
    return _graph(s, d).facts


def f_replay_aliases(s, d):
    return _graph(s, d, aliases=True).aliases


def f_replay_domains(s, d):
    return _graph(s, d).domains


def f_replay_sources(s, d):
    return _graph(s, d).sources


def f_replay_relations(s, d):
    return _graph(s, d).relations


def f_supersessions(s, d):
    return _graph(s, d).notes.select("event_id", "target", "outcome", "primary")


def f_questions(s, d):
    return fold.questions(_graph(s, d).notes)


def f_name_collisions(s, d):
    return fold.name_collisions(store.entities(table(s, d, "entities")))


def f_month_packs(s, d):
    log = store.event_log(table(s, d, "event_log"))
    return log.groupBy(store.month_of().alias("month")).agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def f_ingest_new(s, d):
    """A batch of all deliveries against the log of what had arrived by a date: what is new, by id."""
    raw = table(s, d, "event_log")
    old = store.event_log(raw.where(F.col("seen_at") < F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")))
    return store.new_events(store.event_log(raw), old).select("id", "type", "ts")


def f_event_problems(s, d):
    return store.valid_events(table(s, d, "event_log")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (f_replay_entities, f_asof_entities, f_replay_folded, f_replay_facts, f_replay_aliases, f_replay_domains, f_replay_sources, f_replay_relations, f_supersessions, f_questions, f_name_collisions, f_month_packs, f_ingest_new, f_event_problems)}


def _sql(select: str, as_of: str = "", aliases: bool = False) -> str:
    cut = f"WHERE substr(ts, 1, 10) <= '{as_of}'" if as_of else ""
    amap = f"SELECT {cid('alias')} AS alias, arg_min({cid('canonical')}, row_id) AS canonical FROM alias_links WHERE is_match AND {cid('alias')} <> {cid('canonical')} GROUP BY 1" if aliases else "SELECT '' AS alias, '' AS canonical WHERE false"
    end = fold.END_PREFIX
    return f"""WITH {LOG}, lg AS (SELECT * FROM log {cut}), amap AS ({amap}),
    a0 AS (SELECT ts, id AS event_id, type AS event_type, impact, domains AS event_domains, unnest(derived_entities) AS e, generate_subscripts(derived_entities, 1) AS pos FROM lg),
    a1 AS (SELECT * EXCLUDE (e), {cid('e.id')} AS own_id, coalesce(e.type, '') AS type, coalesce(e.name, '') AS name, coalesce(e.description, '') AS description, coalesce(e.profile.summary, '') AS summary, coalesce(e.profile.key_facts, []) AS key_facts, coalesce(e.aliases, []) AS aliases, coalesce(e.domains, []) AS domains, coalesce(nullif(e.status, ''), 'active') AS status, coalesce({cid('e.superseded_by')}, '') AS by_ FROM a0 WHERE {cid('e.id')} IS NOT NULL),
    a AS (SELECT a1.*, coalesce(m.canonical, own_id) AS id, row(ts, event_id, pos) AS o FROM a1 LEFT JOIN amap m ON m.alias = own_id),
    core AS (SELECT id, min(o) AS first, arg_min(type, o) AS type, arg_min(name, o) AS name, coalesce(arg_max(description, o) FILTER (WHERE description <> ''), '') AS description, coalesce(arg_max(summary, o) FILTER (WHERE summary <> ''), '') AS summary FROM a GROUP BY id),
    born AS (SELECT id, arg_min(row(ts, event_id), o) AS at FROM a GROUP BY id),
    r0 AS (SELECT ts, id AS event_id, impact, domains AS event_domains, unnest(derived_relations) AS r, generate_subscripts(derived_relations, 1) AS pos FROM lg),
    r1 AS (SELECT r0.* EXCLUDE (r), coalesce(m1.canonical, {cid('r.source')}) AS source, coalesce(r.predicate, '') AS predicate, coalesce(m2.canonical, {cid('r.target')}) AS target, nullif(r.ts, '') AS own_ts, {cid('r.provenance')} AS own_prov FROM r0 LEFT JOIN amap m1 ON m1.alias = {cid('r.source')} LEFT JOIN amap m2 ON m2.alias = {cid('r.target')}),
    r2 AS (SELECT r1.*, coalesce(b1.at <= row(r1.ts, r1.event_id), false) AS s_known, coalesce(b2.at <= row(r1.ts, r1.event_id), false) AS t_known FROM r1 LEFT JOIN born b1 ON b1.id = source LEFT JOIN born b2 ON b2.id = target WHERE source <> target),
    r3 AS (SELECT *, s_known OR regexp_matches(source, '{end}') OR contains(source, '/') AS s_ok, t_known OR regexp_matches(target, '{end}') OR contains(target, '/') AS t_ok FROM r2),
    told AS (SELECT CASE WHEN s_ok THEN source ELSE target END AS id, CASE WHEN s_ok THEN predicate || ': ' || target ELSE source || ' ' || predicate || ' this' END AS fact, row(ts, event_id, 1, pos, 0) AS o, ts, event_id FROM r3 WHERE NOT (s_ok AND t_ok) AND CASE WHEN s_ok THEN s_known ELSE t_known END),
    listed AS (SELECT id, unnest(key_facts) AS fact, row(ts, event_id, 0, pos, generate_subscripts(key_facts, 1)) AS o, ts, event_id FROM a),
    facts AS (SELECT id, fact, arg_min(ts, o) AS ts, arg_min(event_id, o) AS event_id FROM (SELECT * FROM listed WHERE fact IS NOT NULL UNION ALL SELECT * FROM told) GROUP BY id, fact),
    refs0 AS (SELECT ts, id AS event_id, impact, domains AS event_domains, unnest(refs) AS ref FROM lg),
    refs1 AS (SELECT coalesce(m.canonical, {cid('ref.id')}) AS id, ts, event_id, impact, event_domains FROM refs0 LEFT JOIN amap m ON m.alias = {cid('ref.id')} WHERE lower(ref.kind) = 'entity'),
    touched AS (SELECT id, ts, event_id, impact, event_domains FROM a UNION ALL SELECT source, ts, event_id, impact, event_domains FROM r3 WHERE s_ok AND t_ok AND s_known UNION ALL SELECT target, ts, event_id, impact, event_domains FROM r3 WHERE s_ok AND t_ok AND t_known
      UNION ALL SELECT refs1.* FROM refs1 JOIN born ON born.id = refs1.id AND born.at <= row(refs1.ts, refs1.event_id)),
    heat AS (SELECT id, max(ts) AS last_touched, max(CASE impact WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS rank FROM touched GROUP BY id),
    sup0 AS (SELECT ts, id AS event_id, trust, coalesce({cid('derived_entities[1].id')}, id) AS prim, unnest(supersedes) AS t, generate_subscripts(supersedes, 1) AS pos FROM lg),
    sup AS (SELECT s.ts, s.event_id, s.prim, s.pos, {cid('s.t')} AS target, CASE WHEN b.at IS NULL OR NOT b.at <= row(s.ts, s.event_id) THEN 'unknown' WHEN s.trust = 'low' THEN 'disputed' ELSE 'done' END AS outcome FROM sup0 s LEFT JOIN born b ON b.id = {cid('s.t')} WHERE {cid('s.t')} IS NOT NULL),
    sets AS (SELECT id, row(ts, event_id, 0, pos) AS o, 0 AS phase, status, by_ , '' AS prim, event_id, pos, ts FROM a WHERE status <> 'active' UNION ALL SELECT target, row(ts, event_id, 1, pos), 1, 'superseded', '', prim, event_id, pos, ts FROM sup WHERE outcome = 'done'),
    sets1 AS (SELECT *, phase = 1 AND coalesce(lag(status) OVER (PARTITION BY id ORDER BY o) <> 'superseded', true) AS effective FROM sets),
    sets2 AS (SELECT *, CASE WHEN effective THEN prim WHEN phase = 0 AND by_ <> '' THEN by_ END AS gives FROM sets1),
    last AS (SELECT id, arg_max(status, o) AS status, max(o) AS set_at, arg_max(gives, o) FILTER (WHERE gives IS NOT NULL) AS superseded_by FROM sets2 GROUP BY id),
    plans AS (SELECT id, max(row(ts, event_id, 0, pos)) AS plan_at FROM a WHERE event_type = 'plan' AND status = 'active' GROUP BY id),
    edges AS (SELECT source, predicate, target, row(ts, event_id, 0, pos) AS o, coalesce(own_ts, ts) AS r_ts, coalesce(own_prov, event_id) AS prov FROM r3 WHERE s_ok AND t_ok UNION ALL SELECT prim, 'supersedes', id, o, ts, event_id FROM sets2 WHERE effective)
    {select}"""


_ENTITIES = """SELECT core.id, core.type, core.name, core.description, core.summary, CASE WHEN last.status IN ('achieved', 'dropped') AND plan_at > set_at THEN 'active' ELSE coalesce(last.status, 'active') END AS status, coalesce(last.superseded_by, '') AS superseded_by,
  CASE heat.rank WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact, coalesce(heat.last_touched, '') AS last_touched FROM core LEFT JOIN heat USING (id) LEFT JOIN last USING (id) LEFT JOIN plans USING (id)"""

SQL = {
    "f_replay_entities": _sql(_ENTITIES),
    "f_asof_entities": _sql(_ENTITIES, AS_OF),
    "f_replay_folded": _sql(_ENTITIES, aliases=True),
    "f_replay_facts": _sql("SELECT id, fact, ts, event_id FROM facts"),
    "f_replay_aliases": _sql("""SELECT DISTINCT id, alias FROM (SELECT a.id, unnest(list_concat(a.aliases, CASE WHEN a.name <> core.name AND a.o > core.first AND a.name <> '' THEN [a.name] ELSE [] END, CASE WHEN a.own_id <> a.id THEN [a.own_id, a.name] ELSE [] END)) AS alias FROM a JOIN core USING (id)) WHERE alias IS NOT NULL""", aliases=True),
    "f_replay_domains": _sql("SELECT DISTINCT id, domain FROM (SELECT id, unnest(domains) AS domain FROM a UNION ALL SELECT id, unnest(event_domains) FROM touched) WHERE domain IS NOT NULL"),
    "f_replay_sources": _sql("SELECT id, event_id, min(ts) AS ts FROM touched GROUP BY id, event_id"),
    "f_replay_relations": _sql("SELECT source, predicate, target, arg_min(r_ts, o) AS ts, arg_min(prov, o) AS provenance FROM edges GROUP BY source, predicate, target"),
    "f_supersessions": _sql("SELECT sup.event_id, sup.target, CASE WHEN outcome <> 'done' THEN outcome WHEN effective THEN 'superseded' ELSE 'again' END AS outcome, sup.prim AS primary FROM sup LEFT JOIN sets2 ON sets2.id = sup.target AND sets2.event_id = sup.event_id AND sets2.pos = sup.pos AND phase = 1"),
    "f_questions": _sql("SELECT CASE WHEN outcome = 'unknown' THEN 'question: ' || event_id || ' supersedes unknown entity ''' || target || '''' ELSE 'disputed: ' || event_id || ' tried to supersede ''' || target || '''' END AS text, min(ts) AS ts FROM sup WHERE outcome <> 'done' GROUP BY 1"),
    "f_name_collisions": f"""WITH {ENT}, n AS (SELECT DISTINCT id, lower(name) AS name FROM (SELECT id, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM ent WHERE status <> 'superseded') WHERE name IS NOT NULL AND name <> ''),
      o AS (SELECT name, min(id) AS owner FROM n GROUP BY name HAVING count(*) > 1) SELECT n.name, owner, id AS claimant FROM n JOIN o USING (name) WHERE id <> owner""",
    "f_month_packs": f"WITH {LOG} SELECT CASE WHEN regexp_matches(trim(ts), '^[0-9]{{4}}-(0[1-9]|1[0-2])') THEN substr(trim(ts), 1, 7) ELSE 'undated' END AS month, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY 1",
    "f_ingest_new": f"WITH {LOG} SELECT id, type, ts FROM log WHERE id NOT IN (SELECT {cid('id')} FROM event_log WHERE seen_at < TIMESTAMP '2024-06-30' AND {cid('id')} IS NOT NULL)",
    "f_event_problems": f"""SELECT CASE WHEN {cid('id')} IS NULL THEN 'no id' WHEN type IS NULL OR type NOT IN ('incident','adr','pr_merged','deploy','config_change','note','release','decision','plan') THEN 'type' WHEN impact NOT IN ('low','medium','high') THEN 'impact' WHEN trust NOT IN ('low','normal','high') THEN 'trust'
      WHEN len(list_filter(coalesce(domains, []), lambda x: NOT regexp_matches(x, '^[a-z0-9]+(-[a-z0-9]+)*$'))) > 0 THEN 'domains' END AS problem, count(*) AS n FROM event_log GROUP BY 1""",
}
