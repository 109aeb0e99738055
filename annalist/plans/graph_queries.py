"""Traversal, temperature and budget queries over the stored graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import graph, memory, store
from annalist.plans.sqlkit import ENT, LOG, REL, cid, slug
from annalist.session import table

NOW_US = 1_767_225_600_000_000  # 2026-01-01
DOMAINS = {"billing": 0.9, "identity": 0.7, "storage": 0.5}
CENTERS = ("svc-copper-ledger", "env-olive-sextant-8t7y2m", "module-frost-shuttle")
SMALL_BUDGET = 4_000


def _rel(s, d):
    return store.relations(table(s, d, "relations"))


def _ent(s, d):
    return store.entities(table(s, d, "entities"))


def _centers(s):
    return s.createDataFrame([(c,) for c in CENTERS], "id string")


def g_hubs(s, d):
    return graph.hubs(_rel(s, d))


def g_subgraph(s, d):
    return graph.subgraph(_rel(s, d), _centers(s), 2).select("source", "predicate", "target", "provenance")


def g_held_back(s, d):
    return graph.held_back(_rel(s, d), _centers(s), 2)


def g_alias_roots(s, d):
    return graph.alias_roots(store.alias_map(table(s, d, "alias_links")))


def g_profile_candidates(s, d):
    e = _ent(s, d)
    src = e.select("id", F.explode("source_events").alias("event_id")).distinct()
    return graph.profile_candidates(_rel(s, d), e, src)


def g_temporal_events(s, d):
    log = store.event_log(table(s, d, "event_log"))
    return graph.temporal_events(log, _rel(s, d), _centers(s), 2)


def _scored(s, d):
    return memory.scores(_ent(s, d), NOW_US, DOMAINS)


def m_scores(s, d):
    return _scored(s, d).select("id", "score", "tier")


def m_domain_tiers(s, d):
    return memory.domain_tiers(_scored(s, d))


def m_budget(s, d):
    return memory.fill(memory.blocks(_scored(s, d)), SMALL_BUDGET).select("id", "cost", "kept")


def m_legend(s, d):
    return memory.legend(_ent(s, d), store.event_log(table(s, d, "event_log")))


def m_legend_topology(s, d):
    """The whole legend: ``m_legend`` counts the citations of entities alone, as its SQL does."""
    return memory.legend(_ent(s, d), store.event_log(table(s, d, "event_log")), _rel(s, d))


def m_facts(s, d):
    return memory.trimmed_facts(_ent(s, d))


def m_index(s, d):
    return memory.index_lines(_scored(s, d)).select("id", "line")


def m_goals(s, d):
    return _ent(s, d).where("type = 'goal'").select("id", "status", F.coalesce(F.nullif("description", F.lit("")), F.col("name")).alias("label"))


QUERIES = {f.__name__: f for f in (g_hubs, g_subgraph, g_held_back, g_alias_roots, g_profile_candidates, g_temporal_events, m_scores, m_domain_tiers, m_budget, m_legend, m_legend_topology, m_facts, m_index, m_goals)}

_C = ", ".join(f"'{c}'" for c in CENTERS)
_HUBS = f"""WITH RECURSIVE {REL}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM rel UNION ALL SELECT target FROM rel) GROUP BY id),
  o AS (SELECT list_sort(list(degree)) AS l FROM deg), cap AS (SELECT greatest(20 * l[len(l) // 2 + 1], 25) AS cap FROM o), hubs AS (SELECT id, degree FROM deg, cap WHERE degree > cap)"""


def _two_hops(stop: str) -> str:
    return f"""SELECT DISTINCT source, predicate, target, provenance FROM rel WHERE source IN ({_C}) OR target IN ({_C})
      OR source IN (SELECT id FROM (SELECT source AS id FROM rel WHERE target IN ({_C}) UNION SELECT target FROM rel WHERE source IN ({_C})) WHERE {stop})
      OR target IN (SELECT id FROM (SELECT source AS id FROM rel WHERE target IN ({_C}) UNION SELECT target FROM rel WHERE source IN ({_C})) WHERE {stop})"""


_NEAR = _two_hops("id NOT IN (SELECT id FROM hubs)")
_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in DOMAINS.items())
_SCORED = f"""{ENT}, sc0 AS (SELECT *, try_cast(regexp_replace(nullif(last_touched, ''), 'Z$', '') AS timestamp) AS hit_at, coalesce(list_max(list_transform(coalesce(domains, []), lambda x: CASE x {_W} ELSE 0 END)), 0)::double AS dw FROM ent),
  sc1 AS (SELECT *, 0.4::double * (CASE WHEN hit_at IS NULL THEN 0 ELSE power(0.5::double, greatest(0, ({NOW_US} - epoch_us(hit_at)) / 86400000000.0::double) / 90.0::double) END) + 0.3::double * (CASE impact WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END)::double + 0.2::double * dw AS s FROM sc0),
  sc2 AS (SELECT *, round(CASE WHEN status IN ('superseded', 'achieved', 'dropped') THEN s * 0.3::double WHEN type = 'goal' OR (type = 'doc' AND impact = 'high') THEN greatest(s, 0.55::double) ELSE s END, 6) AS score FROM sc1),
  scored AS (SELECT *, CASE WHEN score >= 0.55 THEN 'hot' WHEN score >= 0.30 THEN 'warm' ELSE 'cold' END AS tier FROM sc2)"""
_COST = r"""greatest(1, floor(coalesce(list_sum(list_transform(regexp_extract_all(line, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN ceil(length(r) / 3.0) ELSE 1 END)), 0) * 1.2))::bigint"""



def rounds(log: str = "log", rel: str = "rel") -> str:
    """CTEs that grow ``n0`` (``node``) by three rounds in the order of the log into ``topic`` (``id``)."""
    out = f"""rfs AS (SELECT id AS event_id, {cid('r.id')} AS node FROM (SELECT id, unnest(refs) AS r FROM {log}) WHERE r.kind IN {graph.NODE_REF_KINDS} AND {cid('r.id')} IS NOT NULL), brings AS (SELECT * FROM rfs UNION SELECT id, id FROM {log}),
      drl AS (SELECT id AS event_id, unnest(derived_relations) AS r FROM {log}), touch AS (SELECT event_id, node, row(ts, event_id) AS pos FROM (SELECT id AS event_id, id AS node FROM {log} UNION SELECT event_id, node FROM rfs UNION SELECT event_id, {cid('r.source')} FROM drl WHERE r.predicate IN {graph.TEMPORAL} UNION SELECT event_id, {cid('r.target')} FROM drl WHERE r.predicate IN {graph.TEMPORAL} UNION SELECT id, {cid('x')} FROM (SELECT id, unnest(supersedes) AS x FROM {log})) t JOIN (SELECT id, ts FROM {log}) l ON l.id = t.event_id WHERE node IS NOT NULL),
      tmp AS (SELECT source AS s, target AS t FROM {rel} WHERE predicate IN {graph.TEMPORAL} UNION SELECT target, source FROM {rel} WHERE predicate IN {graph.TEMPORAL})"""
    for k in (1, 2, 3):
        out += f""", e{k} AS (SELECT event_id, pos FROM touch WHERE node IN (SELECT node FROM n{k - 1}) UNION SELECT t.event_id, t.pos FROM e{k} e JOIN brings b ON b.event_id = e.event_id JOIN touch t ON t.node = b.node AND t.pos > e.pos),
      g{k} AS (SELECT node FROM n{k - 1} UNION SELECT node FROM brings WHERE event_id IN (SELECT event_id FROM e{k})), n{k} AS (SELECT node FROM g{k} UNION SELECT t FROM tmp WHERE s IN (SELECT node FROM g{k}))"""
    return out + f", topic AS (SELECT id FROM {log} WHERE id IN (SELECT node FROM n3))"


SQL = {
    "g_hubs": f"{_HUBS} SELECT id, degree FROM hubs",
    "g_subgraph": f"{_HUBS} {_NEAR}",
    "g_held_back": f"{_HUBS} SELECT (SELECT count(*) FROM ({_NEAR})) AS shown, (SELECT count(*) FROM ({_two_hops('true')})) - (SELECT count(*) FROM ({_NEAR})) AS held",
    "g_alias_roots": f"""WITH RECURSIVE am AS (SELECT {cid('alias')} AS alias, arg_min({cid('canonical')}, row_id) AS canonical FROM alias_links WHERE is_match AND {cid('alias')} <> {cid('canonical')} GROUP BY 1),
      walk AS (SELECT alias, [alias] AS seen, canonical AS nxt FROM am UNION ALL SELECT w.alias, list_append(w.seen, w.nxt), a.canonical FROM walk w JOIN am a ON a.alias = w.nxt WHERE NOT list_contains(w.seen, w.nxt))
      SELECT alias, nxt AS canonical FROM (SELECT alias, arg_max(nxt, len(seen)) AS nxt FROM walk GROUP BY alias) WHERE alias <> nxt""",
    "g_profile_candidates": f"""WITH {ENT}, {REL}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM rel UNION ALL SELECT target FROM rel) GROUP BY id), ev AS (SELECT id, len(list_distinct(source_events)) AS n_events FROM ent)
      SELECT ent.id, ent.type, n_events, coalesce(degree, 0) AS degree, coalesce(degree, 0) + n_events AS weight FROM ent JOIN ev USING (id) LEFT JOIN deg USING (id) WHERE type <> 'secret-ref' AND n_events >= 3 ORDER BY weight DESC, id LIMIT 12""",
    "g_temporal_events": f"WITH RECURSIVE {LOG}, {REL}, n0 AS (SELECT unnest([{_C}]) AS node), {rounds()} SELECT id FROM topic",
    "m_scores": f"WITH {_SCORED} SELECT id, score, tier FROM scored",
    "m_domain_tiers": f"""WITH {_SCORED}, x AS (SELECT id, score, tier, unnest(CASE WHEN len(domains) > 0 THEN domains ELSE ['general'] END) AS raw FROM scored), y AS (SELECT *, coalesce(nullif({slug('raw')}, ''), 'general') AS domain FROM x)
      SELECT domain, count(*) AS n_entities, sum((tier = 'hot')::bigint)::bigint AS n_hot, max(score) AS best FROM y GROUP BY domain""",
    "m_budget": f"""WITH RECURSIVE {_SCORED}, l AS (SELECT id, type, score, '- **' || id || '** (' || type || CASE WHEN impact = 'high' THEN ', impact=high' ELSE '' END || '): ' || coalesce(nullif(description, ''), name) AS line FROM scored),
      c AS (SELECT id, {_COST} AS cost, row_number() OVER (ORDER BY -score, type, id) AS rn FROM l),
      w AS (SELECT 0::bigint AS rn, {SMALL_BUDGET}::bigint AS room, ''::varchar AS id, 0::bigint AS cost, false AS kept UNION ALL SELECT c.rn, CASE WHEN c.cost <= w.room THEN w.room - c.cost ELSE w.room END, c.id, c.cost, c.cost <= w.room FROM w JOIN c ON c.rn = w.rn + 1)
      SELECT id, cost, kept FROM w WHERE rn > 0""",
    "m_legend": f"""WITH {ENT}, {LOG}, c AS (SELECT id, unnest(source_events[-2:]) AS event_id FROM ent WHERE len(source_events) > 0), n AS (SELECT event_id, count(*) AS n, min(id) AS first_id FROM c WHERE event_id IN (SELECT id FROM log) GROUP BY event_id HAVING count(*) >= 2)
      SELECT event_id, n, row_number() OVER (ORDER BY first_id, event_id) AS tag FROM n""",
    "m_legend_topology": f"""WITH {ENT}, {LOG}, {REL}, e AS (SELECT id, unnest(source_events[-2:]) AS event_id FROM ent WHERE len(source_events) > 0), ends AS (SELECT id FROM ent WHERE regexp_matches(id, '^(svc|ext)-')),
      c AS (SELECT event_id, false AS r, id AS f FROM e UNION ALL SELECT provenance, true, source || ' ' || predicate || ' ' || target FROM rel WHERE source IN (SELECT id FROM ends) AND target IN (SELECT id FROM ends)),
      n AS (SELECT event_id, count(*) AS n, min(f) FILTER (NOT r) AS first_id, min(f) AS first_rel FROM c WHERE event_id IN (SELECT id FROM log) GROUP BY event_id HAVING count(*) >= 2)
      SELECT event_id, n, row_number() OVER (ORDER BY first_id IS NULL, coalesce(first_id, first_rel), event_id) AS tag FROM n""",
    "m_facts": f"""WITH {ENT}, f AS (SELECT id, unnest(key_facts) AS fact, generate_subscripts(key_facts, 1) AS pos FROM ent), k AS (SELECT *, lower(trim(split_part(fact, ':', 1))) AS key FROM f WHERE fact IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id, key) AS n FROM k WHERE key NOT IN ('extensions', 'adapter')) SELECT id, key, nth, fact, greatest(n - 2, 0) AS more FROM r WHERE nth <= 2""",
    "m_index": f"WITH {_SCORED} SELECT id, '- [' || tier || '] ' || id || ' (' || type || ')' || CASE WHEN status = 'superseded' THEN ' (superseded)' ELSE '' END || ': ' || coalesce(nullif(description, ''), name) AS line FROM scored",
    "m_goals": f"WITH {ENT} SELECT id, status, coalesce(nullif(description, ''), name) AS label FROM ent WHERE type = 'goal'",
}
