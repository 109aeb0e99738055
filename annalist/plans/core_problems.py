"""Queries of the general data problems over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.operators import asof, hierarchy, history, instants, orphans
from annalist.functions import zones
from annalist.plans.sqlkit import FMT_US, FORMATS, PREFIX, WS, cid, instant_cte
from annalist.session import cut, scratch_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return asof.found(table(spark, d, "event_log"), [table(spark, d, "entity_states"), table(spark, d, "map_states")], table(spark, d, "source_formats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    store = history.HistoryStore(spark, scratch_path(spark, "history"))
    return history.found(store, table(spark, d, "event_log"), table(spark, d, "source_formats"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found(table(spark, d, "entities"), table(spark, d, "event_log"))


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    full, _ = hierarchy.nested_sets(hierarchy.links(table(spark, d, "entities"), table(spark, d, "event_log")))
    return full.select("id", "root_id", "lft", "rgt", "n_descendants")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*[table(spark, d, t) for t in ("relations", "event_log", "entities", "map_entities", "documents", "commits")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_orphans(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.found(table(spark, d, "event_log"), table(spark, d, "relations"), table(spark, d, "source_formats"))


def p7_masks(spark: SparkSession, d: str) -> DataFrame:
    return instants.masks(table(spark, d, "event_log"), table(spark, d, "relations"), table(spark, d, "source_formats"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return cut(hierarchy.nested_sets(cut(hierarchy.links(table(spark, d, "entities"), table(spark, d, "event_log")), "links"))[0], "sets")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_sets(spark, d))


def p5_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(_sets(spark, d)).select("id", "ancestor_id")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p5_found, p5_ranges, p5_descendants, p5_ancestors, p6_found, p6_report, p7_found, p7_masks)}

_E = instant_cte("ei", "SELECT e.*, fo.zone, fo.date_order AS ord FROM event_log e LEFT JOIN fo ON fo.source = lower(nullif(trim(e.source), ''))")
_SRC = f"src AS (SELECT {cid('id')} AS id, min(lower(nullif(trim(source), ''))) AS source FROM event_log GROUP BY 1)"
_R = instant_cte("ri", f"SELECT r.row_id, r.ts, fo.zone, fo.date_order AS ord FROM relations r LEFT JOIN src ON src.id = {cid('r.provenance')} LEFT JOIN fo ON fo.source = src.source")
_CANON = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$'"
_WALK = f"""ent AS (SELECT {cid('id')} AS id, arg_min({cid('superseded_by')}, row_id) FILTER (WHERE {cid('superseded_by')} IS NOT NULL) AS p FROM entities GROUP BY 1),
  ev AS (SELECT {cid('c')} AS id, arg_min({cid('p')}, row(seen_at, row_id)) FILTER (WHERE {cid('p')} IS NOT NULL) AS p FROM (SELECT unnest(supersedes) AS c, derived_entities[1].id AS p, seen_at, row_id FROM event_log) GROUP BY 1),
  par AS (SELECT coalesce(ent.id, ev.id) AS id, coalesce(ent.p, ev.p) AS p FROM ent FULL OUTER JOIN ev ON ev.id = ent.id WHERE coalesce(ent.p, ev.p) IS NOT NULL AND coalesce(ent.id, ev.id) IS NOT NULL),
  nodes AS (SELECT id FROM par UNION SELECT p FROM par),
  walk AS (SELECT id, [id] AS path, id AS top FROM nodes UNION ALL SELECT w.id, list_prepend(par.p, w.path), par.p FROM walk w JOIN par ON par.id = w.top WHERE NOT list_contains(w.path, par.p)),
  last AS (SELECT id, arg_max(path, len(path)) AS path, arg_max(top, len(path)) AS top FROM walk GROUP BY id)"""
_P6 = f"""keys AS (SELECT 'entity:' || {cid('id')} AS key, seen_at, coalesce(removed_at, TIMESTAMP '9999-12-31') AS gone FROM entities UNION ALL SELECT 'entity:' || {cid('id')}, seen_at, coalesce(removed_at, TIMESTAMP '9999-12-31') FROM map_entities
    UNION ALL SELECT 'event:' || {cid('id')}, seen_at, TIMESTAMP '9999-12-31' FROM event_log UNION ALL SELECT 'doc:' || {cid('path')}, seen_at, TIMESTAMP '9999-12-31' FROM documents
    UNION ALL SELECT 'commit:' || {cid('sha')}, seen_at, TIMESTAMP '9999-12-31' FROM commits UNION ALL SELECT 'commit:' || substr({cid('sha')}, 1, 12), seen_at, TIMESTAMP '9999-12-31' FROM commits),
  par AS (SELECT key, min(seen_at) AS born, max(gone) AS gone FROM keys WHERE key IS NOT NULL GROUP BY key),
  ends AS (SELECT 'relations' AS tbl, row_id, unnest(['source', 'target']) AS field, unnest([{cid('source')}, {cid('target')}]) AS x, seen_at FROM relations),
  ref0 AS (SELECT tbl, row_id, field, x, CASE WHEN regexp_matches(x, {PREFIX}) THEN 'entity:' || x WHEN starts_with(x, 'evt-') THEN 'event:' || x END AS key, seen_at FROM ends
    UNION ALL SELECT 'event_log', row_id, 'refs', {cid('r.id')}, CASE {cid('r.kind')} WHEN 'entity' THEN 'entity:' WHEN 'adr' THEN 'entity:' WHEN 'event' THEN 'event:' WHEN 'doc' THEN 'doc:' WHEN 'commit' THEN 'commit:' END || {cid('r.id')}, seen_at FROM (SELECT row_id, seen_at, unnest(refs) AS r FROM event_log)
    UNION ALL SELECT 'entities', row_id, 'source_events', {cid('r')}, 'event:' || {cid('r')}, seen_at FROM (SELECT row_id, seen_at, unnest(source_events) AS r FROM entities)),
  bad AS (SELECT DISTINCT tbl, row_id, field, x AS missing_id, CASE WHEN born IS NULL THEN 'missing' WHEN field = 'source_events' THEN NULL WHEN born > seen_at THEN 'late' WHEN gone <= seen_at THEN 'deleted' END AS reason, coalesce(strftime(seen_at, '%Y-%m'), '') AS period FROM ref0 LEFT JOIN par USING (key) WHERE key IS NOT NULL)"""

SQL = {
    "p2_found": f"""WITH {FORMATS}, {_E}, at AS (SELECT {cid('id')} AS id, min(us) AS us FROM ei WHERE us IS NOT NULL GROUP BY 1), rf AS (SELECT DISTINCT {cid('id')} AS event_id, {cid('r.id')} AS entity_id FROM (SELECT id, us, unnest(refs) AS r FROM ei WHERE us IS NOT NULL) WHERE {cid('r.kind')} = 'entity' AND {cid('r.id')} IS NOT NULL),
      st AS (SELECT {cid('id')} AS id, trim(status) AS status, coalesce({cid('superseded_by')}, '') AS by_, epoch_us(valid_from) AS v, epoch_us(seen_at) AS s, row_id FROM (SELECT * FROM entity_states UNION ALL SELECT * FROM map_states) WHERE nullif(trim(status), '') IS NOT NULL AND valid_from IS NOT NULL AND seen_at IS NOT NULL)
      SELECT event_id, entity_id, arg_max(status, row(v, s, row_id)) AS status, arg_max(by_, row(v, s, row_id)) AS superseded_by FROM rf JOIN "at" ON "at".id = rf.event_id JOIN st ON st.id = rf.entity_id AND st.v <= us AND st.s <= us GROUP BY event_id, entity_id""".replace(", at AS (", ', "at" AS ('),
    "p3_found": f"""WITH {FORMATS}, {_E}, said AS (SELECT {cid('e.id')} AS id, us, {cid('id')} AS ev, nullif(trim(e.status), '') AS status, '' AS by_ FROM (SELECT id, us, unnest(derived_entities) AS e FROM ei WHERE us IS NOT NULL) UNION ALL SELECT {cid('s')}, us, {cid('id')}, 'superseded', coalesce({cid('d')}, '') FROM (SELECT id, us, unnest(supersedes) AS s, derived_entities[1].id AS d FROM ei WHERE us IS NOT NULL)),
      held AS (SELECT id, us, max(row(ev, status, by_)) AS h FROM said WHERE id IS NOT NULL AND status IS NOT NULL GROUP BY id, us), x AS (SELECT id, us, h[2] AS status, h[3] AS by_, lag(row(h[2], h[3])) OVER (PARTITION BY id ORDER BY us) AS prev FROM held),
      v AS (SELECT id, us, status, by_, lead(us) OVER (PARTITION BY id ORDER BY us) AS nxt FROM x WHERE prev IS NULL OR prev <> row(status, by_))
      SELECT id, {FMT_US.format('us')} AS valid_from, coalesce({FMT_US.format('nxt')}, '') AS valid_to, status, by_ AS superseded_by FROM v""",
    "p5_found": f"WITH RECURSIVE {_WALK} SELECT last.id, CASE WHEN par.id IS NULL THEN path[1] ELSE '' END AS root_id, CASE WHEN par.id IS NULL THEN len(path) - 1 ELSE -1 END AS depth, CASE WHEN par.id IS NULL THEN array_to_string(path, '>') ELSE '' END AS path FROM last LEFT JOIN par ON par.id = last.top",
    "p5_ranges": f"""WITH RECURSIVE {_WALK}, t AS (SELECT last.id, path[1] AS root_id, path FROM last LEFT JOIN par ON par.id = last.top WHERE par.id IS NULL), a AS (SELECT x, count(*) - 1 AS n FROM (SELECT unnest(path) AS x FROM t) GROUP BY x),
      r AS (SELECT t.*, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS lft FROM t) SELECT r.id, root_id, lft, lft + n AS rgt, n AS n_descendants FROM r JOIN a ON a.x = r.id""",
    "p5_descendants": f"WITH RECURSIVE {_WALK}, t AS (SELECT last.id, unnest(path) AS up FROM last LEFT JOIN par ON par.id = last.top WHERE par.id IS NULL) SELECT up AS id, id AS descendant_id FROM t WHERE up <> id",
    "p5_ancestors": f"WITH RECURSIVE {_WALK}, t AS (SELECT last.id, unnest(path) AS up FROM last LEFT JOIN par ON par.id = last.top WHERE par.id IS NULL) SELECT id, up AS ancestor_id FROM t WHERE up <> id",
    "p7_masks": rf"""WITH {FORMATS}, {_SRC}, {_E}, {_R}, x AS (SELECT 'event_log' AS tbl, ts, us FROM ei UNION ALL SELECT 'relations', ts, us FROM ri),
      m AS (SELECT tbl, us, regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(trim(ts, {WS}), '\s+', ' ', 'g'), '\[[^\]]+\]$', '[a]'), '[A-Za-z]+', 'a', 'g'), '012345678', '999999999'), '(:99:99|a999999)[.,]9+', '\1.f', 'g') AS k FROM x)
      SELECT tbl, coalesce(regexp_replace(regexp_replace(k, '(^|[^9])9([^9]|$)', '\1' || '99' || '\2', 'g'), '(^|[^9])9([^9]|$)', '\1' || '99' || '\2', 'g'), '') AS mask, count(*) AS n_rows, count(us) AS n_instants, '{zones.version()}' AS zone_version FROM m GROUP BY ALL""",
    "p6_found": f"WITH {_P6} SELECT tbl, row_id, field, missing_id, reason, period FROM bad WHERE reason IS NOT NULL",
    "p6_report": f"WITH {_P6} SELECT tbl, field, reason, period, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows, count(DISTINCT missing_id) AS n_ids FROM bad WHERE reason IS NOT NULL GROUP BY ALL",
    "p7_found": f"WITH {FORMATS}, {_SRC}, {_E}, {_R} SELECT tbl, row_id, {FMT_US.format('us')} AS ts_utc FROM (SELECT 'event_log' AS tbl, row_id, ts, us FROM ei UNION ALL SELECT 'relations', row_id, ts, us FROM ri) WHERE us IS NOT NULL AND NOT regexp_matches(ts, {_CANON})",
}
