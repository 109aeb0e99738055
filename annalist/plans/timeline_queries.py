"""Histories of topics over the whole log, and event-time windows."""

from __future__ import annotations

from annalist.functions import text as T
from annalist.operators import store, timeline
from annalist.plans import fold_queries
from annalist.plans.graph_queries import rounds
from annalist.plans.sqlkit import STOP, cid, toks, wds
from annalist.session import table
from annalist.streaming.ingest import sessions, windowed

TEXT = "sienna anchor"


def _run(s, d, as_of=""):
    return timeline.timeline(store.event_log(table(s, d, "event_log")), TEXT, as_of=as_of)


def t_rows(s, d):
    return _run(s, d)["rows"]


def t_verdicts(s, d):
    return _run(s, d)["verdicts"]


def t_rows_asof(s, d):
    return _run(s, d, "2024-06-30")["rows"]


def w_daily(s, d):
    w = windowed(table(s, d, "events"), "ts", ["event_type"], "1 day")
    return w.selectExpr("date_format(from_, 'yyyy-MM-dd') AS day", "event_type", "n")


def w_sessions(s, d):
    w = sessions(table(s, d, "events"), "ts", ["user_id"], "2 hours")
    return w.selectExpr("user_id", "date_format(from_, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS began", "n")




def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql(select: str, as_of: str = "") -> str:
    """The history of TEXT in SQL: matching, growth in log order, changes of states, rows; ``select`` ends it."""
    q = T.query_tokens(TEXT)
    phrases = _in(" ".join(q[i : i + n]) for n in range(1, len(q) + 1) for i in range(len(q) - n + 1))
    stems = "[" + ", ".join(f"'{w}'" for w in T.query_words(TEXT)) + "]"
    why = f"regexp_replace(trim(summary || chr(10) || body), '{timeline.BOILERPLATE}', '')"
    said = f"regexp_replace(trim(CASE WHEN summary <> '' THEN summary ELSE body END), '{timeline.BOILERPLATE}', '')"
    word = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    fact = "regexp_extract(coalesce(list_filter(coalesce(e.profile.key_facts, []), lambda f: starts_with(f, 'status='))[1], ''), '^status=(.*?)(?: as of .*)?$', 1)"
    m = "(SELECT list(id) FROM matched)"
    fold = fold_queries._sql("", as_of).replace("WITH log AS", "WITH RECURSIVE log AS", 1)
    return rf"""{fold}, gents AS ({fold_queries._ENTITIES}), grel AS (SELECT source, predicate, target FROM edges GROUP BY ALL),
    al AS (SELECT DISTINCT id, alias FROM (SELECT a.id, unnest(list_concat(a.aliases, CASE WHEN a.name <> core.name AND a.o > core.first AND a.name <> '' THEN [a.name] ELSE [] END)) AS alias FROM a JOIN core USING (id)) WHERE alias IS NOT NULL),
    names AS (SELECT id, unnest([id, name]) AS name FROM core UNION ALL SELECT id, alias FROM al), voc AS (SELECT token, count(*) AS n FROM (SELECT unnest({wds('name')}) AS token FROM names UNION ALL SELECT unnest({wds('title')}) AS token FROM lg) GROUP BY token),
    mb AS (SELECT id, row_number() OVER () AS k, lower(name) AS nl, array_to_string({toks('name')}, ' ') IN {phrases} AS phrase, list_distinct(list_filter({toks('name')}, lambda x: x NOT IN {STOP})) AS own FROM names), mc AS (SELECT *, list_filter(own, lambda x: x IN {_in(w for w in q if w not in T.STOPWORDS)}) AS hit FROM mb),
    mw AS (SELECT token, ln(1 + n::double / df) / ln(1 + n::double) AS w FROM (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(hit) AS token FROM mc WHERE NOT phrase) GROUP BY token), (SELECT greatest(1, count(*)) AS n FROM core)),
    ms AS (SELECT c.id, sum(mw.w) + any_value(len(hit))::double / any_value(len(own)) / 100 AS score FROM (SELECT k, id, hit, own, unnest(hit) AS token FROM mc WHERE NOT phrase) c JOIN mw USING (token) GROUP BY c.id, k UNION ALL SELECT id, 3.0 + length(nl)::double / 100 FROM mc WHERE phrase),
    matched AS (SELECT id FROM (SELECT id, round(max(score), 6) AS score FROM ms GROUP BY id) ORDER BY score DESC, id LIMIT 5),
    tt AS (SELECT id, ts, unnest(list_distinct({toks('title')})) AS token FROM lg), tf AS (SELECT token, count(*) AS tf FROM tt WHERE length(token) >= 3 AND token NOT IN {STOP} GROUP BY token), th AS (SELECT tt.*, x.stem FROM tt, (SELECT unnest({stems}) AS stem) x WHERE contains(tt.token, x.stem)),
    tp AS (SELECT id, ts, stem, max(1.0 / coalesce(voc.n, 1)) AS w, max(coalesce(tf.tf, 1) <= 3) AS rare FROM th LEFT JOIN voc USING (token) LEFT JOIN tf USING (token) GROUP BY id, ts, stem),
    titled AS (SELECT id FROM (SELECT id, ts, round(sum(w), 6) AS score, max(rare) AS rare FROM tp GROUP BY id, ts HAVING count(*) >= {min(2, len(T.query_words(TEXT)))}) WHERE rare ORDER BY score DESC, ts DESC, id DESC LIMIT 5),
    n0 AS (SELECT id AS node FROM matched UNION SELECT id FROM titled UNION SELECT event_id FROM touched WHERE id IN (SELECT id FROM matched)), {rounds('lg', 'grel')},
    seq AS (SELECT lg.*, coalesce(list_transform(derived_relations, lambda r: {{'predicate': r.predicate, 'source': coalesce({cid('r.source')}, ''), 'target': coalesce({cid('r.target')}, '')}}), []) AS es, coalesce(list_filter(coalesce(refs, []), lambda r: r.kind = 'commit')[1].id, list_filter(coalesce(refs, []), lambda r: r.kind = 'pr')[1].id, id) AS citation,
      coalesce({cid('derived_entities[1].id')}, id) AS prim, list_distinct(list_transform(list_filter(coalesce(refs, []), lambda r: r.kind = 'commit'), lambda r: r.id)) AS shas FROM lg WHERE id IN (SELECT id FROM topic) OR id IN (SELECT id FROM titled)),
    s AS (SELECT *, list_filter(es, lambda r: r.predicate = 'reverts')[1].target AS undone FROM seq),
    de AS (SELECT id, ts, type = 'plan' AS plan, unnest(derived_entities) AS e, generate_subscripts(derived_entities, 1) AS pos FROM s), created AS (SELECT {cid('e.id')} AS eid, min(row(ts, id)) AS born, min(row(ts, id))[2] AS created FROM de WHERE {cid('e.id')} IS NOT NULL GROUP BY 1),
    su AS (SELECT id, ts, trust, {cid('x')} AS eid FROM (SELECT id, ts, trust, unnest(supersedes) AS x FROM s)),
    ops0 AS (SELECT {cid('e.id')} AS eid, ts, id, 0 AS phase, coalesce(nullif(e.status, ''), 'active') AS status, plan, pos FROM de UNION ALL SELECT su.eid, ts, id, 1, 'superseded', false, 0 FROM su JOIN created USING (eid) WHERE born <= row(ts, id) AND trust <> 'low'),
    ops1 AS (SELECT o.*, row(o.ts, o.id) = born AND phase = 0 AS first FROM ops0 o JOIN created USING (eid) WHERE eid IN (SELECT id FROM matched)), ops2 AS (SELECT *, CASE WHEN status <> 'active' OR first THEN status END AS put FROM ops1 WHERE status <> 'active' OR plan OR first),
    ops3 AS (SELECT *, last_value(put IGNORE NULLS) OVER (PARTITION BY eid ORDER BY ts, id, phase, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ops2), ops4 AS (SELECT *, CASE WHEN status = 'active' AND plan AND before IN ('achieved', 'dropped') THEN 'active' ELSE put END AS step FROM ops3),
    ops5 AS (SELECT *, last_value(step IGNORE NULLS) OVER (PARTITION BY eid ORDER BY ts, id, phase, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM ops4),
    per AS (SELECT id, eid, arg_min(old, row(phase, pos)) AS old, arg_max(step, row(phase, pos)) AS new FROM ops5 WHERE step IS NOT NULL AND old IS NOT NULL AND step <> old GROUP BY id, eid), changed AS (SELECT id, min(row(eid, old, new)) AS c FROM per WHERE old <> new GROUP BY id),
    bn AS (SELECT created AS id, list(eid) AS born FROM created WHERE eid IN (SELECT id FROM matched) GROUP BY 1), gone AS (SELECT DISTINCT undone AS sha FROM s WHERE undone <> ''),
    d AS (SELECT s.*, c, born, {m} AS ms, list_has_any(shas, coalesce((SELECT list(sha) FROM gone), [])) AS was, undone IN (SELECT citation FROM s) AS on_row, trim(regexp_extract(title, '(?i)\breverted\s+(.+)$', 1)) AS what,
      coalesce(list_filter(list_transform(string_split({said}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line,
      length(array_to_string(list_filter(regexp_split_to_array(trim({why}), '\s+'), lambda w: len(list_filter({word.format('w')}, lambda t: NOT list_contains({word.format('title')}, t))) > 0), ' ')) < 20 AS silent,
      (SELECT {cid('e.id')} || ' = ' || CASE WHEN {fact} <> '' THEN {fact} ELSE e.status END FROM (SELECT unnest(derived_entities) AS e, generate_subscripts(derived_entities, 1) AS pos) WHERE {fact} <> '' OR coalesce(e.status, '') <> '' ORDER BY pos LIMIT 1) AS note FROM s LEFT JOIN changed USING (id) LEFT JOIN bn USING (id)),
    d2 AS (SELECT *, list_filter(es, lambda r: (r.predicate = 'supersedes' AND list_contains(ms, r.target) AND r.source <> r.target) OR (r.predicate = 'superseded_by' AND list_contains(ms, r.source) AND r.source <> r.target))[1] AS by_,
      list_filter(es, lambda r: (r.predicate = 'supersedes' AND list_contains(ms, r.source)) OR (r.predicate = 'caused_by' AND (list_contains(ms, r.source) OR list_contains(ms, r.target))))[1] AS over_,
      len(list_filter(coalesce(supersedes, []), lambda x: list_contains(ms, {cid('x')}))) > 0 AS named, array_to_string(list_filter([what, line], lambda x: x <> ''), ': ') AS told FROM d),
    d3 AS (SELECT *, CASE WHEN undone IS NOT NULL THEN 'REVERTED' WHEN was THEN 'added' WHEN by_ IS NOT NULL OR named THEN 'SUPERSEDED' WHEN over_.predicate = 'supersedes' THEN 'supersedes' WHEN over_.predicate = 'caused_by' THEN 'caused_by' WHEN c IS NOT NULL THEN 'status' WHEN born IS NOT NULL THEN 'added' WHEN note IS NOT NULL THEN 'status' ELSE type END AS action,
      replace(CASE WHEN undone IS NOT NULL THEN CASE WHEN told <> '' THEN told ELSE title END || CASE WHEN undone <> '' AND NOT on_row THEN ' (undoes ' || undone || ')' ELSE '' END WHEN was THEN title
        WHEN by_ IS NOT NULL THEN 'by ' || CASE WHEN by_.predicate = 'supersedes' THEN by_.source ELSE by_.target END || CASE WHEN by_.predicate = 'supersedes' AND coalesce(list_contains(born, by_.target), false) THEN ' (at creation)' ELSE '' END || ': ' || title
        WHEN named THEN 'by ' || prim || ': ' || title WHEN over_.predicate = 'supersedes' THEN over_.target || ': ' || title WHEN over_.predicate = 'caused_by' THEN over_.source || ' caused by ' || over_.target || ': ' || title
        WHEN c IS NOT NULL THEN c[1] || ': ' || c[2] || ' -> ' || c[3] WHEN born IS NOT NULL THEN title WHEN note IS NOT NULL THEN note ELSE title END, chr(10), ' ') AS det FROM d2)
    {select}"""


_ROWS = "SELECT ts, id, action, CASE WHEN length(det) > 62 THEN substr(det, 1, 59) || '...' ELSE det END AS detail, citation, silent AND action IN ('REVERTED', 'SUPERSEDED') AS no_reason FROM d3"
_VERDICTS = f""", ve AS (SELECT id AS eid, status, superseded_by FROM gents WHERE id IN (SELECT id FROM matched)), own AS (SELECT t.id AS eid, max(row(s.ts, s.id, citation)) AS own FROM touched t JOIN s ON s.id = t.event_id WHERE t.id IN (SELECT id FROM matched) GROUP BY 1),
    move AS (SELECT c[1] AS eid, max(row(ts, s.id, citation)) AS moved FROM changed JOIN s USING (id) GROUP BY 1),
    went AS (SELECT row(ts, id, citation) AS x, {cid('t')} AS eid, prim AS who FROM (SELECT *, unnest(supersedes) AS t FROM s) UNION ALL SELECT row(ts, id, citation), CASE WHEN g.predicate = 'supersedes' THEN g.target ELSE g.source END, CASE WHEN g.predicate = 'supersedes' THEN g.source ELSE g.target END FROM (SELECT *, unnest(es) AS g FROM s) WHERE g.predicate IN ('supersedes', 'superseded_by')),
    sup1 AS (SELECT eid, arg_min(x, row(who <> superseded_by, x[1], x[2])) AS sup FROM went JOIN ve USING (eid) GROUP BY eid), one AS (SELECT eid, shas[1] AS sha FROM created JOIN s ON s.id = created.created WHERE eid IN (SELECT id FROM matched) AND len(shas) = 1),
    rev AS (SELECT eid, max(row(ts, id, citation)) AS rev FROM one JOIN s ON undone <> '' AND substr(undone, 1, 7) = substr(sha, 1, 7) AND (starts_with(undone, sha) OR starts_with(sha, undone)) GROUP BY eid),
    v AS (SELECT *, (SELECT max(row(ts, id, citation)) FROM s) AS latest FROM ve LEFT JOIN own USING (eid) LEFT JOIN move USING (eid) LEFT JOIN sup1 USING (eid) LEFT JOIN rev USING (eid)),
    lines AS (SELECT eid, CASE WHEN status = 'superseded' THEN 'SUPERSEDED' WHEN rev IS NOT NULL THEN 'NOT PRESENT' ELSE upper(status) END AS state, CASE WHEN status = 'superseded' THEN coalesce(sup, moved, own, latest) WHEN rev IS NOT NULL THEN rev ELSE coalesce(moved, own, latest) END AS at_, CASE WHEN status = 'superseded' THEN superseded_by ELSE '' END AS by_, '' AS what FROM v),
    topic_line AS (SELECT '' AS eid, 'NOT PRESENT' AS state, row(ts, id, citation) AS at_, '' AS by_, CASE WHEN what <> '' THEN what ELSE title END AS what FROM d WHERE id IN (SELECT id FROM titled) AND undone IS NOT NULL AND id NOT IN (SELECT rev[2] FROM v WHERE status <> 'superseded' AND rev IS NOT NULL) ORDER BY ts DESC, id DESC LIMIT 1)
    SELECT eid AS id, state, at_[1] AS ts, at_[3] AS citation, by_ AS by, CASE WHEN length(what) > 62 THEN substr(what, 1, 59) || '...' ELSE what END AS what FROM (SELECT * FROM lines UNION ALL SELECT * FROM topic_line)"""

QUERIES = {f.__name__: f for f in (t_rows, t_verdicts, t_rows_asof, w_daily, w_sessions)}
SQL = {
    "t_rows": _sql(_ROWS),
    "t_rows_asof": _sql(_ROWS, "2024-06-30"),
    "t_verdicts": _sql(_VERDICTS),
    "w_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "w_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
      SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS began, count(*) AS n FROM y GROUP BY user_id, k""",
}
