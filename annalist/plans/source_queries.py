"""Commits, documents, directories, anchors and citations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import anchors, evalkit, store
from annalist.plans.sqlkit import ENT, LOG, WS, cid, slug
from annalist.session import table
from annalist.sources import commits as C
from annalist.sources import discover as D
from annalist.sources import documents as X

MIN_LINES = 30


def _commits(s, d):
    return C.commits(table(s, d, "commits"))


def _files(s, d):
    return table(s, d, "documents").select(F.coalesce("path", F.lit("")).alias("path"), "text", F.date_format("seen_at", "yyyy-MM-dd").alias("day"), F.col("source"))


def c_noise(s, d):
    return _commits(s, d).groupBy("repo", C.noise().alias("why")).agg(F.count(F.lit(1)).alias("n"))


def c_chunks(s, d):
    return C.chunks(_commits(s, d).where(C.noise() == ""), 50).select("sha", "repo", "chunk")


def c_watermark(s, d):
    """Chunks count as failed where they hold a commit without files."""
    k = C.chunks(_commits(s, d).where(C.noise() == ""), 50)
    w = C.watermark(k.groupBy("repo", "chunk").agg(F.min(F.coalesce(F.size("files") > 0, F.lit(False))).alias("done")))
    return w.withColumn("upto", F.coalesce("upto", F.lit(-1)))


def c_reverts(s, d):
    return C.reverts(_commits(s, d))


def c_repo_facts(s, d):
    return C.repo_facts(_commits(s, d))


def x_titles(s, d):
    f = _files(s, d)
    t = F.coalesce("text", F.lit(""))
    return f.select("path", X.title(t).alias("title"), F.md5(X.first_paragraph(t)).alias("paragraph_md5"), X.find_date(t).alias("found_date"), X.find_impact(t).alias("impact"))


def x_decisions(s, d):
    return X.decisions(_files(s, d)).select("path", "id", "ts", "title", "trust", "adr_id", "status")


def x_incidents(s, d):
    return X.incidents(_files(s, d)).select("path", "id", "ts", "title", "impact", "inc_id")


def d_directories(s, d):
    return D.directory_stats(_files(s, d).select("path")).select("dir", "here", "tree", "readmes", "has_index", "depth")


def d_candidates(s, d):
    return D.candidates(D.directory_stats(_files(s, d).select("path"))).select("dir", "tree", "reason", "adapter", "kind")


def d_outliers(s, d):
    f = _files(s, d).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return D.outliers(f, "dir", MIN_LINES)


def d_generated(s, d):
    return _files(s, d).select("path", D.generated_banner(F.concat(F.lit("<!-- "), F.coalesce("source", F.lit("")), F.lit(" @generated -->\n"), F.coalesce("text", F.lit("")))).alias("planted"), D.generated_banner(F.col("text")).alias("own"))


def _nodes(s, d):
    """Code nodes: the names of changed files, ending left out, per repo; services lend theirs to make links."""
    c = _commits(s, d).select("repo", F.explode("files").alias("f")).select("repo", F.regexp_replace(F.element_at(F.split("f", "/"), -1), r"\.[^.]*$", "").alias("name"))
    e = store.entities(table(s, d, "map_entities")).where("type = 'service'").select(F.concat(F.lit("repo-"), F.element_at(F.split("id", "-"), -1)).alias("repo"), F.concat(F.lit("Client of "), "name").alias("name"))
    return c.unionByName(e).distinct()


def a_anchors(s, d):
    return anchors.seed(store.entities(table(s, d, "map_entities")).unionByName(store.entities(table(s, d, "entities"))), _nodes(s, d))


def a_layers(s, d):
    return anchors.merged_layers(store.entities(table(s, d, "map_entities")).unionByName(store.entities(table(s, d, "entities")).where("type = 'service'")), store.entities(table(s, d, "entities")))


def e_citations(s, d):
    c = evalkit.citations(table(s, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "kind", "raw", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("last_line", F.lit(0)).alias("last_line"))


def _resolved(s, d):
    files = _commits(s, d).select(F.explode("files").alias("path")).distinct().select("path", F.lit(500).cast("bigint").alias("n_lines"))
    ids = store.entities(table(s, d, "entities")).select("id").unionByName(store.event_log(table(s, d, "event_log")).select("id"))
    return evalkit.resolved(evalkit.citations(table(s, d, "documents"), "doc_id", "text"), files, table(s, d, "commits").select("sha"), ids)


def e_resolved(s, d):
    return _resolved(s, d).select("doc_id", "kind", "raw", "resolved")


def e_report(s, d):
    return evalkit.report(_resolved(s, d))


def e_arms(s, d):
    runs = table(s, d, "doc_labels").join(table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang")), "doc_id")
    return evalkit.arm_table(runs, "rater", "lang", F.col("toxic") == 0)


QUERIES = {f.__name__: f for f in (c_noise, c_chunks, c_watermark, c_reverts, c_repo_facts, x_titles, x_decisions, x_incidents, d_directories, d_candidates, d_outliers, d_generated, a_anchors, a_layers, e_citations, e_resolved, e_report, e_arms)}

_COM = f"""com AS (SELECT {cid('sha')} AS sha, coalesce(date, '') AS date, coalesce(author, '') AS author, coalesce(subject, '') AS subject, files, coalesce(merge, false) AS merge, coalesce(repo, '') AS repo FROM commits WHERE {cid('sha')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {cid('sha')} ORDER BY seen_at DESC, row_id DESC) = 1)"""
_BOT = " OR ".join(f"contains(lower(author), '{b}')" for b in C.BOTS)
_LOCK = "(" + ", ".join(f"'{x}'" for x in C.LOCKFILES) + ")"
_DIRS = "[" + ", ".join(f"'{x}'" for x in C.MECHANICAL_DIRS) + "]"
_MECH = f"len(coalesce(files, [])) > 0 AND len(list_filter(files, lambda f: NOT (string_split(lower(f), '/')[-1] IN {_LOCK} OR len(list_intersect(string_split(lower(f), '/')[:-2], {_DIRS})) > 0))) = 0"
_NOISE = f"CASE WHEN merge THEN 'merge' WHEN {_BOT} THEN 'bot' WHEN regexp_matches(subject, '{C.CHORE}') OR coalesce({_MECH}, false) THEN 'mechanical' ELSE '' END"
_CHUNK = f"{_COM}, kept AS (SELECT * FROM com WHERE ({_NOISE}) = ''), chunked AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY substr(date, 1, 7), date, sha) - 1) // 50 AS chunk FROM kept)"
_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items())
_FILES = f"f AS (SELECT coalesce(path, '') AS path, text, coalesce(text, '') AS t, strftime(seen_at, '%Y-%m-%d') AS day, source, substr(sha1(coalesce(text, '')), 1, 12) AS digest FROM documents)"


def _field(name: str) -> str:
    return rf"""CASE WHEN regexp_extract(regexp_extract(t, '(?s)^---\n(.*?)\n---\n', 1), '(?im)^\s*{name}\s*:\s*["'']?(.*?)["'']?\s*$', 1) <> '' THEN regexp_extract(regexp_extract(t, '(?s)^---\n(.*?)\n---\n', 1), '(?im)^\s*{name}\s*:\s*["'']?(.*?)["'']?\s*$', 1) ELSE trim(regexp_extract(t, '(?im)^(?:[-*]\s*)?{name}\s*[:–]\s*(.+)$', 1)) END"""


_BODY = r"regexp_replace(t, '(?s)\A---\n.*?\n---\n', '')"
_TITLE = rf"""regexp_replace(CASE WHEN regexp_extract(regexp_extract(t, '(?s)^---\n(.*?)\n---\n', 1), '(?im)^\s*title\s*:\s*["'']?(.*?)["'']?\s*$', 1) <> '' THEN regexp_extract(regexp_extract(t, '(?s)^---\n(.*?)\n---\n', 1), '(?im)^\s*title\s*:\s*["'']?(.*?)["'']?\s*$', 1) ELSE trim(regexp_extract({_BODY}, '(?m)^#{{1,3}}\s+(.+)$', 1)) END, '(?i)^ADR[-\s]?\d*\s*[:.\-]\s*', '')"""


def _para(least: int) -> str:
    return rf"""coalesce(substr(regexp_replace(list_filter(list_transform(string_split({_BODY}, chr(10) || chr(10)), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13))), lambda b: b <> '' AND NOT starts_with(b, '#') AND length(b) > {least})[1], '\s+', ' ', 'g'), 1, 300), '')"""


_DATE = rf"CASE WHEN regexp_extract({_field('date')}, '(\d{{4}}-\d{{2}}-\d{{2}})', 1) <> '' THEN regexp_extract({_field('date')}, '(\d{{4}}-\d{{2}}-\d{{2}})', 1) ELSE regexp_extract(substr(t, 1, 500), '(\d{{4}}-\d{{2}}-\d{{2}})', 1) END"
_HAY = f"lower(CASE WHEN {_field('severity')} <> '' THEN {_field('severity')} ELSE substr(t, 1, 300) END)"
_IMPACT = "CASE WHEN " + " OR ".join(f"contains({_HAY}, '{w}')" for w in X.HIGH) + " THEN 'high' ELSE 'medium' END"
_STEM = r"CASE WHEN lower(string_split(path, '/')[-1]) IN ('readme.md', 'index.md') THEN coalesce(string_split(path, '/')[-2], '') ELSE regexp_replace(string_split(path, '/')[-1], '\.[^.]+$', '') END"
_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STATUS.items())
_OWN_STATUS = rf"CASE WHEN {_field('status')} <> '' THEN {_field('status')} ELSE trim(regexp_extract(t, '(?im)^#{{1,4}}\s+status\s*\n+([^\n#]+)', 1)) END"
_DAY = rf"regexp_extract({_field('date')}, '(\d{{4}}-\d{{2}}-\d{{2}})', 1)"
_UP = "list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/')))"
_SEEN = f"len(list_filter(string_split(path, '/')[:-2], lambda x: starts_with(x, '.') OR lower(x) IN {D.SKIP_DIRS})) = 0"
_STATS = rf"""dirs AS (SELECT path, string_split(path, '/')[-1] AS name, unnest({_UP}) AS dir FROM f WHERE {_SEEN}), stats AS (SELECT dir, sum(((name LIKE '%.md' OR name = 'README') AND (CASE WHEN dir = '.' THEN name = path ELSE dir || '/' || name = path END))::bigint)::bigint AS here, sum((name LIKE '%.md' OR name = 'README')::bigint)::bigint AS tree,
  sum((name = 'README')::bigint)::bigint AS readmes, bool_or(lower(name) IN {D.INDEX_FILES} AND (CASE WHEN dir = '.' THEN name = path ELSE dir || '/' || name = path END)) AS has_index, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END::bigint AS depth FROM dirs GROUP BY dir)"""
_CLASS = "CASE " + " ".join(f"WHEN replace(lower(string_split(dir, '/')[-1]), '_', '-') IN ({', '.join(repr(n) for n in names)}) THEN '{a}|{k}'" for a, k, _, names in D.KINDS) + " END"
_BAN = "(" + " OR ".join(f"contains(lower(x), '{m}')" for m in D.GENERATED) + ")"
_STRONG = "(" + " OR ".join(f"contains(lower(x), '{m}')" for m in D.STRONG) + ")"
_COMMENT = "(" + " OR ".join(f"starts_with(x, '{m}')" for m in D.COMMENTS) + ")"


def _banner(t: str) -> str:
    head = rf"list_filter(list_transform(string_split(regexp_replace({t}, '(?s)\A---\n.*?\n---', ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[:6]"
    return f"len(list_filter(list_transform({head}, lambda x, i: length(x) <= 200 AND {_BAN} AND ({_STRONG} OR i = 1 OR {_COMMENT})), lambda b: b)) > 0"


def _ents(t: str) -> str:
    return ENT.replace("ent AS", f"{t}_e AS").replace("FROM entities", f"FROM {t}")


_NODES = rf"""{_COM}, {_ents('map_entities')}, {_ents('entities')}, nodes AS (SELECT DISTINCT repo, name FROM (SELECT repo, regexp_replace(string_split(x, '/')[-1], '\.[^.]*$', '') AS name FROM (SELECT repo, unnest(files) AS x FROM com)
  UNION ALL SELECT 'repo-' || string_split(id, '-')[-1], 'Client of ' || name FROM map_entities_e WHERE type = 'service') WHERE name <> ''),
  es AS (SELECT id, type, name, aliases FROM map_entities_e UNION ALL SELECT id, type, name, aliases FROM entities_e),
  nms AS (SELECT DISTINCT id, type, lower(name) AS name FROM (SELECT id, type, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM es) WHERE length(name) >= 5)"""
_CITE = rf"""d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{evalkit.URL}', ' ', 'g') AS bare FROM documents),
  p AS (SELECT doc_id, raw, regexp_extract(raw, '{evalkit.PATH}', 1) AS path, regexp_extract(raw, '{evalkit.PATH}', 2) AS spans FROM (SELECT doc_id, unnest(regexp_extract_all(bare, '{evalkit.PATH}')) AS raw FROM d)),
  p2 AS (SELECT *, string_split(path, '/')[1] AS head, string_split(path, '/')[-1] AS tail FROM p),
  cites AS (SELECT DISTINCT * FROM (SELECT doc_id, 'url' AS kind, unnest(regexp_extract_all(t, '{evalkit.URL}', 1)) AS raw, NULL::varchar AS path, NULL::bigint AS last_line FROM d
    UNION ALL SELECT doc_id, CASE WHEN NOT starts_with(head, '.') AND regexp_matches(head, '{evalkit.HOST}') THEN 'url' WHEN contains(path, '...') THEN 'path_elided' WHEN spans <> '' THEN 'file_line'
      WHEN (contains(tail, '.') AND NOT ends_with(tail, '.')) OR tail IN ('README', 'Makefile', 'LICENSE', 'NOTICE', 'OWNERS', 'CHANGELOG') OR starts_with(tail, 'README') THEN 'path' ELSE 'prose' END, raw, path, CASE WHEN spans <> '' THEN regexp_extract(spans, '(\d+)$', 1)::bigint END FROM p2
    UNION ALL SELECT doc_id, 'graph_id', unnest(regexp_extract_all(bare, '{evalkit.GRAPH_ID}', 1)), NULL, NULL FROM d
    UNION ALL SELECT doc_id, 'sha', unnest(regexp_extract_all(regexp_replace(regexp_replace(bare, '{evalkit.PATH}', ' ', 'g'), '{evalkit.GRAPH_ID}', ' ', 'g'), '{evalkit.SHA}', 1)), NULL, NULL FROM d))"""
_RES = rf"""{_CITE}, {_COM}, {LOG}, {ENT}, files AS (SELECT DISTINCT unnest(files) AS path FROM com), ids AS (SELECT id FROM ent UNION SELECT id FROM log),
  res AS (SELECT doc_id, kind, raw, CASE WHEN kind IN ('path', 'file_line') THEN path IN (SELECT path FROM files) AND coalesce(last_line <= 500, true) WHEN kind = 'sha' THEN EXISTS (SELECT 1 FROM com WHERE starts_with(com.sha, raw))
    WHEN kind = 'graph_id' THEN raw IN (SELECT id FROM ids) OR (SELECT count(*) FROM ids WHERE starts_with(ids.id, raw)) = 1 ELSE false END AS resolved FROM cites)"""

SQL = {
    "c_noise": f"WITH {_COM} SELECT repo, {_NOISE} AS why, count(*) AS n FROM com GROUP BY ALL",
    "c_chunks": f"WITH {_CHUNK} SELECT sha, repo, chunk FROM chunked",
    "c_watermark": f"WITH {_CHUNK}, k AS (SELECT repo, chunk, min(coalesce(len(files) > 0, false)) AS done FROM chunked GROUP BY ALL), b AS (SELECT repo, min(chunk) FILTER (WHERE NOT done) AS bad, max(chunk) AS last, sum((NOT done)::bigint)::bigint AS redo FROM k GROUP BY repo) SELECT repo, CASE WHEN bad IS NULL THEN last WHEN bad > 0 THEN bad - 1 ELSE -1 END AS upto, redo FROM b",
    "c_reverts": rf"""WITH {_COM}, r AS (SELECT *, regexp_extract(subject, '^Revert\s+"?(.+?)"?\.?$', 1) AS w FROM com WHERE regexp_matches(subject, '^Revert')) SELECT 'evt-' || replace(date, '-', '') || '-' || {slug('repo')} || '-revert-' || substr(sha, 1, 8) AS event_id, sha, trim(CASE WHEN w = '' THEN subject ELSE w END) AS what, date AS ts FROM r""",
    "c_repo_facts": rf"""WITH {_COM}, b AS (SELECT repo, count(*) AS n_commits, min(nullif(date, '')) AS first, max(nullif(date, '')) AS last FROM com GROUP BY repo), fs AS (SELECT DISTINCT repo, unnest(files) AS file FROM com),
      l AS (SELECT repo, CASE regexp_extract(file, '(\.[^./]+)$', 1) {_LANG} END AS language, count(*) AS n FROM fs GROUP BY ALL), t AS (SELECT repo, arg_min(language, row(-n, language)) AS language FROM l WHERE language IS NOT NULL AND n >= 5 GROUP BY repo)
      SELECT b.repo, n_commits, coalesce(first, '') AS first, coalesce(last, '') AS last, coalesce(language, '') AS language FROM b LEFT JOIN t USING (repo)""",
    "x_titles": f"WITH {_FILES} SELECT path, {_TITLE} AS title, md5({_para(40)}) AS paragraph_md5, {_DATE} AS found_date, {_IMPACT} AS impact FROM f",
    "x_decisions": rf"""WITH {_FILES}, g AS (SELECT *, {_TITLE} AS title FROM f), h AS (SELECT *, {slug(_STEM)} AS sl, {_DAY} AS dd FROM g WHERE title <> '') SELECT path, 'evt-adr-' || {slug('title')} || '-' || substr(digest, 1, 8) AS id, CASE WHEN try_cast(nullif(dd, '') AS date) IS NOT NULL THEN dd ELSE day END AS ts, title,
      CASE WHEN regexp_matches(path, '(^|/)(adr|adrs|decisions)/') OR regexp_matches({_STEM}, '^(adr|\d{{3,5}})-') THEN 'high' ELSE 'low' END AS trust,
      CASE WHEN starts_with(sl, 'adr-') THEN sl WHEN regexp_extract(sl, '^\d{{3,5}}-(.+)$', 1) <> '' THEN 'adr-' || regexp_extract(sl, '^\d{{3,5}}-(.+)$', 1) ELSE 'adr-' || {slug('title')} END AS adr_id,
      coalesce(CASE lower(trim(CASE WHEN ({_OWN_STATUS}) <> '' THEN {_OWN_STATUS} ELSE 'accepted' END)) {_STATUS} END, 'active') AS status FROM h""",
    "x_incidents": rf"""WITH {_FILES}, g AS (SELECT *, trim(regexp_extract({_BODY}, '(?m)^#{{1,3}}\s+(.+)$', 1)) AS hd, {_DATE} AS dd FROM f), h AS (SELECT *, CASE WHEN hd <> '' THEN hd ELSE {_STEM} END AS title, CASE WHEN dd <> '' THEN dd ELSE day END AS ts FROM g)
      SELECT path, 'evt-incident-' || {slug('title')} || '-' || substr(digest, 1, 8) AS id, ts, title, {_IMPACT} AS impact, 'inc-' || replace(ts, '-', '') || '-' || {slug('title')} AS inc_id FROM h""",
    "d_directories": f"WITH {_FILES}, {_STATS} SELECT dir, here, tree, readmes, has_index, depth FROM stats",
    "d_candidates": f"""WITH {_FILES}, {_STATS}, k AS (SELECT *, {_CLASS} AS cl, CASE WHEN {_CLASS} IS NOT NULL THEN 'vocab' WHEN readmes >= 5 AND readmes * 2 >= tree THEN 'readme' WHEN here >= 3 OR tree >= 8 THEN 'volume' END AS reason FROM stats WHERE dir <> '.' AND depth <= 3 AND tree > 0)
      SELECT dir, tree, reason, CASE WHEN reason = 'readme' THEN 'doc' ELSE coalesce(split_part(cl, '|', 1), '') END AS adapter, CASE WHEN reason = 'readme' THEN 'design' ELSE coalesce(split_part(cl, '|', 2), '') END AS kind FROM k WHERE reason IS NOT NULL""",
    "d_outliers": rf"""WITH {_FILES}, n AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, len(string_split(t, chr(10)))::bigint AS n_lines FROM f), m AS (SELECT dir, greatest(1, list_sort(list(n_lines))[len(list(n_lines)) // 2 + 1])::bigint AS median FROM n GROUP BY dir HAVING count(*) >= 3),
      h AS (SELECT n.*, median, row_number() OVER (PARTITION BY dir ORDER BY n_lines DESC, path DESC) AS r FROM n JOIN m USING (dir) WHERE n_lines >= {MIN_LINES} AND n_lines >= 6 * median) SELECT dir, path, n_lines, median FROM h WHERE r <= 5""",
    "d_generated": f"""WITH {_FILES}, g AS (SELECT *, '<!-- ' || coalesce(source, '') || ' @generated -->' || chr(10) || t AS pl FROM f) SELECT path, {_banner('pl')} AS planted, {_banner('t')} AS own FROM g""",
    "a_anchors": f"""WITH {_NODES}, own AS (SELECT DISTINCT 'svc-' || {slug('repo')} AS entity, repo, '*' AS node, 'seed' AS kind FROM nodes WHERE 'svc-' || {slug('repo')} IN (SELECT id FROM es)),
      low AS (SELECT repo, lower(name) AS key, min(name) AS node FROM nodes GROUP BY ALL), eq AS (SELECT DISTINCT id AS entity, repo, node, 'seed' AS kind FROM nms JOIN low ON key = nms.name WHERE type NOT IN ('secret-ref', 'env')),
      x AS (SELECT nms.id AS entity, repo, min(nodes.name) AS node, 'xrepo' AS kind FROM nms JOIN nodes ON contains(lower(nodes.name), nms.name) WHERE type = 'service' AND nms.id <> 'svc-' || {slug('repo')} GROUP BY ALL)
      SELECT entity, repo, node, min(kind) AS kind FROM (SELECT * FROM own UNION ALL SELECT * FROM eq UNION ALL SELECT * FROM x) GROUP BY entity, repo, node""",
    "a_layers": f"""WITH {_ents('map_entities')}, {_ents('entities')}, code AS (SELECT id, type, name, description FROM map_entities_e UNION ALL SELECT id, type, name, description FROM entities_e WHERE type = 'service')
      SELECT coalesce(k.id, c.id) AS id, coalesce(k.type, c.type) AS type, coalesce(k.name, c.name) AS name, coalesce(k.description, c.description) AS description, CASE WHEN k.id IS NOT NULL AND coalesce(c.description, '') <> '' AND NOT contains(k.description, c.description) THEN '[code] ' || c.description END AS code_fact FROM entities_e k FULL OUTER JOIN code c ON c.id = k.id""",
    "e_citations": f"WITH {_CITE} SELECT doc_id, kind, raw, coalesce(path, '') AS path, coalesce(last_line, 0) AS last_line FROM cites",
    "e_resolved": f"WITH {_RES} SELECT doc_id, kind, raw, resolved FROM res",
    "e_report": f"WITH {_RES} SELECT kind, count(*) AS total, sum(resolved::bigint)::bigint AS resolved, sum((kind = 'path_elided')::bigint)::bigint AS elided FROM res WHERE kind NOT IN ('prose', 'url', 'shell') GROUP BY GROUPING SETS ((), (kind))",
    "e_arms": "SELECT rater AS arm, lang AS category, count(*) AS n, sum((toxic = 0)::bigint)::bigint AS n_correct FROM doc_labels JOIN (SELECT doc_id, coalesce(lang, '?') AS lang FROM documents) USING (doc_id) GROUP BY GROUPING SETS ((), (rater), (lang), (rater, lang))",
}
