"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

from annalist.functions.text import STOPWORDS

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
PREFIX = r"'^(svc-|module-|adr-|inc-|feat-|env-|team-|ext-|person-|goal-|secret-)'"
US = "%Y-%m-%dT%H:%M:%S.%f"


def cid(x: str) -> str:
    return f"nullif(lower(trim({x}, {WS})), '')"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def wds(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: length(t) >= 3 AND t NOT IN {STOP})"


def slug(x: str, width: int = 48) -> str:
    return f"regexp_replace(substr(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, {width}), '-+$', '')"


#: The event log as operators read it: the last delivery of each id.
LOG = f"""log AS (
  SELECT {cid('id')} AS id, coalesce(type, '') AS type, coalesce(ts, '') AS ts, coalesce(title, '') AS title, coalesce(summary, '') AS summary,
         coalesce(nullif(impact, ''), 'low') AS impact, coalesce(nullif(trust, ''), 'normal') AS trust, coalesce(body, '') AS body,
         coalesce(nullif(source, ''), 'manual') AS source, coalesce(disputed, false) AS disputed, domains, refs, supersedes, derived_entities, derived_relations, seen_at, row_id
  FROM event_log WHERE {cid('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {cid('id')} ORDER BY seen_at DESC, row_id DESC) = 1)"""
#: Entities with one row per id.
ENT = f"""ent AS (
  SELECT {cid('id')} AS id, coalesce(type, '') AS type, coalesce(name, '') AS name, coalesce(description, '') AS description, aliases, domains,
         coalesce(nullif(status, ''), 'active') AS status, coalesce({cid('superseded_by')}, '') AS superseded_by, coalesce(summary, '') AS summary, key_facts, source_events,
         coalesce(last_touched, '') AS last_touched, coalesce(nullif(impact, ''), 'low') AS impact, row_id
  FROM entities WHERE {cid('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {cid('id')} ORDER BY row_id DESC) = 1)"""
#: Relations with one row per triple, the first by row_id.
REL = f"""rel AS (
  SELECT {cid('source')} AS source, predicate, {cid('target')} AS target, coalesce(ts, '') AS ts, coalesce({cid('provenance')}, '') AS provenance, row_id
  FROM relations WHERE {cid('source')} IS NOT NULL AND predicate IS NOT NULL AND {cid('target')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {cid('source')}, predicate, {cid('target')} ORDER BY row_id) = 1)"""
NAMES = """nm AS (SELECT id, unnest(list_concat([id, name], coalesce(aliases, []))) AS name FROM ent), names AS (SELECT id, name FROM nm WHERE name IS NOT NULL)"""
VOCAB = f"""voc AS (SELECT token, count(*) AS n FROM (
  SELECT unnest({wds('name')}) AS token FROM names UNION ALL SELECT unnest({wds('title')}) AS token FROM log) GROUP BY token)"""


def instant_cte(name: str, rows: str) -> str:
    """CTEs that end in ``name``: the rows of ``rows`` (with ts, zone and ord) plus ``us``, microseconds since 1970."""
    months = "%b"
    fmts = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %I:%M %p", "%Y-%m-%d", f"%a, %d {months} %Y %H:%M:%S", "%Y%m%dT%H%M%S", f"{months} %d, %Y %I:%M %p", f"{months} %d, %Y"]
    return rf"""{name}_a AS (SELECT *, regexp_replace(trim(ts, {WS}), '\s+', ' ', 'g') AS i_s FROM ({rows})),
  {name}_b AS (SELECT *, regexp_extract(i_s, '\[([^\]]+)\]$', 1) AS i_zn, regexp_replace(i_s, '\[[^\]]+\]$', '') AS i_b FROM {name}_a),
  {name}_c AS (SELECT *, regexp_extract(i_b, '(?::[0-9]{{2}}(?:[.,][0-9]+)?|[Tt][0-9]{{6}})\s?([+-][0-9]{{2}}:?(?:[0-9]{{2}})?)$', 1) AS i_off, CASE WHEN regexp_extract(i_b, '[0-9]\s?([A-Za-z]{{1,5}})$', 1) IN ('AM', 'PM', 'am', 'pm') THEN '' ELSE upper(regexp_extract(i_b, '[0-9]\s?([A-Za-z]{{1,5}})$', 1)) END AS i_ab FROM {name}_b),
  {name}_d AS (SELECT *, replace(regexp_replace(trim(CASE WHEN i_off <> '' THEN i_b[:length(i_b) - length(i_off)] WHEN i_ab <> '' THEN i_b[:length(i_b) - length(i_ab)] ELSE i_b END), '[.,]([0-9]{{1,6}})[0-9]*$', '.\1'), 't', 'T') AS i_c0 FROM {name}_c),
  {name}_e AS (SELECT *, try_cast(regexp_extract(i_c0, '^([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-][0-9]{{4}}', 1) AS int) AS i_x, try_cast(regexp_extract(i_c0, '^([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-][0-9]{{4}}', 2) AS int) AS i_y FROM {name}_d),
  {name}_f AS (SELECT *, CASE WHEN i_x IS NOT NULL THEN regexp_extract(i_c0, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]([0-9]{{4}})', 1) || CASE WHEN i_x > 12 OR (i_y <= 12 AND coalesce(ord, '') <> 'mdy') THEN '-' || i_y || '-' || i_x ELSE '-' || i_x || '-' || i_y END || regexp_extract(i_c0, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}(.*)$', 1)
    WHEN regexp_matches(i_c0, '^[0-9]{{4}}[-/][0-9]{{1,2}}$') THEN replace(i_c0, '/', '-') || '-01' ELSE regexp_replace(i_c0, '^([0-9]{{4}})/([0-9]+)/', '\1-\2-') END AS i_c FROM {name}_e),
  {name}_g AS (SELECT *, try_strptime(i_c, [{', '.join(f"'{f}'" for f in fmts)}]) AS i_l FROM {name}_f),
  {name}_h AS (SELECT *, CASE WHEN i_off <> '' THEN (CASE WHEN i_off[1] = '-' THEN -1 ELSE 1 END) * (i_off[2:3]::int * 60 + coalesce(try_cast(nullif(replace(i_off[4:], ':', ''), '') AS int), 0)) WHEN i_ab <> '' THEN CASE i_ab WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 END END AS i_min, coalesce(nullif(i_zn, ''), zone, 'UTC') AS i_z FROM {name}_g),
  {name}_i AS (SELECT *, timezone(i_z, i_l) AS i_t FROM {name}_h),
  {name} AS (SELECT * EXCLUDE (i_s, i_zn, i_b, i_off, i_ab, i_c0, i_x, i_y, i_c, i_l, i_min, i_z, i_t), CASE WHEN regexp_full_match(i_s, '[0-9]+') THEN CASE WHEN length(i_s) <= 11 THEN i_s::bigint * 1000000 WHEN length(i_s) <= 14 THEN i_s::bigint * 1000 WHEN length(i_s) <= 17 THEN i_s::bigint ELSE i_s::bigint // 1000 END
    WHEN i_l IS NULL THEN NULL WHEN i_min IS NOT NULL THEN epoch_us(i_l) - i_min * 60000000::bigint WHEN i_ab <> '' THEN NULL
    WHEN timezone(i_z, i_t - INTERVAL 1 HOUR) = i_l THEN epoch_us(i_t) - 3600000000 ELSE epoch_us(i_t) END AS us FROM {name}_i)"""


FMT_US = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.%fZ')"
FORMATS = "fo AS (SELECT lower(source) AS source, zone, date_order FROM source_formats)"
