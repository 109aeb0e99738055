"""Small tables with the columns of the domain, built from rows that name only what they need."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa

ENTITY = pa.struct([("id", pa.string()), ("type", pa.string()), ("name", pa.string()), ("description", pa.string()), ("aliases", pa.list_(pa.string())), ("domains", pa.list_(pa.string())), ("status", pa.string()), ("superseded_by", pa.string()), ("profile", pa.struct([("summary", pa.string()), ("key_facts", pa.list_(pa.string()))]))])
RELATION = pa.struct([(c, pa.string()) for c in ("source", "predicate", "target", "ts", "provenance")])
STR, TS, ARR = pa.string(), pa.timestamp("us"), pa.list_(pa.string())
SCHEMAS = {
    "event_log": [("row_id", pa.int64()), ("id", STR), ("type", STR), ("ts", STR), ("title", STR), ("summary", STR), ("impact", STR), ("domains", ARR), ("actors", ARR), ("trust", STR), ("refs", pa.list_(pa.struct([("kind", STR), ("id", STR)]))), ("supersedes", ARR), ("body", STR), ("source", STR), ("disputed", pa.bool_()), ("derived_entities", pa.list_(ENTITY)), ("derived_relations", pa.list_(RELATION)), ("seen_at", TS)],
    "entities": [("row_id", pa.int64()), ("id", STR), ("type", STR), ("name", STR), ("description", STR), ("aliases", ARR), ("domains", ARR), ("status", STR), ("superseded_by", STR), ("summary", STR), ("key_facts", ARR), ("source_events", ARR), ("last_touched", STR), ("impact", STR), ("seen_at", TS), ("removed_at", TS)],
    "relations": [("row_id", pa.int64()), ("source", STR), ("predicate", STR), ("target", STR), ("ts", STR), ("provenance", STR), ("seen_at", TS)],
    "commits": [("row_id", pa.int64()), ("sha", STR), ("date", STR), ("author", STR), ("subject", STR), ("files", ARR), ("merge", pa.bool_()), ("repo", STR), ("seen_at", TS)],
    "entity_states": [("row_id", pa.int64()), ("id", STR), ("status", STR), ("superseded_by", STR), ("valid_from", TS), ("seen_at", TS)],
    "alias_links": [("row_id", pa.int64()), ("alias", STR), ("canonical", STR), ("is_match", pa.bool_()), ("score", pa.float64()), ("seen_at", TS)],
    "documents": [("doc_id", pa.int64()), ("text", STR), ("lang", STR), ("source", STR), ("n_chars", pa.int64()), ("entity_id", STR), ("path", STR), ("seen_at", TS)],
    "source_formats": [("source", STR), ("zone", STR), ("date_order", STR)],
    "doc_labels": [("doc_id", pa.int64()), ("rater", STR), ("toxic", pa.int32()), ("category", STR)],
    "watch_terms": [("term", STR), ("category", STR), ("lang", STR)],
    "source_targets": [("source", STR), ("target_share", pa.float64()), ("max_repeats", pa.int32())],
    "context_budgets": [("budget", STR), ("capacity_tokens", pa.int64())],
}
for same, as_ in (("map_entities", "entities"), ("map_states", "entity_states")):
    SCHEMAS[same] = SCHEMAS[as_]
DAY = dt.datetime(2024, 1, 1)
FORMATS = [{"source": "adr", "zone": "Europe/Berlin", "date_order": "dmy"}, {"source": "manual", "zone": "America/New_York", "date_order": "mdy"}, {"source": "git", "zone": "UTC", "date_order": "ymd"}]


def rows(table: str, given: list[dict]) -> list[dict]:
    """Full rows: row_id counted from 1 and seen_at a fixed day unless given, all else null."""
    names = [n for n, _ in SCHEMAS[table]]
    out = []
    for i, r in enumerate(given):
        base = {n: None for n in names}
        if "row_id" in base:
            base["row_id"] = i + 1
        if "seen_at" in base:
            base["seen_at"] = DAY
        out.append(base | r)
    return out


def frame(spark, table: str, given: list[dict], extra: bool = False):
    """The rows as a DataFrame; with ``extra`` also columns whose names the operators use inside."""
    d = spark.createDataFrame(pa.Table.from_pylist(rows(table, given), schema=pa.schema(SCHEMAS[table])))
    if extra:
        from pyspark.sql import functions as F

        d = d.withColumns({c: F.lit("x") for c in ("key", "state", "chunk", "split", "n", "u", "path_", "label", "word", "token", "score", "size", "instant_us") if c not in d.columns})
    return d


def result(df) -> set[tuple]:
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)), "duplicate rows"
    return set(got)
