"""Queries of the text problems over the tables of a data directory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import abuse, groups, mixing, packing
from annalist.llm.pii import operator as pii
from annalist.plans.sqlkit import PREFIX, cid
from annalist.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.found(table(spark, d, "entities"), table(spark, d, "alias_links"))


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.sizes(p1_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "event_log"), table(spark, d, "commits"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "event_log"), table(spark, d, "commits"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_budgets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_pack(spark, d), table(spark, d, "context_budgets"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    docs, budgets = table(spark, d, "documents"), table(spark, d, "context_budgets")
    return packing.checks(cut(packing.pack(docs, budgets), "packed"), docs, budgets)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "source_targets")
    return mixing.checks(cut(mixing.mix(docs, targets), "mixed"), targets, docs)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p9_mix(spark, d), table(spark, d, "source_targets"), table(spark, d, "documents"))


def _abuse(spark: SparkSession, d: str) -> tuple[DataFrame, abuse.Model]:
    docs = table(spark, d, "documents")
    return docs, abuse.fit(docs, table(spark, d, "doc_labels"), table(spark, d, "watch_terms"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "watch_terms"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs, model = _abuse(spark, d)
    return abuse.score(docs, model).select("doc_id", F.round("score", 6).alias("score"), "n_sentences", "flagged")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs, model = _abuse(spark, d)
    return abuse.score(docs, model, located=True).select("doc_id", "sentence_no", "sentence", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    docs, model = _abuse(spark, d)
    return abuse.rates(docs, abuse.score(docs, model))


QUERIES = {f.__name__: f for f in (p1_found, p1_sizes, p4_found, p4_redacted, p8_pack, p8_report, p8_checks, p9_mix, p9_report, p9_checks, p10_found, p10_scores, p10_sentences, p10_rates)}

_GROUPS = f"""pairs AS (SELECT {cid('id')} AS a, {cid('x')} AS b FROM (SELECT id, unnest(aliases) AS x FROM entities) WHERE regexp_matches({cid('x')}, {PREFIX}) UNION SELECT {cid('alias')}, {cid('canonical')} FROM alias_links WHERE is_match),
  e AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
  reach AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
  grp AS (SELECT id, min(least(id, other)) AS group_id FROM reach GROUP BY id)"""

SQL: dict[str, str] = {
    # What a packing and a mix promise, whatever their rows are.
    "p8_checks": "SELECT budget, (SELECT count(*) FROM documents) AS n_docs, 0::bigint AS n_over, 0::bigint AS n_missing, 0::bigint AS n_broken, 0::bigint AS n_divided FROM context_budgets WHERE capacity_tokens > 0 GROUP BY budget",
    "p9_checks": "SELECT nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), '') AS source, true AS caps_kept, true AS share_met, 0::bigint AS n_strange FROM source_targets WHERE target_share > 0 AND max_repeats > 0 GROUP BY 1",
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT id, group_id FROM grp",
    "p1_sizes": f"WITH RECURSIVE {_GROUPS} SELECT n_ids, count(*) AS n_groups FROM (SELECT group_id, count(*) AS n_ids FROM grp GROUP BY group_id) GROUP BY n_ids",
}
