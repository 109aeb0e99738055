"""Checking what a model proposed against what is known, before it may enter the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import slugify
from annalist.operators.graph import degrees

MAX_EXPANSION, MAX_NODES, MAX_ADDED = 6, 300, 8
# Predicates a proposal may use.
PREDICATES = ("depends_on", "owned_by", "deployed_to", "documented_in", "reads_secret", "references_in_code", "implements", "relates_to", "supersedes", "part_of", "uses")


def expansion(proposed: DataFrame, vocab: DataFrame, cap: int = MAX_EXPANSION) -> DataFrame:
    """The first ``cap`` distinct proposed words (``pos``, ``token``) that stand in the vocabulary as they are."""
    d = proposed.groupBy("token").agg(F.min("pos").alias("pos")).join(vocab.select("token"), "token", "left_semi")
    return d.orderBy("pos", "token").limit(cap)


def aliases(proposed: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed pairs (``alias``, ``canonical``) of two known entities of one type whose alias is not folded yet."""
    e = entities.select("id", "type")
    d = proposed.where("alias <> canonical").join(e.select(F.col("id").alias("alias"), F.col("type").alias("a")), "alias").join(e.select(F.col("id").alias("canonical"), F.col("type").alias("b")), "canonical").where("a = b")
    d = d.join(existing.select("alias"), "alias", "left_anti")
    return d.groupBy("alias").agg(F.min("canonical").alias("canonical"))


def node_shortlist(nodes: DataFrame, edges: DataFrame, cap: int = MAX_NODES) -> DataFrame:
    """Distinct node names of each repo, the best connected first: ``repo``, ``name``, ``degree``."""
    deg = degrees(edges.select(F.concat_ws("\x00", "repo", "source").alias("source"), F.concat_ws("\x00", "repo", "target").alias("target")))
    d = nodes.where("name IS NOT NULL AND name <> ''").withColumn("k", F.concat_ws("\x00", "repo", "id")).join(deg.withColumnRenamed("id", "k"), "k", "left")
    d = d.groupBy("repo", "name").agg(F.max(F.coalesce("degree", F.lit(0))).alias("degree"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "name"))).where(F.col("r") <= cap).drop("r")


def links(proposed: DataFrame, shortlist: DataFrame, entities: DataFrame) -> DataFrame:
    """Proposed anchors (``entity``, ``repo``, ``node``) whose entity is known and whose node is on the shortlist verbatim."""
    d = proposed.join(entities.select(F.col("id").alias("entity")), "entity", "left_semi")
    return d.join(shortlist.select("repo", F.col("name").alias("node")), ["repo", "node"], "left_semi").select("entity", "repo", "node", F.lit("link").alias("kind")).distinct()


def relations(proposed: DataFrame, entities: DataFrame) -> DataFrame:
    """Proposed relations between two known entities with a predicate from the list."""
    ids = entities.select("id")
    d = proposed.where(F.col("predicate").isin(*PREDICATES) & (F.col("source") != F.col("target")))
    return d.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "predicate", "target").distinct()


def apply_verdicts(plan: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """A plan of sources (``path``, ``adapter``, ``kind``) after verdicts (``path``, ``action``, ``adapter``, ``kind``, ``exclude``).

    drop takes a source out; override changes its adapter and kind where it gives them; exclude adds patterns, eight at most;
    add brings in candidates that the plan lacks, eight at most, by path.  Verdicts on unknown paths say nothing.
    """
    v = verdicts.groupBy("path").agg(F.max_by(F.struct("action", "adapter", "kind", "exclude"), F.struct("action", "path")).alias("v"))
    d = plan.join(v, "path", "left").where("v.action IS NULL OR v.action <> 'drop'")
    told = lambda f: F.coalesce(F.when(F.col("v.action") == "override", F.nullif(F.col(f"v.{f}"), F.lit(""))), F.col(f)).alias(f)
    none = F.array().cast("array<string>")
    kept = d.select("path", told("adapter"), told("kind"), F.slice(F.array_distinct(F.coalesce("v.exclude", none)), 1, MAX_ADDED).alias("exclude"))
    new = v.where("v.action = 'add'").join(candidates.select("path"), "path", "left_semi").join(plan.select("path"), "path", "left_anti").orderBy("path").limit(MAX_ADDED)
    return kept.unionByName(new.select("path", F.coalesce("v.adapter", F.lit("doc")).alias("adapter"), F.coalesce("v.kind", F.lit("")).alias("kind"), none.alias("exclude")))


def workspace_entities(repo_facts: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a workspace map: one service per repo with its facts, one corpus per planned source, and where
    each corpus lies.  Aliases that two repos would share are left to neither."""
    svc = F.concat(F.lit("svc-"), slugify(F.col("repo"), 64))
    fact = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c.cast("string")))
    facts = F.filter(F.array(fact("commits", F.col("n_commits")), fact("first", F.col("first")), fact("last", F.col("last")), fact("language", F.col("language"))), lambda x: x.isNotNull())
    tail = F.element_at(F.split("repo", "/"), -1)
    repos = repo_facts.withColumn("alias", tail).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(F.lower("alias"))))
    repos = repos.select(svc.alias("id"), F.lit("service").alias("type"), F.col("repo").alias("name"), F.when((F.col("same") == 1) & (F.length("alias") >= 5) & (F.col("alias") != F.col("repo")), F.array("alias")).otherwise(F.array().cast("array<string>")).alias("aliases"), facts.alias("key_facts"))
    corpus = F.concat(F.lit("corpus-"), slugify(F.col("path"), 64))
    corpora = plan.select(corpus.alias("id"), F.lit("doc").alias("type"), F.col("path").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("adapter: "), "adapter")).alias("key_facts"))
    lies = plan.select(corpus.alias("source"), F.lit("documented_in").alias("predicate"), F.col("path").alias("target"))
    return repos.unionByName(corpora), lies
