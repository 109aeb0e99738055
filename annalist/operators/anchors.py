"""Links between entities and code nodes, and the edges between repositories that they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import slugify

LEAST = 5  # shorter names pick out too much
GRAM = 5


def _names(entities: DataFrame) -> DataFrame:
    all_ = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", "type", F.explode(all_).alias("name")).where(F.length("name") >= LEAST).select("id", "type", F.lower("name").alias("name")).distinct()


def grams(c):
    """Distinct substrings of length GRAM."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - GRAM + 1)), lambda i: F.substring(c, i, F.lit(GRAM))))


def seed(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """``entity``, ``repo``, ``node``, ``kind``: the service that is a repo (node '*'), names equal to a node's, and services of
    other repos whose name stands inside a node's name (one witness per entity and repo, the smallest node).

    Names inside names are found by an equi-join on five-character pieces and then checked, never by comparing all
    names with all nodes.  Nodes without a name are left out; secrets and environments get no name links.
    """
    n = nodes.where("name IS NOT NULL AND name <> '' AND repo IS NOT NULL").select("repo", "name").distinct()
    repos = n.select("repo").distinct().withColumn("svc", F.concat(F.lit("svc-"), slugify(F.col("repo"))))
    own = repos.join(entities.select(F.col("id").alias("svc")), "svc").select(F.col("svc").alias("entity"), "repo", F.lit("*").alias("node"), F.lit("seed").alias("kind"))
    names = _names(entities)
    lowered = n.groupBy("repo", F.lower("name").alias("key")).agg(F.min("name").alias("node"))
    equal = names.where(~F.col("type").isin("secret-ref", "env")).join(lowered, F.col("key") == names["name"]).select(F.col("id").alias("entity"), "repo", "node", F.lit("seed").alias("kind"))
    services = names.where("type = 'service'").select(F.col("id").alias("entity"), F.col("name").alias("token"), F.substring("name", 1, GRAM).alias("gram"))
    parts = n.select("repo", F.col("name").alias("node"), F.explode(grams(F.lower("name"))).alias("gram"))
    inside = parts.join(services, "gram").where(F.contains(F.lower("node"), F.col("token")))
    foreign = inside.where(F.col("entity") != F.concat(F.lit("svc-"), slugify(F.col("repo"))))
    witness = foreign.groupBy("entity", "repo").agg(F.min("node").alias("node")).withColumn("kind", F.lit("xrepo"))
    # Of several kinds of link between an entity and a node the seed counts.
    return own.unionByName(equal).unionByName(witness.select("entity", "repo", "node", "kind")).groupBy("entity", "repo", "node").agg(F.min("kind").alias("kind"))


def cross_repo_edges(anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """(``source``, ``predicate``, ``target``): the service of a repo refers to the entity found in its code."""
    d = anchors.where("kind = 'xrepo'").select(F.concat(F.lit("svc-"), slugify(F.col("repo"))).alias("source"), F.col("entity").alias("target")).where("source <> target")
    ids = entities.select("id")
    d = d.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return d.select("source", F.lit("references_in_code").alias("predicate"), "target").distinct()


def merged_layers(code: DataFrame, known: DataFrame) -> DataFrame:
    """Code snapshot and event graph as one set of entities: the event side wins, and the code side's description is kept
    as a fact unless it is said already.  Both have id, type, name, description."""
    a = known.select("id", F.struct("type", "name", "description").alias("k"))
    b = code.select("id", F.struct("type", "name", "description").alias("c"))
    d = a.join(b, "id", "full_outer")
    best = lambda f: F.coalesce(F.col(f"k.{f}"), F.col(f"c.{f}")).alias(f)
    told = F.when(F.col("k").isNotNull() & (F.coalesce("c.description", F.lit("")) != "") & ~F.contains(F.coalesce("k.description", F.lit("")), F.coalesce("c.description", F.lit(""))), F.concat(F.lit("[code] "), F.col("c.description")))
    return d.select("id", best("type"), best("name"), best("description"), told.alias("code_fact"))
