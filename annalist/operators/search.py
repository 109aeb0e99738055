"""Lexical search over the graph: vocabulary, entity and title matching, code nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import STOPWORDS, query_tokens, query_words, tokens, words

# Fixed values of the ranking.
MAX_PHRASE = 16
DISCRIMINATING = 3


def names(entities: DataFrame) -> DataFrame:
    """One row per entity and name it goes by (id, name, aliases): ``id``, ``name``."""
    all_ = F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", F.explode(all_).alias("name")).where("name IS NOT NULL")


def vocabulary(entities: DataFrame, log: DataFrame) -> DataFrame:
    """``token``, ``n``: how often each word stands in ids, names, aliases and titles."""
    e = names(entities).select(F.explode(words(F.col("name"))).alias("token"))
    t = log.select(F.explode(words(F.col("title"))).alias("token"))
    return e.unionByName(t).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def near(vocab: DataFrame, stems: list[str]) -> DataFrame:
    """Vocabulary words that contain one of the stems; all of it where there is no stem."""
    if not stems:
        return vocab
    hit = F.lit(False)
    for s in stems:
        hit = hit | F.contains(F.col("token"), F.lit(s))
    return vocab.where(hit)


def vocab_hint(vocab: DataFrame, text: str, cap: int = 20) -> DataFrame:
    """The rarest vocabulary words near the wording of a query; none for a query without words."""
    stems = query_words(text)
    d = near(vocab, stems) if stems else vocab.limit(0)
    return d.orderBy("n", "token").limit(cap)


def match_entities(entities: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """``id``, ``score`` of the best entities for a query.

    A name that stands in the query as a whole phrase scores 3 + its length / 100; else the words it shares with the
    query count by inverse document frequency, and its coverage breaks ties.  Scores are rounded to six digits; ties go
    to the smaller id.  The query is short, so its phrases are literals.
    """
    q = query_tokens(text)
    wanted = sorted({t for t in q if t not in STOPWORDS})
    phrases = sorted({" ".join(q[i : i + n]) for n in range(1, min(len(q), MAX_PHRASE) + 1) for i in range(len(q) - n + 1)})
    if not q:
        return entities.select("id", F.lit(0.0).alias("score")).limit(0)
    d = names(entities).withColumn("t", tokens(F.col("name")))
    is_phrase = F.array_join("t", " ").isin(phrases)
    own = F.array_distinct(F.filter("t", lambda x: ~x.isin(*STOPWORDS)))
    hit = F.array_intersect(own, F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))
    d = d.select("id", F.when(is_phrase, 3.0 + F.length(F.lower("name")) / 100).alias("phrase"), F.when(~is_phrase, hit).alias("hit"), F.size(own).alias("width"))
    d = d.where(F.col("phrase").isNotNull() | (F.size("hit") > 0))
    total = F.lit(max(1, entities.count()))
    reached = d.select("id", F.explode("hit").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # One row per query word: bounded by the query.
    weight = reached.select("token", (F.log(1 + total / F.col("df")) / F.log(1 + total)).alias("w"))
    scored = d.withColumn("k", F.monotonically_increasing_id())
    parts = scored.where(F.size("hit") > 0).select("k", "id", "width", F.size("hit").alias("n_hit"), F.explode("hit").alias("token")).join(F.broadcast(weight), "token")
    overlap = parts.groupBy("k", "id", "width", "n_hit").agg(F.sum("w").alias("s")).select("id", (F.col("s") + F.col("n_hit") / F.col("width") / 100).alias("score"))
    both = overlap.unionByName(d.where(F.col("phrase").isNotNull()).select("id", F.col("phrase").alias("score")))
    return both.groupBy("id").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def scored_titles(log: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """``id``, ``ts``, ``score``, ``rare`` of events whose titles carry the wording.

    Query words count where they are part of a title word; two of them must (one for a query of one word).  Each weighs
    1 / frequency of the rarest title word it is part of; ``rare`` says whether some such word is in few titles.
    """
    stems = query_words(text)
    if not stems:
        return log.select("id", "ts", F.lit(0.0).alias("score"), F.lit(False).alias("rare")).limit(0)
    need = min(2, len(stems))
    q = F.array(*[F.lit(s) for s in stems])
    t = log.select("id", "ts", F.explode(F.array_distinct(tokens(F.col("title")))).alias("token"))
    hits = t.withColumn("stem", F.explode(F.filter(q, lambda s: F.contains(F.col("token"), s))))
    usable = (F.length("token") >= 3) & ~F.col("token").isin(*STOPWORDS)
    in_titles = t.where(usable).groupBy("token").agg(F.count(F.lit(1)).alias("tf"))
    hits = hits.join(vocab.select("token", F.col("n").alias("vf")), "token", "left").join(in_titles, "token", "left")
    per_stem = hits.groupBy("id", "ts", "stem").agg(F.max(1 / F.coalesce("vf", F.lit(1))).alias("w"), F.max(F.coalesce("tf", F.lit(1)) <= DISCRIMINATING).alias("rare"))
    d = per_stem.groupBy("id", "ts").agg(F.round(F.sum("w"), 6).alias("score"), F.max("rare").alias("rare"), F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= need).select("id", "ts", "score", "rare")


def title_events(log: DataFrame, text: str, vocab: DataFrame, exclude: DataFrame | None = None, cap: int = 5, rare_only: bool = False) -> DataFrame:
    """The best titles, newest first among equals, without the ids in ``exclude``."""
    d = scored_titles(log, text, vocab)
    if rare_only:
        d = d.where("rare")
    if exclude is not None:
        d = d.join(exclude.select("id"), "id", "left_anti")
    return d.orderBy(F.desc("score"), F.desc("ts"), F.desc("id")).limit(cap)


def titles_discriminate(log: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """One row: whether some matched title owes its match to a rare word."""
    return scored_titles(log, text, vocab).agg(F.coalesce(F.max("rare"), F.lit(False)).alias("discriminates"))


def code_nodes(nodes: DataFrame, edges: DataFrame, text: str, cap: int = 7) -> DataFrame:
    """Code nodes by the number of query words their names share, with the edges that touch them."""
    stems = query_words(text)
    q = F.array(*[F.lit(s) for s in stems]).cast("array<string>")
    d = nodes.select("repo", "id", "name", F.size(F.array_intersect(F.array_distinct(tokens(F.col("name"))), q)).alias("hits")).where("hits > 0")
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("id")).groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n_edges"))
    return d.join(ends, ["repo", "id"], "left").select("repo", "id", "name", "hits", F.coalesce("n_edges", F.lit(0)).alias("n_edges")).orderBy(F.desc("hits"), "name", "repo", "id").limit(cap)
