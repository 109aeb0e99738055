"""Problem 9: mixing sources to target weights by balanced sampling (cube method).

The size of the mix is the largest at which every source can reach its share without using a document more often than
its cap.  A source then uses each of its documents r times on average: floor(r) times for certain, and once more with
probability r - floor(r).  Which documents get the extra use is decided by the cube method: inclusion probabilities
move through the null space of the constraints "documents" and "tokens" until all but two of them are 0 or 1.  That
flight runs in blocks; what is undecided in a block (two documents at most) flies on in blocks of the next level, and
only the last two documents of a source are landed.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.tokens import VOCAB, with_token_count
from annalist.session import cut, ship

BLOCK = 2_000
SEED = 20260101
_EPS = 1e-9


def source_key(c: Column) -> Column:
    """Sources compare in lower case with runs of other signs than letters and digits as one underscore."""
    return F.nullif(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def flight(p: list[float], t: list[float], rng: random.Random) -> list[float]:
    """Move the probabilities ``p`` until at most two are strictly between 0 and 1; sums of p and of p * t stay."""
    p = list(p)
    queue = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    rng.shuffle(queue)
    active: list[int] = []
    at = 0
    while True:
        while len(active) < 3 and at < len(queue):
            active.append(queue[at])
            at += 1
        if len(active) < 3:
            if len(active) == 2 and t[active[0]] == t[active[1]]:
                u = (1.0, -1.0)
            else:
                return p
        else:
            a, b, c = (t[i] for i in active)
            u = (c - b, a - c, b - a)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            p[i] += step * x
            if p[i] <= _EPS:
                p[i] = 0.0
            elif p[i] >= 1 - _EPS:
                p[i] = 1.0
        active = [i for i in active if 0.0 < p[i] < 1.0]


def land(p: list[float], t: list[float]) -> list[float]:
    """Decide the few that are left: the outcome with the least error in tokens, then in documents."""
    want_t, want_n = sum(a * b for a, b in zip(p, t)), sum(p)
    best = min(itertools.product((0.0, 1.0), repeat=len(p)), key=lambda s: (abs(sum(a * b for a, b in zip(s, t)) - want_t), abs(sum(s) - want_n), s))
    return list(best)


def _fly(df: DataFrame, last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        rng = random.Random(f"{SEED}-{pdf['src'].iloc[0]}-{int(pdf['block'].iloc[0])}-{len(pdf)}")
        t = pdf["n_tokens"].astype(float).tolist()
        p = flight(pdf["p"].tolist(), t, rng)
        if last:
            open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
            for i, x in zip(open_, land([p[i] for i in open_], [t[i] for i in open_])):
                p[i] = x
        return pdf.assign(p=p)[["src", "doc_id", "n_tokens", "p"]]

    ship(df.sparkSession)
    return df.groupBy("src", "block").applyInPandas(run, "src string, doc_id bigint, n_tokens bigint, p double")


def balanced(docs: DataFrame) -> DataFrame:
    """``docs`` (``src``, ``doc_id``, ``n_tokens``, ``p``) with ``p`` rounded to 0 or 1 by the cube method."""
    done, d = [], docs
    while True:
        # One row per source.
        n = {r["src"]: r["n"] for r in d.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n:
            break
        last = max(n.values()) <= BLOCK
        blocks = F.coalesce(*[F.when(F.col("src") == s, F.lit(-(-k // BLOCK))) for s, k in n.items()])
        d = cut(_fly(d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(len(done))), blocks)), last), "flight")
        done.append(d.where("p = 0 OR p = 1"))
        if last:
            break
        d = d.where("p > 0 AND p < 1")
    if not done:
        return docs
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def mix(documents: DataFrame, targets: DataFrame, vocab: str = VOCAB, total: int | None = None) -> DataFrame:
    """Documents of the mix: ``doc_id``, ``source``, ``n_tokens``, ``n_copies`` (at least 1).

    Documents without a source, or of a source without a target, are not used; sources with a target but without
    tokens cannot contribute, and the shares of the others are scaled to sum to 1.  Empty tables give no rows.

    One small source bounds the whole mix.  With ``total`` the mix aims at so many tokens instead: a source whose cap
    does not reach its share of them gives all it may and falls short, and the others keep to their shares of ``total``.
    """
    d = documents.select("doc_id", "text", source_key(F.col("source")).alias("src"))
    # A short configuration table; of repeated sources the largest values count.
    goal = {r["src"]: (r["share"], r["cap"]) for r in targets.select(source_key(F.col("source")).alias("src"), "target_share", "max_repeats").where("src IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("src").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    empty = d.select("doc_id", F.col("src").alias("source"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(1).cast("bigint").alias("n_copies")).limit(0)
    if not goal:
        return empty
    d = d.where(F.col("src").isin(list(goal)))
    d = cut(with_token_count(d, "text", "n_tokens", vocab).select("src", "doc_id", "n_tokens").where("n_tokens > 0"), "tokens")
    have = {r["src"]: r["t"] for r in d.groupBy("src").agg(F.sum("n_tokens").alias("t")).collect()}
    if not have:
        return empty
    whole = sum(goal[s][0] for s in have)
    size = total if total is not None else min(goal[s][1] * t / (goal[s][0] / whole) for s, t in have.items())
    rate = {s: min(float(goal[s][1]), goal[s][0] / whole * size / t) for s, t in have.items()}
    sure = {s: int(r + _EPS) for s, r in rate.items()}
    pick = lambda m: F.coalesce(*[F.when(F.col("src") == s, F.lit(v)) for s, v in m.items()])
    d = d.withColumn("p", pick({s: max(0.0, rate[s] - sure[s]) if rate[s] - sure[s] > _EPS else 0.0 for s in rate}))
    extra = balanced(d.where("p > 0"))
    d = extra.unionByName(d.where("p = 0"))
    d = d.withColumn("n_copies", pick(sure).cast("bigint") + F.col("p").cast("bigint")).where("n_copies > 0")
    return d.select("doc_id", F.col("src").alias("source"), "n_tokens", "n_copies")


def report(mixed: DataFrame, targets: DataFrame, documents: DataFrame | None = None, vocab: str = VOCAB) -> DataFrame:
    """Per target source: its share, the share reached, documents, uses, tokens and the most uses of a document.

    With ``documents`` also the tokens that the source has there and the size of the mix against all documents.
    """
    n = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_copies").alias("n_uses"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("n_tokens"), F.max("n_copies").alias("most_uses"))
    # One row per source: a handful.
    whole = Window.partitionBy(F.lit(1))
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = t.join(n, "source", "left").withColumn("all_tokens", F.sum("n_tokens").over(whole))
    out = [F.col("source"), F.col("target_share"), F.col("max_repeats"), F.round(zero("n_tokens") / F.col("all_tokens"), 6).alias("actual_share"), zero("n_docs").alias("n_docs"), zero("n_uses").alias("n_uses"), zero("n_tokens").alias("n_tokens"), zero("most_uses").alias("most_uses")]
    if documents is not None:
        have = with_token_count(documents.select("text", source_key(F.col("source")).alias("source")), "text", "k", vocab).groupBy("source").agg(F.sum("k").alias("source_tokens"))
        have = have.withColumn("corpus_tokens", F.sum("source_tokens").over(whole))
        d = d.join(have, "source", "left").withColumn("corpus_tokens", F.max("corpus_tokens").over(whole))
        out += [zero("source_tokens").alias("source_tokens"), F.round(F.col("all_tokens") / F.col("corpus_tokens"), 6).alias("mix_to_corpus")]
    return d.select(*out)


def checks(mixed: DataFrame, targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Per target source whether what a mix promises holds: ``caps_kept``, ``share_met`` (to two of its largest documents,
    of the targets scaled to the sources that have tokens), and ``n_strange``, its rows that are no document of it."""
    d = mixed.join(documents.select("doc_id", source_key(F.col("source")).alias("own")), "doc_id", "left")
    strange = F.count_if(F.coalesce(F.col("own") != F.col("source"), F.lit(True)))
    n = d.groupBy("source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("largest"), F.max("n_copies").alias("most"), strange.alias("strange"))
    t = targets.where("target_share > 0 AND max_repeats > 0").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    whole = Window.partitionBy(F.lit(1))  # one row per source
    d = t.join(n, "source", "left").withColumn("all_tokens", F.sum("tokens").over(whole)).withColumn("used", F.sum(F.when(F.col("tokens").isNotNull(), F.col("share"))).over(whole))
    off = F.abs(F.col("tokens") - F.col("share") / F.col("used") * F.col("all_tokens"))
    return d.select("source", F.coalesce(F.col("most") <= F.col("cap"), F.lit(True)).alias("caps_kept"), F.coalesce(off <= 2 * F.col("largest"), F.lit(True)).alias("share_met"), F.coalesce("strange", F.lit(0)).alias("n_strange"))
