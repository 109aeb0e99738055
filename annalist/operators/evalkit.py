"""Evaluation kit: citations in answers and whether they resolve, run records and their aggregates, session streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id

# The shapes of citations.
PATH = r"((?:[\w.+-]+/)+[\w.+@-]+)(?::(\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*))?"
SHA = r"\b([0-9a-f]{8,40})\b"
GRAPH_ID = r"\b((?:evt|adr|task|inc|goal)-[a-z0-9][a-z0-9-]{3,})\b"
URL = r"((?:https?://|mailto:|git@|ssh://|git://|www\.)\S+)"
HOST = r"^[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}$"
BARE = ("README", "Makefile", "LICENSE", "NOTICE", "OWNERS", "CHANGELOG")
EXCLUDED = ("contaminated", "error", "tool_denied", "graph_mutated", "quota_exceeded", "judge_error")
SEED = 20260729


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct citations of each text: ``key``, ``kind``, ``raw``, ``path``, ``last_line``.

    Kinds: file_line, path, path_elided (shortened with dots), url, prose (a slash but no file), graph_id, sha.  URLs are
    taken out before paths are looked for; hexadecimal runs inside another citation are no shas.
    """
    d = answers.select(key, F.coalesce(text, F.lit("")).alias("t"))
    url = d.select(key, F.explode(_all(F.col("t"), URL, 1)).alias("raw")).select(key, F.lit("url").alias("kind"), "raw", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("last_line"))
    bare = F.regexp_replace("t", URL, " ")
    hits = d.select(key, F.explode(_all(bare, PATH, 0)).alias("raw"))
    path, spans = F.regexp_extract("raw", PATH, 1), F.regexp_extract("raw", PATH, 2)
    tail = F.element_at(F.split(path, "/"), -1)
    head = F.element_at(F.split(path, "/"), 1)
    kind = (
        F.when(~head.startswith(".") & head.rlike(HOST), "url")
        .when(F.contains(path, F.lit("...")), "path_elided")
        .when(spans != "", "file_line")
        .when((F.contains(tail, F.lit(".")) & ~F.endswith(tail, F.lit("."))) | tail.isin(*BARE) | tail.startswith("README"), "path")
        .otherwise("prose")
    )
    last = F.when(spans != "", F.regexp_extract(spans, r"(\d+)$", 1).cast("bigint"))
    paths = hits.select(key, kind.alias("kind"), "raw", path.alias("path"), last.alias("last_line"))
    ids = d.select(key, F.explode(_all(bare, GRAPH_ID, 1)).alias("raw")).select(key, F.lit("graph_id").alias("kind"), "raw", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("last_line"))
    # What is left of a text after its paths and ids.
    rest = F.regexp_replace(F.regexp_replace(bare, PATH, " "), GRAPH_ID, " ")
    shas = d.select(key, F.explode(_all(rest, SHA, 1)).alias("raw")).select(key, F.lit("sha").alias("kind"), "raw", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("last_line"))
    return url.unionByName(paths).unionByName(ids).unionByName(shas).distinct()


def shortened(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``path``, ``real``: the one file that each cited path stands for where no file has that very path.

    A path stands for the only file that ends with it; where none does, for the only one that ends with segments of
    which its own are beginnings, the last one being equal.  Paths that fit several files stand for none.
    """
    known = files.select(F.col("path").alias("real")).where("real IS NOT NULL").distinct()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    p = paths.select("path").where("path IS NOT NULL").distinct().join(known.withColumnRenamed("real", "path"), "path", "left_anti").withColumn("name", name(F.col("path")))
    # Only files whose name is cited have their tails listed.
    near = known.withColumn("name", name(F.col("real"))).join(p.select("name").distinct(), "name", "left_semi")
    parts = F.split("real", "/")
    tails = near.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).select("real", "name", "k", F.slice(parts, -F.col("k"), F.col("k")).alias("tail"))
    only = lambda d: d.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("real").alias("real"))
    ends = only(p.join(tails.select("real", F.array_join("tail", "/").alias("path")), "path"))
    rest = p.join(ends, "path", "left_anti").select("path", "name", F.split("path", "/").alias("segments"))
    rest = rest.select("path", "name", "segments", F.size("segments").alias("k"), F.element_at("segments", 1).alias("begin"))
    begun = tails.where("k > 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.length(F.element_at("tail", 1))))).select("real", "name", "k", "tail", F.element_at("tail", 1).substr(F.lit(1), F.col("n")).alias("begin"))
    loose = only(rest.join(begun, ["name", "k", "begin"]).where(F.forall(F.arrays_zip("segments", "tail"), lambda x: F.startswith(x["tail"], x["segments"]))))
    return ends.unionByName(loose).where("n = 1").select("path", "real")


def resolved(cites: DataFrame, files: DataFrame, shas: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``resolved``: files (``path``, ``n_lines``, null where unknown) must exist, if need be under a path that the
    cited one shortens, and be long enough, shas be the beginning of a known one, graph ids be known or begin exactly
    one known id."""
    f = files.groupBy("path").agg(F.max("n_lines").alias("n_lines"), F.max(F.lit(True)).alias("there"))
    short = shortened(cites.where(F.col("kind").isin("path", "file_line")), f)
    f = f.unionByName(short.join(f.withColumnRenamed("path", "real"), "real").select("path", "n_lines", "there"))
    d = cites.join(f, "path", "left")
    by_file = F.coalesce("there", F.lit(False)) & F.coalesce((F.col("last_line") <= F.col("n_lines")) | F.col("last_line").isNull() | F.col("n_lines").isNull(), F.lit(True))
    # Prefixes meet by their first eight characters, then are compared in full.
    s = cites.where("kind = 'sha'").select("raw").distinct().withColumn("k", F.substring("raw", 1, 8)).join(shas.select(clean_id(F.col("sha")).alias("sha")).distinct().withColumn("k", F.substring("sha", 1, 8)), "k").where(F.expr("startswith(sha, raw)")).select("raw").distinct().withColumn("sha_ok", F.lit(True))
    known = ids.select("id").distinct()
    g = cites.where("kind = 'graph_id'").select("raw").distinct()
    exact = g.join(known.withColumnRenamed("id", "raw"), "raw", "left_semi")
    begun = g.join(exact, "raw", "left_anti").withColumn("k", F.substring("raw", 1, 8)).join(known.withColumn("k", F.substring("id", 1, 8)), "k").where(F.expr("startswith(id, raw)")).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("raw")
    g = exact.unionByName(begun).withColumn("id_ok", F.lit(True))
    d = d.join(s, "raw", "left").join(g, "raw", "left")
    ok = F.when(F.col("kind").isin("path", "file_line"), by_file).when(F.col("kind") == "sha", F.coalesce("sha_ok", F.lit(False))).when(F.col("kind") == "graph_id", F.coalesce("id_ok", F.lit(False))).otherwise(F.lit(False))
    return d.withColumn("resolved", ok).drop("n_lines", "there", "sha_ok", "id_ok")


def report(cites: DataFrame) -> DataFrame:
    """Totals per kind and over all kinds (kind null); prose, URLs and shell text are no citations."""
    d = cites.where(~F.col("kind").isin("prose", "url", "shell"))
    n = [F.count(F.lit(1)).alias("total"), F.sum(F.col("resolved").cast("bigint")).alias("resolved"), F.sum((F.col("kind") == "path_elided").cast("bigint")).alias("elided")]
    return d.groupingSets([[], ["kind"]], "kind").agg(*n)


def arm_table(runs: DataFrame, arm: str, category: str, verdict: Column) -> DataFrame:
    """Runs and correct ones per category and arm, with subtotals: ``arm`` or ``category`` null for all of them."""
    d = runs.select(F.col(arm).alias("arm"), F.col(category).alias("category"), verdict.cast("bigint").alias("ok"))
    return d.groupingSets([[], ["arm"], ["category"], ["arm", "category"]], "arm", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_correct"))


def iteration_stats(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per arm: turns until correct.  ``runs`` has qid, arm, status, turns_to_correct, seconds_to_correct, single_shot,
    nudges_sent, wall_clock_turn1_s; ``verdicts`` qid, arm, accuracy.

    A canonical verdict of correct means turn 1, whatever the run recorded.  Excluded runs never count.
    """
    needed = ("qid", "arm", "status", "turns_to_correct", "seconds_to_correct", "single_shot", "nudges_sent", "wall_clock_turn1_s")
    d = runs.select(*needed).where(~F.coalesce(F.col("status").isin(*EXCLUDED), F.lit(False))).join(verdicts.select("qid", "arm", "accuracy"), ["qid", "arm"], "left")
    fixed = F.coalesce(F.col("accuracy") == "correct", F.lit(False))
    d = d.withColumn("turns", F.when(fixed, 1).otherwise(F.col("turns_to_correct"))).withColumn("secs", F.when(fixed & (F.coalesce("turns_to_correct", F.lit(0)) != 1), F.col("wall_clock_turn1_s")).otherwise(F.col("seconds_to_correct")))
    multi, hit = ~F.coalesce("single_shot", F.lit(False)), F.coalesce(F.col("turns") > 0, F.lit(False))
    n = lambda c: F.count_if(c)
    med = lambda c: F.coalesce(F.round(F.median(c), 3), F.lit(0.0))
    return d.groupBy("arm").agg(
        n(multi).alias("multi"), n(~multi).alias("single"), n(~multi & (F.col("turns") == 1)).alias("single_correct"),
        *[n(multi & (F.col("turns") == k)).alias(f"at_turn_{k}") for k in (1, 2, 3)], n(multi & ~hit).alias("never"),
        med(F.when(multi & hit, F.col("turns").cast("double"))).alias("turns_median"), med(F.when(multi & hit, F.col("secs"))).alias("seconds_median"),
        F.sum(F.coalesce("nudges_sent", F.lit(0))).alias("nudges"), n(multi & (F.col("turns") > 1)).alias("improved"),
    )


def turns(messages: DataFrame, key: str = "session", pos: str = "pos") -> DataFrame:
    """Adds ``turn``: messages of a session up to and with a ``result`` are one turn, counted from 0."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("turn", F.coalesce(F.sum((F.col("type") == "result").cast("bigint")).over(w), F.lit(0)))


def turn_costs(results: DataFrame, key: str = "session", turn: str = "turn") -> DataFrame:
    """Adds ``turn_cost``: sessions report costs so far, so a turn's cost is what exceeds the largest before it."""
    w = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("turn_cost", F.greatest(F.lit(0.0), F.coalesce("total_cost", F.lit(0.0)) - F.coalesce(F.max("total_cost").over(w), F.lit(0.0))))


def assignments(questions: DataFrame, arms: list[str], seed: int = SEED) -> DataFrame:
    """Every question with every arm in a shuffled but repeatable order of judging."""
    d = questions.select("qid", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    return d.withColumn("rank", F.xxhash64("qid", "arm", F.lit(seed))).orderBy("rank", "qid", "arm")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest of a set of files (``path``, ``text``) that does not depend on their order."""
    one = files.select(F.sha2(F.concat_ws("\x00", "path", F.coalesce("text", F.lit(""))), 256).alias("h"))
    return one.agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).select(F.sha2(F.concat_ws(":", F.coalesce("s", F.lit(0)).cast("string"), F.col("n").cast("string")), 256).alias("fingerprint"), "n")
