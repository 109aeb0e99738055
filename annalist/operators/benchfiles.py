"""Question files and run checks of an evaluation campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of an exhausted quota, and of a refused tool.
QUOTA = ("usage limit", "rate limit", "quota", "too many requests", "overloaded", "credit balance")
DENIED = r"(?i)(permission to use|has been denied|requires approval|not allowed to)"
VERDICTS = ("correct", "partial", "wrong")


def questions(files: DataFrame) -> DataFrame:
    """Questions of Markdown files (``path``, ``text``): one row per ``## ID Title`` block.

    ``qid``, ``title``, ``prompt`` (the first run of quoted lines), ``gold``, ``trap`` (bold-marked fields), ``required`` and ``forbidden``
    (items of the lists below those words), ``abstain``, ``usable`` (it has a prompt and a gold answer).
    """
    block = F.explode(F.filter(F.split(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), r"\n(?=## )"), lambda _, i: i > 0))
    d = files.select("path", block.alias("b")).withColumn("head", F.regexp_extract("b", r"^## +([A-Za-z]+\d+)", 1)).where("head <> ''")
    quoted = F.regexp_extract("b", r"(?m)((?:^>.*\n?)+)", 1)
    prompt = F.btrim(F.regexp_replace(quoted, r"(?m)^>[ ]?", ""), F.lit(" \n"))
    field = lambda name: F.btrim(F.regexp_replace(F.regexp_extract("b", rf"(?is)\*\*{name}:?\*\*:?[ \t]*(?:\n(?=[^\s*#]))?(.*?)(?=\n\s*\n|\n\*\*|\n#|\z)", 1), r"\s+", " "))
    items = lambda name: F.transform(F.regexp_extract_all(F.regexp_extract("b", rf"(?is)\*\*{name}:?\*\*:?\s*\n(.*?)(?=\n\*\*|\n#|\z)", 1), F.lit(r"(?ms)^[-*] +(.*?)(?=^[-*] |\z)"), 1), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    gold = field("gold")
    return d.select("path", F.col("head").alias("qid"), F.btrim(F.regexp_extract("b", r"^## +[A-Za-z]+\d+[.:]? *(.*)", 1)).alias("title"), prompt.alias("prompt"), gold.alias("gold"), field("trap").alias("trap"), items("required").alias("required"), items("forbidden").alias("forbidden"), F.lower(field("abstain")).isin("yes", "true").alias("abstain"), ((prompt != "") & (gold != "")).alias("usable"))


def rubric(text: Column) -> Column:
    """The preamble of a question file, up to the first rule."""
    return F.btrim(F.element_at(F.split(text, r"\n---"), 1), F.lit(" \n"))


def quota_hit(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for q in QUOTA:
        out = out | F.contains(low, F.lit(q))
    return out


def transcripts(messages: DataFrame) -> DataFrame:
    """Per session of a stream (``session``, ``pos``, ``type``, ``tool``, ``text``, ``total_cost``): answer (the last assistant text), tool calls,
    refusals, cost (the largest reported) and whether a quota ended it."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    said = (F.col("type") == "assistant") & (F.coalesce("text", F.lit("")) != "")
    return messages.groupBy("session").agg(
        F.max_by(F.when(said, F.col("text")), F.when(said, F.col("pos"))).alias("answer"), n(F.col("tool").isNotNull()).alias("n_tools"), n(F.col("text").rlike(DENIED) & (F.col("type") == "tool_result")).alias("n_denied"),
        F.coalesce(F.max("total_cost"), F.lit(0.0)).alias("cost"), n(quota_hit(F.col("text")) & (F.col("type") == "error")).alias("n_quota"),
    )


def checks_passed(checks: DataFrame) -> DataFrame:
    """Per run: whether no fatal check failed, with the names of the failed ones (``run``, ``name``, ``ok``, ``severity``)."""
    bad = F.when(~F.col("ok"), F.col("name"))
    return checks.groupBy("run").agg(F.min(F.col("ok") | (F.col("severity") != "fatal")).alias("passed"), F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("failed"))


def normalised_verdicts(raw: DataFrame) -> DataFrame:
    """Verdicts with unknown accuracies as wrong and fabrications as a count of at least 0."""
    acc = F.lower(F.btrim(F.coalesce("accuracy", F.lit(""))))
    return raw.withColumn("accuracy", F.when(acc.isin(*VERDICTS), acc).otherwise("wrong")).withColumn("fabrication", F.greatest(F.lit(0), F.coalesce(F.expr("try_cast(fabrication AS int)"), F.lit(0))))


def to_judge(runs: DataFrame, judged: DataFrame, seed: int, cap: int | None = None, force: bool = False) -> DataFrame:
    """Completed runs without a verdict, in a shuffled but repeatable order."""
    d = runs.where("status = 'completed'")
    if not force:
        d = d.join(judged.select("qid", "arm"), ["qid", "arm"], "left_anti")
    d = d.orderBy(F.xxhash64("qid", "arm", F.lit(seed)), "qid", "arm")
    return d.limit(cap) if cap is not None else d


def spent(runs: DataFrame, baseline: float = 0.0) -> DataFrame:
    """Money spent over all runs and verdicts, less a baseline."""
    return runs.agg((F.coalesce(F.sum(F.coalesce("cost", F.lit(0.0)) + F.coalesce("judge_cost", F.lit(0.0))), F.lit(0.0)) - baseline).alias("spent"))
