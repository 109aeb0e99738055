"""Commits and pull requests as rows: what to keep, what they revert and implement, and resumable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.functions.text import slugify

# What is machine work.
BOTS = ("[bot]", "dependabot", "renovate", "github-actions")
LOCKFILES = ("go.mod", "go.sum", "package-lock.json", "yarn.lock", "cargo.lock")
MECHANICAL_DIRS = (".github", "vendor")
CHORE = r"(?i)^(chore|ci|build|deps)(\([^)]*\))?!?:"
ADR_ID = r"\b(adr-[a-z0-9][a-z0-9-]*[a-z0-9])\b"
# Languages by file ending.
LANGUAGES = {".py": "Python", ".go": "Go", ".rs": "Rust", ".ts": "TypeScript", ".js": "JavaScript", ".java": "Java", ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++", ".cs": "C#", ".rb": "Ruby", ".sh": "Shell", ".kt": "Kotlin", ".scala": "Scala"}
CHUNK = 250
MIN_FILES = 5
# How messages say what they undo: a quoted subject, a clause that names commits, shas at the start of lines.
REVERT_SUBJECT = r'^Revert\s+"?(.+?)"?\.?$'
REVERT_CLAUSE = r"[Tt]his reverts commits?\s+((?:[0-9a-f]{7,40}(?:[\s,]+and\s+|[\s,]+)?)+)"
SHA = r"([0-9a-f]{7,40})"
LISTED_SHA = r"(?m)^\s*(?:[-*+]\s*)?(?:commit\s+)?([0-9a-f]{8,40})(?=[\s:]|$)"


def commits(table: DataFrame) -> DataFrame:
    """One row per sha, the last delivered; ``date`` as text, '' where none is given."""
    d = table.select(clean_id(F.col("sha")).alias("sha"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), "files", F.coalesce("merge", F.lit(False)).alias("merge"), F.coalesce("repo", F.lit("")).alias("repo"), "seen_at", "row_id").where("sha IS NOT NULL")
    cols = [c for c in d.columns if c not in ("sha", "seen_at", "row_id")]
    return d.groupBy("sha").agg(F.max_by(F.struct(*cols), F.struct("seen_at", "row_id")).alias("r")).select("sha", "r.*")


def mechanical_path(c: Column) -> Column:
    parts = F.split(F.lower(c), "/")
    return F.element_at(parts, -1).isin(*LOCKFILES) | F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*MECHANICAL_DIRS))


def noise() -> Column:
    """Why a commit is left out ('' for one that is kept): merge, bot, mechanical, in this order."""
    author = F.lower("author")
    bot = F.lit(False)
    for b in BOTS:
        bot = bot | F.contains(author, F.lit(b))
    lock = (F.size(F.coalesce("files", F.array().cast("array<string>"))) > 0) & F.coalesce(F.forall("files", mechanical_path), F.lit(False))
    return F.when(F.col("merge"), "merge").when(bot, "bot").when(F.col("subject").rlike(CHORE) | lock, "mechanical").otherwise("")


def chunks(kept: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds ``chunk``: consecutive commits of a repo (by date and sha), ``size`` to a chunk.

    Commits are ranked month by month with carried totals, so a repo that holds most of the log is never one task.
    """
    d = kept.withColumn("month", F.substring("date", 1, 7))
    n = d.groupBy("repo", "month").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("repo").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("repo", "month", before.alias("before"))
    r = F.row_number().over(Window.partitionBy("repo", "month").orderBy("date", "sha")) - 1
    return d.withColumn("r", r).join(n, ["repo", "month"]).withColumn("chunk", F.expr(f"(r + before) div {size}")).drop("r", "before", "month")


def watermark(chunk_states: DataFrame) -> DataFrame:
    """Per repo the last chunk before the first that failed, null if the first failed: ``repo``, ``upto``, ``redo``.

    ``chunk_states`` has repo, chunk and done.  ``redo`` counts the chunks to be done again; finished ones after a failure
    are kept.
    """
    first_bad = F.min(F.when(~F.col("done"), F.col("chunk")))
    d = chunk_states.groupBy("repo").agg(first_bad.alias("bad"), F.max("chunk").alias("last"), F.sum((~F.col("done")).cast("bigint")).alias("redo"))
    upto = F.when(F.col("bad").isNull(), F.col("last")).when(F.col("bad") > 0, F.col("bad") - 1)
    return d.select("repo", upto.alias("upto"), "redo")


def reverts(kept: DataFrame) -> DataFrame:
    """Commits that undo others, as events: ``event_id``, ``sha``, ``what``, ``ts``."""
    what = F.regexp_extract("subject", REVERT_SUBJECT, 1)
    ident = F.concat(F.lit("evt-"), F.regexp_replace("date", "-", ""), F.lit("-"), slugify(F.col("repo")), F.lit("-revert-"), F.substring("sha", 1, 8))
    return kept.where(F.col("subject").rlike("^Revert")).select(ident.alias("event_id"), "sha", F.btrim(F.when(what == "", F.col("subject")).otherwise(what)).alias("what"), F.col("date").alias("ts"))


def reverted_shas(body: Column, is_revert: Column) -> Column:
    """Shas a message says it undoes, twelve characters each, in order: those of its "reverts commit" clause and, if the
    subject says it reverts, those listed at line starts."""
    clause = F.regexp_extract(body, REVERT_CLAUSE, 1)
    named = F.regexp_extract_all(clause, F.lit(SHA), 1)
    listed = F.regexp_extract_all(body, F.lit(LISTED_SHA), 1)
    found = F.concat(named, F.when(is_revert, listed).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(found, lambda s: F.substring(s, 1, 12)))


def decision_commits(kept: DataFrame) -> DataFrame:
    """Commits whose subject names decisions: ``event_id``, ``sha``, ``adr_id``, one row per decision."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("subject"), F.lit(ADR_ID), 1)))
    ident = F.concat(F.lit("evt-"), F.regexp_replace("date", "-", ""), F.lit("-"), slugify(F.col("repo")), F.lit("-"), F.substring("sha", 1, 8))
    return kept.select(ident.alias("event_id"), "sha", F.explode(ids).alias("adr_id"))


def repo_facts(kept: DataFrame) -> DataFrame:
    """Commits, dates and main language of each repo (of at least five distinct files in one language)."""
    dated = F.nullif("date", F.lit(""))
    base = kept.groupBy("repo").agg(F.count(F.lit(1)).alias("n_commits"), F.min(dated).alias("first"), F.max(dated).alias("last"))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    files = kept.select("repo", F.explode("files").alias("file")).distinct()
    by = files.select("repo", F.element_at(lang, F.regexp_extract("file", r"(\.[^./]+)$", 1)).alias("language")).where("language IS NOT NULL").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))
    best = by.where(F.col("n") >= MIN_FILES).groupBy("repo").agg(F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"))
    return base.join(best, "repo", "left").select("repo", "n_commits", F.coalesce("first", F.lit("")).alias("first"), F.coalesce("last", F.lit("")).alias("last"), F.coalesce("language", F.lit("")).alias("language"))


def pull_requests(prs: DataFrame, repo: str, seen: DataFrame | None = None) -> DataFrame:
    """Merged pull requests (``number``, ``title``, ``mergedAt``, ``headRefName``, ``url``, ``files``) as events."""
    d = prs.withColumn("pr", F.concat(F.lit("PR-"), F.col("number")))
    if seen is not None:
        d = d.join(seen.select("pr"), "pr", "left_anti")
    day = F.coalesce(F.nullif(F.substring("mergedAt", 1, 10), F.lit("")), F.lit("1970-01-01"))
    adrs = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "headRefName")), F.lit(ADR_ID), 1)))
    ref = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    refs = F.concat(F.array(ref("pr", F.col("pr")), ref("url", F.coalesce("url", F.lit("")))), F.transform(adrs, lambda a: ref("adr", a)), F.transform(F.slice("files.path", 1, 5), lambda f: ref("file", f)))
    return d.select(F.concat(F.lit("evt-"), F.regexp_replace(day, "-", ""), F.lit("-"), slugify(F.lit(repo)), F.lit("-pr"), F.col("number")).alias("id"), F.lit("pr_merged").alias("type"), day.alias("ts"), F.concat(F.lit(f"{repo} "), F.col("pr"), F.lit(": "), F.substring(F.coalesce("title", F.lit("")), 1, 120)).alias("title"), refs.alias("refs"))


def releases(tags: DataFrame, repo: str, seen: DataFrame | None = None) -> DataFrame:
    """Tags (``tag``, ``date``, ``subject``) as release events."""
    d = tags.where("tag <> ''").dropDuplicates(["tag"])
    if seen is not None:
        d = d.join(seen.select("tag"), "tag", "left_anti")
    day = F.coalesce("date", F.lit(""))
    stamp = F.coalesce(F.nullif(F.regexp_replace(day, "-", ""), F.lit("")), F.lit("undated"))
    return d.select(F.concat(F.lit("evt-"), stamp, F.lit("-"), slugify(F.lit(repo)), F.lit("-release-"), slugify(F.col("tag"))).alias("id"), F.lit("release").alias("type"), F.coalesce(F.nullif(day, F.lit("")), F.lit("1970-01-01")).alias("ts"), F.concat(F.lit(f"{repo} release "), F.col("tag")).alias("title"), F.substring(F.coalesce("subject", F.lit("")), 1, 200).alias("summary"))
