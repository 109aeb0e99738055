"""Decision records, postmortems and prose as events: extraction from (``path``, ``text``) rows by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import calendar_date, slugify

# Upstream words for a status.
STATUS = {"provisional": "active", "implementable": "active", "implemented": "active", "active": "active", "accepted": "active", "approved": "active", "superseded": "superseded", "replaced": "superseded", "deprecated": "superseded", "withdrawn": "dropped", "rejected": "dropped", "deferred": "dropped"}
HIGH = ("sev1", "sev-1", "p1", "critical", "high", "outage")
MEDIUM = ("sev2", "sev-2", "p2", "medium", "degraded")
JUNK_REFS = ("n/a", "na", "none", "nil", "tbd", "todo", "unknown", "-", "?")
DATE = r"(\d{4}-\d{2}-\d{2})"


def body(text: Column) -> Column:
    """The text without its front matter."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^---\n.*?\n---\n", "")


def field(text: Column, name: str) -> Column:
    """Value of a front-matter or inline field; '' if there is none."""
    front = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    a = F.regexp_extract(front, rf"(?im)^\s*{name}\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)
    b = F.btrim(F.regexp_extract(text, rf"(?im)^(?:[-*]\s*)?{name}\s*[:–]\s*(.+)$", 1))
    return F.when(a != "", a).otherwise(b)


def section(text: Column, heading: str) -> Column:
    """First line below a heading of that name; '' if there is none."""
    return F.btrim(F.regexp_extract(text, rf"(?im)^#{{1,4}}\s+{heading}\s*\n+([^\n#]+)", 1))


def title(text: Column) -> Column:
    """Front-matter title, else the first heading, without a leading record number."""
    own = F.regexp_extract(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1), r"(?im)^\s*title\s*:\s*[\"']?(.*?)[\"']?\s*$", 1)
    head = F.btrim(F.regexp_extract(body(text), r"(?m)^#{1,3}\s+(.+)$", 1))
    return F.regexp_replace(F.when(own != "", own).otherwise(head), r"(?i)^ADR[-\s]?\d*\s*[:.\-]\s*", "")


def first_paragraph(text: Column, least: int = 40) -> Column:
    """The first block that is no heading and longer than ``least`` characters, on one line, cut at 300."""
    blocks = F.transform(F.split(body(text), "\n\n"), lambda b: F.btrim(b, F.lit(" \t\n\r")))
    hit = F.get(F.filter(blocks, lambda b: (b != "") & ~b.startswith("#") & (F.length(b) > least)), F.lit(0))
    return F.coalesce(F.substring(F.regexp_replace(hit, r"\s+", " "), 1, 300), F.lit(""))


def find_date(text: Column) -> Column:
    """The date of a ``date`` field, else the first date within 500 characters; '' if there is none."""
    named = F.regexp_extract(field(text, "date"), DATE, 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(F.substring(text, 1, 500), DATE, 1))


def find_impact(text: Column) -> Column:
    """Impact of an incident by its severity field, else by its first 300 characters; never low."""
    own = field(text, "severity")
    hay = F.lower(F.when(own != "", own).otherwise(F.substring(text, 1, 300)))
    high = F.lit(False)
    for w in HIGH:
        high = high | F.contains(hay, F.lit(w))
    return F.when(high, "high").otherwise("medium")


def map_status(raw: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(F.btrim(raw))), F.lit("active"))


def stem(path: Column) -> Column:
    """File name without its ending; for README and index files the name of their directory."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    return F.when(F.lower(last).isin("readme.md", "index.md"), up).otherwise(F.regexp_replace(last, r"\.[^.]+$", ""))


def decision_id(path: Column, title_: Column) -> Column:
    """adr-<slug> by the file name where it carries one, else by the title."""
    s = slugify(stem(path))
    numbered = F.regexp_extract(s, r"^\d{3,5}-(.+)$", 1)
    return F.when(s.startswith("adr-"), s).when(numbered != "", F.concat(F.lit("adr-"), numbered)).otherwise(F.concat(F.lit("adr-"), slugify(title_)))


def reference_id(ref: Column) -> Column:
    """The decision an upstream reference means; '' where that would be a guess."""
    r = F.regexp_replace(F.btrim(ref, F.lit(" \"'()<>")), "/+$", "")
    url = F.regexp_extract(r, r"/(?:keps|adr|adrs|decisions)/(.+)$", 1)
    r = F.when(F.contains(r, F.lit("://")), url).otherwise(r)
    parts = F.filter(F.split(r, "/"), lambda p: ~p.isin("", ".", "..") & ~F.lower(p).isin("readme.md", "index.md", "readme", "index"))
    s = F.regexp_replace(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), r"(?i)\.(md|markdown|ya?ml)$", "")
    k = slugify(s)
    numbered = F.regexp_extract(k, r"^\d{3,5}-(.+)$", 1)
    out = F.when(k.startswith("adr-"), k).when(numbered != "", F.concat(F.lit("adr-"), numbered)).when(k != "", F.concat(F.lit("adr-"), k)).otherwise("")
    bad = F.lower(F.btrim(ref)).isin(*JUNK_REFS) | s.rlike(r"(?i)^(?:kep[-\s_]?)?\d+$") | (s == "")
    return F.when(bad, "").otherwise(out)


def unseen(files: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Adds ``digest`` and leaves out files whose (path, digest) was read before."""
    d = files.withColumn("digest", F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 12))
    return d.join(seen.select("path", "digest"), ["path", "digest"], "left_anti") if seen is not None else d


def decisions(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Decision records as events: ``id``, ``ts``, ``title``, ``summary``, ``trust``, ``adr_id``, ``status``, ``supersedes``.

    ``files`` has path, text and day (used where a record carries no calendar date).  Texts without a title are none.
    """
    t = F.coalesce("text", F.lit(""))
    d = unseen(files, seen).withColumn("title", title(t)).where("title <> ''")
    day = F.regexp_extract(field(t, "date"), DATE, 1)
    own = field(t, "status")
    status = F.when(own != "", own).otherwise(section(t, "status"))
    sup = F.array_distinct(F.regexp_extract_all(F.lower(field(t, "supersedes")), F.lit(r"\b(adr-[a-z0-9][a-z0-9-]*[a-z0-9])\b"), 1))
    real = F.col("path").rlike(r"(^|/)(adr|adrs|decisions)/") | stem(F.col("path")).rlike(r"^(adr|\d{3,5})-")
    return d.select(
        F.concat(F.lit("evt-adr-"), slugify(F.col("title")), F.lit("-"), F.substring("digest", 1, 8)).alias("id"), F.when(calendar_date(day), day).otherwise(F.col("day")).alias("ts"),
        "title", first_paragraph(t).alias("summary"), F.when(real, "high").otherwise("low").alias("trust"), decision_id(F.col("path"), F.col("title")).alias("adr_id"),
        map_status(F.when(status != "", status).otherwise(F.lit("accepted"))).alias("status"), sup.alias("supersedes"), "path", "digest",
    )


def status_observation(updated: Column, commit_day: Column, today: Column, decided: Column) -> Column:
    """When a status was observed: the source's own claim, else the commit that wrote it, else today; never before the
    decision itself."""
    day = F.when(calendar_date(updated), updated).when(calendar_date(commit_day), commit_day).otherwise(today)
    return F.greatest(day, decided)


def incidents(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Postmortems as events: ``id``, ``ts``, ``title``, ``summary``, ``impact``, ``inc_id``."""
    t = F.coalesce("text", F.lit(""))
    head = F.btrim(F.regexp_extract(body(t), r"(?m)^#{1,3}\s+(.+)$", 1))
    d = unseen(files, seen).withColumn("title", F.when(head != "", head).otherwise(stem(F.col("path"))))
    day = find_date(t)
    d = d.withColumn("ts", F.when(day != "", day).otherwise(F.col("day")))
    return d.select(F.concat(F.lit("evt-incident-"), slugify(F.col("title")), F.lit("-"), F.substring("digest", 1, 8)).alias("id"), "ts", "title", first_paragraph(t, 0).alias("summary"), find_impact(t).alias("impact"), F.concat(F.lit("inc-"), F.regexp_replace("ts", "-", ""), F.lit("-"), slugify(F.col("title"))).alias("inc_id"), "path", "digest")


def notes(files: DataFrame, kind: str = "doc", seen: DataFrame | None = None) -> DataFrame:
    """Prose documents as notes: ``id``, ``doc_id``, ``title``, ``summary``."""
    t = F.coalesce("text", F.lit(""))
    d = unseen(files, seen).withColumn("title", title(t)).where("title <> ''")
    return d.select(F.concat(F.lit(f"evt-{kind}-"), slugify(F.col("title")), F.lit("-"), F.substring("digest", 1, 8)).alias("id"), F.concat(F.lit(f"{kind}-"), slugify(F.col("title"))).alias("doc_id"), "title", first_paragraph(t).alias("summary"), "path", "digest")


def described_tables(docs: DataFrame, kind: str = "table") -> DataFrame:
    """Table descriptions (``path``, ``table``, ``description``, ``columns``: array of maps with a ``name``) as entities with one
    fact per column."""
    rest = lambda c: F.array_join(F.transform(F.filter(F.map_entries(c), lambda e: e["key"] != "name"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    fact = lambda c: F.concat(F.lit("column "), c["name"], F.when(rest(c) != "", F.concat(F.lit(": "), rest(c))).otherwise(""))
    d = docs.where("table IS NOT NULL AND table <> ''")
    return d.select(F.concat(F.lit(f"{kind}-"), slugify(F.col("table"))).alias("id"), F.col("table").alias("name"), F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Database table "), F.col("table"))).alias("description"), F.transform(F.filter("columns", lambda c: c["name"].isNotNull()), fact).alias("key_facts"), "path")
