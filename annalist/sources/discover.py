"""Finding where knowledge lives: directory statistics, classification, suspicious files, a capped plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Directory names and what they hold, the first that fits counts.
KINDS = (
    ("adr", "", "knowledge", ("adr", "adrs", "decisions", "decision-records", "kep", "keps", "rfc", "rfcs", "oteps", "teps", "proposals", "enhancements", "designs", "design-docs")),
    ("incident", "", "postmortem", ("postmortem", "postmortems", "post-mortems", "incidents", "outages", "retrospectives")),
    ("doc", "principle", "best practice", ("principles", "guidelines", "conventions", "best-practices", "standards", "contribute", "contributing")),
    ("doc", "changelog", "changes", ("changelog", "changelogs", "release-notes", "releases", "news")),
    ("doc", "design", "knowledge", ("docs", "doc", "documentation", "architecture", "design")),
)
GENERATED = ("auto-generated", "autogenerated", "automatically generated", "@generated", "do not edit", "code generated by", "this file is generated", "generated file", "generated by protoc", "generated documentation")
STRONG = ("do not edit", "@generated", "code generated by")
COMMENTS = ("<!--", "//", "#", "/*", "*", "--", ";", "%")
# Directories that hold no knowledge of their own, and files that list what is beside them.
SKIP_DIRS = ("node_modules", "venv", "target", "build", "dist", "vendor", "__pycache__", "site-packages", "testdata", "fixtures", "third_party", "thirdparty", "translations", "i18n", "locale", "locales", "l10n")
INDEX_FILES = ("readme.md", "readme", "index.md", "index.rst")
SAMPLES = 5
MIN_HERE, MIN_TREE, README_MIN, CAP = 3, 8, 5, 12
OUTLIER_LINES, OUTLIER_RATIO, MAX_SUSPECT = 800, 6, 5


def ancestors(path: Column) -> Column:
    """All directories above a file, from its own up to '.'."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), up)).otherwise(F.array(F.lit(".")))


def visible(path: Column) -> Column:
    """Whether no directory above a file is hidden or one of those that are skipped."""
    above = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return ~F.exists(above, lambda d: d.startswith(".") | F.lower(d).isin(*SKIP_DIRS))


def extension(name: Column) -> Column:
    """Ending of a file name; README and OWNERS stand for themselves, others without one for (none)."""
    end = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return F.when(end != "", end).when(name.isin("README", "OWNERS"), name).otherwise("(none)")


def extensions(files: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent endings below each directory: ``dir``, ``extension``, ``n``, ``rank``."""
    d = files.where(visible(F.col("path"))).select(F.explode(ancestors(F.col("path"))).alias("dir"), extension(F.element_at(F.split("path", "/"), -1)).alias("extension"))
    n = d.groupBy("dir", "extension").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "extension"))).where(F.col("rank") <= top)


def samples(files: DataFrame, top: int = SAMPLES) -> DataFrame:
    """The first knowledge files below each directory, its own before those of its directories: ``dir``, ``sample``, ``pos``.

    Ranked in chunks by hash first, so that no task orders all files of a large tree.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    d = files.where(visible(F.col("path")) & (F.endswith(name, F.lit(".md")) | (name == "README"))).select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    rest = F.when(F.col("dir") == ".", F.col("path")).otherwise(F.substring("path", F.length("dir") + 2, F.length("path")))
    d = d.withColumn("sample", rest).withColumn("order", F.transform(F.split("sample", "/"), lambda x, i: F.concat(F.when(i + 1 == F.size(F.split("sample", "/")), "0").otherwise("1"), x)))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("path"), F.lit(64)))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("dir", "chunk").orderBy("order"))).where(F.col("r") <= top)
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("dir").orderBy("order"))).where(F.col("pos") <= top).select("dir", "sample", F.col("pos").cast("bigint").alias("pos"))


def directory_stats(files: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """Knowledge files in and below each directory: ``dir``, ``here``, ``tree``, ``readmes``, ``has_index``, ``depth``.

    Hidden and skipped directories are left out.  ``nested`` (``repo``) names repositories inside the tree: their files
    count in their own directories only, whose depth starts there.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(visible(F.col("path")))
    if nested is None:
        d = files.select("path", name.alias("name"), F.explode(ancestors(F.col("path"))).alias("dir"), F.lit(".").alias("repo"))
    else:
        own = files.join(assigned_repo(files, nested), "path")
        inside = lambda x: (F.col("repo") == ".") | (x == F.col("repo")) | F.startswith(x, F.concat("repo", F.lit("/")))
        d = own.select("path", name.alias("name"), "repo", F.explode(F.filter(ancestors(F.col("path")), inside)).alias("dir"))
    knows = F.endswith(F.col("name"), F.lit(".md")) | (F.col("name") == "README")
    own = F.when(F.col("dir") == ".", F.col("name") == F.col("path")).otherwise(F.concat_ws("/", "dir", "name") == F.col("path"))
    n = lambda c: F.sum(c.cast("bigint"))
    d = d.groupBy("repo", "dir").agg(n(knows & own).alias("here"), n(knows).alias("tree"), n(F.col("name") == "README").alias("readmes"), F.coalesce(F.bool_or(own & F.lower("name").isin(*INDEX_FILES)), F.lit(False)).alias("has_index"))
    levels = F.size(F.split("dir", "/")) - F.when(F.col("repo") == ".", 0).otherwise(F.size(F.split("repo", "/")))
    return d.withColumn("depth", F.when(F.col("dir") == ".", 0).otherwise(levels).cast("bigint"))


def classify(name: Column) -> Column:
    """(adapter, kind, bucket) of a directory name, null if it says nothing."""
    key = F.regexp_replace(F.lower(name), "_", "-")
    out = F.lit(None).cast("struct<adapter:string,kind:string,bucket:string>")
    for adapter, kind, bucket, names in reversed(KINDS):
        out = F.when(key.isin(*names), F.struct(F.lit(adapter).alias("adapter"), F.lit(kind).alias("kind"), F.lit(bucket).alias("bucket"))).otherwise(out)
    return out


def candidates(stats: DataFrame, depth: int = 3) -> DataFrame:
    """Directories that may hold knowledge, with the reason: vocab, readme or volume."""
    c = classify(F.element_at(F.split("dir", "/"), -1))
    readme = (F.col("readmes") >= README_MIN) & (F.col("readmes") * 2 >= F.col("tree"))
    reason = F.when(c.isNotNull(), "vocab").when(readme, "readme").when((F.col("here") >= MIN_HERE) | (F.col("tree") >= MIN_TREE), "volume")
    d = stats.where((F.col("depth") > 0) & (F.col("depth") <= depth) & (F.col("tree") > 0)).withColumn("reason", reason).where("reason IS NOT NULL")
    adapter = F.when(F.col("reason") == "readme", "doc").otherwise(F.coalesce(c["adapter"], F.lit("")))
    kind = F.when(F.col("reason") == "readme", "design").otherwise(F.coalesce(c["kind"], F.lit("")))
    return d.select("dir", "depth", "here", "tree", "readmes", "reason", adapter.alias("adapter"), kind.alias("kind"))


def plan(found: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): classified directories without those whose nearest classified ancestor is of the same sort, the
    ``cap`` largest per top directory."""
    c = found.where("adapter <> ''").withColumn("sig", F.concat_ws("|", "adapter", "kind", F.when(F.col("reason") == "readme", "README").otherwise("*.md")))
    up = c.select("dir", "sig", "depth", F.explode(ancestors(F.concat(F.col("dir"), F.lit("/x")))).alias("above")).where("above <> dir")
    near = up.join(c.select(F.col("dir").alias("above"), F.col("sig").alias("sig2"), F.col("depth").alias("depth2")), "above").groupBy("dir").agg(F.max_by("sig2", "depth2").alias("sig2"))
    own = c.join(near, "dir", "left").where("sig2 IS NULL OR sig2 <> sig").drop("sig2", "sig")
    top = F.element_at(F.split("dir", "/"), 1)
    r = own.withColumn("repo", top).withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("tree"), "dir")))
    return r.where(F.col("r") <= cap).drop("r"), r.where(F.col("r") > cap).drop("r")


def generated_banner(text: Column) -> Column:
    """Whether a banner at the top says that the text was generated."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\A---\n.*?\n---", "")
    head = F.slice(F.filter(F.transform(F.split(rest, "\n"), lambda x: F.btrim(x)), lambda x: x != ""), 1, 6)

    def banner(x: Column, i: Column) -> Column:
        low = F.lower(x)
        has = lambda words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(True)) for w in words], F.lit(False))
        return (F.length(x) <= 200) & has(GENERATED) & (has(STRONG) | (i == 0) | F.coalesce(*[F.when(x.startswith(p), F.lit(True)) for p in COMMENTS], F.lit(False)))

    return F.exists(F.transform(head, banner), lambda b: b)


def outliers(files: DataFrame, key: str, min_lines: int = OUTLIER_LINES) -> DataFrame:
    """Texts far longer than the upper median of their group: at most five each, the longest first.

    The median of a group is read off its histogram of line counts.
    """
    d = files.where(F.col(key).isNotNull()).select(key, "path", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"))
    h = d.groupBy(key, "n_lines").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("n_lines")
    h = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    m = h.where("upto > total div 2 AND total >= 3").groupBy(key).agg(F.greatest(F.lit(1), F.min("n_lines")).alias("median"))
    hit = d.join(m, key).where((F.col("n_lines") >= min_lines) & (F.col("n_lines") >= OUTLIER_RATIO * F.col("median")))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_lines"), F.desc("path")))
    return hit.withColumn("r", r).where(F.col("r") <= MAX_SUSPECT).drop("r")


def assigned_repo(files: DataFrame, repos: DataFrame) -> DataFrame:
    """The longest repo prefix of each path ('.' if none): an equi-join on the path's own ancestors, not a prefix scan."""
    d = files.select("path", F.explode(ancestors(F.col("path"))).alias("repo")).join(repos.select("repo").distinct(), "repo", "left_semi")
    best = d.groupBy("path").agg(F.max_by("repo", F.length("repo")).alias("repo"))
    return files.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("repo", F.lit(".")).alias("repo"))
