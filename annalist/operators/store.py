"""The graph tables as operators read them: tolerant rows, one per key, defaults filled in; and the log's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id
from annalist.functions.text import redact

# What may be written; older logs may hold more, which is read but never written.
EVENT_TYPES = ("incident", "adr", "pr_merged", "deploy", "config_change", "note", "release", "decision", "plan")
RETIRED_EVENT_TYPES = ("task_update",)
IMPACTS = ("low", "medium", "high")
TRUSTS = ("low", "normal", "high")


def _latest(d: DataFrame, key: str, order: list, ascending: bool = False) -> DataFrame:
    """One whole row per key by a map-side combined maximum (or minimum) instead of a sort per key."""
    cols = [c for c in d.columns if c not in (key, "o__")]
    best = (F.min_by if ascending else F.max_by)(F.struct(*cols), F.struct(*order))
    return d.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def event_log(events: DataFrame) -> DataFrame:
    """One row per event id, the last delivery; text fields are never null, impact, trust and source have defaults.

    Rows without an id are left out.  Fields beyond the known ones are ignored, unknown and retired types are kept.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    default = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    d = events.select(
        clean_id(F.col("id")).alias("id"), text("type"), text("ts"), text("title"), text("summary"), default("impact", "low"), default("trust", "normal"), text("body"), default("source", "manual"),
        F.coalesce("disputed", F.lit(False)).alias("disputed"), "domains", "actors", "refs", "supersedes", "derived_entities", "derived_relations", "seen_at", "row_id",
    ).where("id IS NOT NULL")
    return _latest(d, "id", ["seen_at", "row_id"])


def entities(table: DataFrame) -> DataFrame:
    """One row per entity id, the last by row_id; null statuses are active."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    default = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    d = table.select(
        clean_id(F.col("id")).alias("id"), text("type"), text("name"), text("description"), "aliases", "domains", default("status", "active"),
        F.coalesce(clean_id(F.col("superseded_by")), F.lit("")).alias("superseded_by"), text("summary"), "key_facts", "source_events", text("last_touched"), default("impact", "low"), "row_id",
    ).where("id IS NOT NULL")
    return _latest(d, "id", ["row_id"])


def relations(table: DataFrame) -> DataFrame:
    """One row per (source, predicate, target), the first by row_id."""
    d = table.select(
        clean_id(F.col("source")).alias("source"), "predicate", clean_id(F.col("target")).alias("target"),
        F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce(clean_id(F.col("provenance")), F.lit("")).alias("provenance"), "row_id",
    ).where("source IS NOT NULL AND predicate IS NOT NULL AND target IS NOT NULL")
    return d.groupBy("source", "predicate", "target").agg(F.min_by(F.struct("ts", "provenance", "row_id"), "row_id").alias("r")).select("source", "predicate", "target", "r.ts", "r.provenance", "r.row_id")


def month_of(ts: str = "ts") -> "F.Column":
    """Partition of a stamp: its first seven characters where they are a month, else ``undated``."""
    m = F.regexp_extract(F.btrim(F.col(ts)), r"^([0-9]{4}-(0[1-9]|1[0-2]))", 1)
    return F.when(m == "", F.lit("undated")).otherwise(m)


def valid_events(batch: DataFrame) -> DataFrame:
    """Adds ``problem``: why an event may not be written, null if it may."""
    kebab = F.forall(F.coalesce("domains", F.array().cast("array<string>")), lambda d: d.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"))
    why = (
        F.when(F.coalesce(clean_id(F.col("id")), F.lit("")) == "", "no id")
        .when(~F.coalesce(F.col("type").isin(*EVENT_TYPES), F.lit(False)), "type")
        .when(~F.coalesce(F.col("impact").isin(*IMPACTS), F.lit(True)), "impact")
        .when(~F.coalesce(F.col("trust").isin(*TRUSTS), F.lit(True)), "trust")
        .when(~F.coalesce(kebab, F.lit(False)), "domains")
    )
    return batch.withColumn("problem", why)


def redacted(events: DataFrame) -> DataFrame:
    """Events with secrets replaced in title, summary and body, and in the texts of derived entities."""
    d = events.withColumns({c: redact(F.col(c)) for c in ("title", "summary", "body") if c in events.columns})
    if "derived_entities" in d.columns:
        fields = [f.name for f in d.schema["derived_entities"].dataType.elementType.fields]

        def scrub(e):
            out = []
            for f in fields:
                if f in ("name", "description"):
                    out.append(redact(e[f]).alias(f))
                elif f == "profile":
                    out.append(F.struct(redact(e[f]["summary"]).alias("summary"), F.transform(e[f]["key_facts"], redact).alias("key_facts")).alias(f))
                else:
                    out.append(e[f].alias(f))
            return F.struct(*out)

        d = d.withColumn("derived_entities", F.transform("derived_entities", scrub))
    return d


def new_events(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The events of a batch whose ids the log lacks, one per id."""
    return one_per_id(batch.join(log.select("id"), "id", "left_anti"))


def one_per_id(batch: DataFrame) -> DataFrame:
    """The last row of each id by (``seen_at``, ``row_id``), as far as the batch has these, then by all its text."""
    order = [F.col(c) for c in ("seen_at", "row_id") if c in batch.columns]
    return _latest(batch, "id", [*order, F.xxhash64(*[c for c in batch.columns])]).select(*batch.columns)


def exists(spark, path: str) -> bool:
    """Whether there is a table at ``path``; errors other than its absence are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(batch: DataFrame, path: str) -> None:
    """Upsert a batch into the log at ``path``, partitioned by month: redacted, later rows replace those of their id.

    Only the months that the batch or the replaced rows lie in are rewritten.
    """
    spark = batch.sparkSession
    new = redacted(batch).withColumn("month", month_of())
    if not exists(spark, path):  # the first batch
        one_per_id(new).repartition("month").sortWithinPartitions("month", "ts", "id").write.partitionBy("month").parquet(path)
        return
    old = spark.read.parquet(path)
    from annalist.session import cut

    new = cut(one_per_id(new), "batch")
    hit = old.join(new.select("id"), "id", "left_semi").select("month").unionByName(new.select("month")).distinct()
    kept = old.join(hit, "month", "left_semi").join(new.select("id"), "id", "left_anti")
    merged = cut(kept.unionByName(new, allowMissingColumns=True), "merged")
    emptied = [r["month"] for r in hit.join(merged.select("month").distinct(), "month", "left_anti").collect()]
    (merged.repartition("month").sortWithinPartitions("month", "ts", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))
    from annalist.session import drop_path

    for m in emptied:  # months whose last event moved away
        drop_path(spark, f"{path}/month={m}")


def compact(path: str) -> None:
    """Rewrite every month of the log as one sorted file."""
    from pyspark.sql import SparkSession

    from annalist.session import cut

    spark = SparkSession.getActiveSession()
    d = cut(spark.read.parquet(path), "compact")
    d.repartition("month").sortWithinPartitions("month", "ts", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def alias_map(links: DataFrame) -> DataFrame:
    """``alias`` -> ``canonical`` of accepted links; of several targets of an alias the first by row_id counts."""
    d = links.where("is_match").select(clean_id(F.col("alias")).alias("alias"), clean_id(F.col("canonical")).alias("canonical"), "row_id")
    d = d.where("alias IS NOT NULL AND canonical IS NOT NULL AND alias <> canonical")
    return d.groupBy("alias").agg(F.min_by("canonical", "row_id").alias("canonical"))


def ordered(log: DataFrame) -> DataFrame:
    """The log in its total order: raw ``ts`` as text, then id."""
    return log.orderBy("ts", "id")


def running_position(log: DataFrame, partition: str = "month") -> DataFrame:
    """Adds ``pos``: rank of an event in the total order, counted month by month with carried totals."""
    d = log.withColumn(partition, F.substring("ts", 1, 7))
    n = d.groupBy(partition).agg(F.count(F.lit(1)).alias("n"))
    base = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return d.withColumn("pos", F.row_number().over(Window.partitionBy(partition).orderBy("ts", "id"))).join(F.broadcast(base), partition).withColumn("pos", F.col("pos") + F.col("before")).drop("before", partition)
