"""Problem 7: one UTC instant for each stamp of the event log and the relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import zones
from annalist.functions.ids import WHITE, clean_id, clean_str
from annalist.functions.timestamps import CANONICAL, format_us, needs_source, shape_mask, with_instant


def formats_of(source_formats: DataFrame) -> DataFrame:
    """One row per source: ``f_source``, ``f_zone``, ``f_order``; of repeated sources the smallest values count."""
    return (
        source_formats.select(F.lower(clean_str(F.col("source"))).alias("f_source"), clean_str(F.col("zone")).alias("f_zone"), F.lower(clean_str(F.col("date_order"))).alias("f_order"))
        .where(F.col("f_source").isNotNull())
        .groupBy("f_source")
        .agg(F.min("f_zone").alias("f_zone"), F.min("f_order").alias("f_order"))
    )


def event_instants(events: DataFrame, source_formats: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of the event log plus ``instant_us``; rows without an instant keep a null.

    Only ``ts``, ``source`` and the kept columns are read.  A null or unknown source means UTC and day first.
    """
    d = events.select(*keep, *[c for c in ("ts", "source") if c not in keep])
    d = d.withColumn("f_key", F.lower(clean_str(F.col("source")))).join(formats_of(source_formats), F.col("f_key") == F.col("f_source"), "left")
    return with_instant(d, "ts", F.col("f_zone"), F.col("f_order")).select(*keep, "instant_us")


def relation_instants(relations: DataFrame, events: DataFrame, source_formats: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of the relations plus ``instant_us``.

    Stamps that name their zone and whose date is evident are converted at once; only the others are shuffled to
    their provenance event for its source.  Of an event with several rows the smallest source counts.
    """
    d = needs_source(relations.select(*keep, *[c for c in ("ts", "provenance") if c not in keep]), "ts")
    free = with_instant(d.where("NOT needs_source"), "ts").select(*keep, "instant_us")
    sources = (
        events.select(clean_id(F.col("id")).alias("f_event"), F.lower(clean_str(F.col("source"))).alias("f_key"))
        .where(F.col("f_event").isNotNull() & F.col("f_key").isNotNull())
        .groupBy("f_event")
        .agg(F.min("f_key").alias("f_key"))
    )
    open_ = d.where("needs_source").withColumn("f_prov", clean_id(F.col("provenance")))
    known = open_.where(F.col("f_prov").isNotNull()).join(sources, F.col("f_prov") == F.col("f_event"), "left").drop("f_event")
    unknown = open_.where(F.col("f_prov").isNull()).withColumn("f_key", F.lit(None).cast("string"))
    bound = known.unionByName(unknown).join(formats_of(source_formats), F.col("f_key") == F.col("f_source"), "left")
    return free.unionByName(with_instant(bound, "ts", F.col("f_zone"), F.col("f_order")).select(*keep, "instant_us"))


def found(events: DataFrame, relations: DataFrame, source_formats: DataFrame) -> DataFrame:
    """p7_found: each row whose ``ts`` denotes an instant and is not written ``yyyy-MM-ddTHH:mm:ssZ`` already."""
    e = event_instants(events, source_formats, ["row_id", "ts"]).withColumn("tbl", F.lit("event_log"))
    r = relation_instants(relations, events, source_formats, ["row_id", "ts"]).withColumn("tbl", F.lit("relations"))
    d = e.unionByName(r).where(F.col("instant_us").isNotNull() & ~F.col("ts").rlike(CANONICAL))
    return d.select("tbl", F.col("row_id").cast("bigint").alias("row_id"), format_us("instant_us").alias("ts_utc"))


def masks(events: DataFrame, relations: DataFrame, source_formats: DataFrame) -> DataFrame:
    """How stamps are written: ``tbl``, ``mask``, ``n_rows``, ``n_instants`` (how many of them denote an instant) and
    ``zone_version``, the release of the zone tables the instants rest on.  Masks without instants are those that the
    grammar does not know, or of impossible dates; null stamps have the mask ''."""
    e = event_instants(events, source_formats, ["row_id", "ts"]).withColumn("tbl", F.lit("event_log"))
    r = relation_instants(relations, events, source_formats, ["row_id", "ts"]).withColumn("tbl", F.lit("relations"))
    mask = F.coalesce(shape_mask(F.regexp_replace(F.btrim("ts", F.lit(WHITE)), r"\s+", " ")), F.lit(""))
    d = e.unionByName(r).groupBy("tbl", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("instant_us").alias("n_instants"))
    return d.withColumn("zone_version", F.lit(zones.version()))
