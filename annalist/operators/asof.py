"""Problem 2: attributes of entities as they were valid and already seen at the time of an event.

States are bitemporal: a state counts at an instant only if neither its ``valid_from`` nor its ``seen_at`` lies after
it, and of the states that count the one with the latest (``valid_from``, ``seen_at``, ``row_id``) holds.  What is
known changes only at the instants ``greatest(valid_from, seen_at)``; between two of them one state holds.  These
validity intervals are exploded into the time buckets in which events of the entity lie, so that events meet them by an
equi-join on entity and bucket with half-open containment, and no event ever meets the whole history of an entity.
Entities with many states or events get finer buckets, and buckets that still hold very many events are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ids import clean_id, clean_str
from annalist.functions.timestamps import to_us
from annalist.operators import chunked
from annalist.operators.instants import event_instants
from annalist.session import cut, cut_counted, cut_observed

#: A bucket with more events than this, and than this part of all events, is salted; at most SALTED buckets can be.
SALT_ROWS, SALTED = 100_000, 10_000


def known_states(*tables: DataFrame) -> DataFrame:
    """Distinct usable states of all tables: ``entity_id``, ``known_us`` and ``state`` (ordered by precedence).

    Rows without an id, a status, ``valid_from`` or ``seen_at`` say nothing and are left out.
    """
    parts = [
        t.select(
            clean_id(F.col("id")).alias("entity_id"),
            F.struct(to_us("valid_from").alias("valid_us"), to_us("seen_at").alias("seen_us"), F.col("row_id").cast("bigint").alias("row_id"), clean_str(F.col("status")).alias("status"), F.coalesce(clean_id(F.col("superseded_by")), F.lit("")).alias("superseded_by")).alias("state"),
        )
        for t in tables
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.where("entity_id IS NOT NULL AND state.status IS NOT NULL AND state.valid_us IS NOT NULL AND state.seen_us IS NOT NULL")
    d = d.withColumn("known_us", F.greatest("state.valid_us", "state.seen_us"))
    # Of the states that become known at one instant only the strongest can ever hold.
    return d.groupBy("entity_id", "known_us").agg(F.max("state").alias("state"))


def validity(states: DataFrame, used: DataFrame, width_days: int = chunked.WIDTH_DAYS) -> DataFrame:
    """Pieces of validity in the ``used`` buckets (``entity_id``, ``chunk``, ``split``): ``entity_id``, ``chunk``,
    ``from_us``, ``to_us``, ``state``; at most one covers an instant.

    ``states`` carry their ``chunk``.  Inside (entity, chunk) a running maximum gives the state that holds after each
    change; the maximum of all earlier chunks is carried in as one row at the start of a used chunk.  Chunks without
    events give nothing, so a stamp in the far past or future adds one row at most.
    """
    tops = states.groupBy("entity_id", "chunk").agg(F.max("state").alias("top")).withColumn("split", F.lit(None).cast("bigint"))
    both = tops.unionByName(used.select("entity_id", "chunk", F.lit(None).cast(tops.schema["top"].dataType).alias("top"), "split"))
    # One row per chunk with a state or an event, so the window holds a bounded number of rows per entity.
    earlier = Window.partitionBy("entity_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    marks = both.groupBy("entity_id", "chunk").agg(F.max("top").alias("top"), F.max("split").alias("split")).withColumn("carry", F.max("top").over(earlier)).where("split IS NOT NULL")
    starts = marks.where("carry IS NOT NULL").select("entity_id", "chunk", "split", chunked.chunk_start(F.col("chunk"), F.col("split"), width_days).alias("from_us"), F.col("carry").alias("state"))
    inner = Window.partitionBy("entity_id", "chunk").orderBy("known_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changes = states.select("entity_id", "chunk", "known_us", "state").join(marks.where("top IS NOT NULL").select("entity_id", "chunk", "split", "carry"), ["entity_id", "chunk"]).withColumn("best", F.max("state").over(inner))
    changes = changes.select("entity_id", "chunk", "split", F.col("known_us").alias("from_us"), F.when(F.col("carry") > F.col("best"), F.col("carry")).otherwise(F.col("best")).alias("state"))
    # A change at the very start of a chunk leaves the carried row an empty piece; it contains no instant.
    pieces = changes.unionByName(starts)
    after = F.lead("from_us").over(Window.partitionBy("entity_id", "chunk").orderBy("from_us", F.col("state")))
    pieces = pieces.withColumn("to_us", F.coalesce(after, chunked.chunk_start(F.col("chunk") + 1, F.col("split"), width_days)))
    return pieces.where("to_us > from_us").select("entity_id", "chunk", "from_us", "to_us", "state")


def referred(events: DataFrame, source_formats: DataFrame) -> DataFrame:
    """Distinct (``event_id``, ``entity_id``, ``instant_us``) of the refs of kind ``entity`` of events with an instant.

    Several rows of one event id are one event; its instant is the smallest that its rows denote.
    """
    named = F.filter("refs", lambda r: (F.lower(clean_str(r["kind"])) == "entity") & clean_id(r["id"]).isNotNull())
    d = event_instants(events.withColumn("named", F.transform(named, lambda r: clean_id(r["id"]))), source_formats, ["id", "named"])
    d = d.where(F.col("instant_us").isNotNull() & (F.size("named") > 0)).select(clean_id(F.col("id")).alias("event_id"), "named", "instant_us")
    d = d.where(F.col("event_id").isNotNull()).select("event_id", "instant_us", F.explode(F.array_distinct("named")).alias("entity_id"))
    return d.groupBy("event_id", "entity_id").agg(F.min("instant_us").alias("instant_us"))


def found(events: DataFrame, states: list[DataFrame], source_formats: DataFrame, width_days: int = chunked.WIDTH_DAYS) -> DataFrame:
    """p2_found: each event with an instant and entity it names, with the state known and valid then.

    Events before the first known state of an entity, and entities without states, give no row.  Empty tables give no
    rows.
    """
    points, total = cut_counted(referred(events, source_formats), "points")
    known = cut(known_states(*states), "known")
    factors = chunked.split_factors(points.select("entity_id").unionByName(known.select("entity_id")), "entity_id")
    left = chunked.with_chunk(points, factors, "entity_id", "instant_us", width_days)
    used, busiest = cut_observed(left.groupBy("entity_id", "chunk", "split").agg(F.count(F.lit(1)).alias("n")), "used", F.max("n"))
    right = validity(chunked.with_chunk(known, factors, "entity_id", "known_us", width_days), used, width_days)
    keys = ["entity_id", "chunk"]
    limit = max(SALT_ROWS, total // SALTED)
    if (busiest or 0) > limit:
        # At most SALTED buckets hold that many events.
        salts = F.broadcast(used.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("bigint").alias("salts")))
        left = left.join(salts, keys, "left").withColumn("salt", F.pmod(F.xxhash64("event_id"), F.coalesce("salts", F.lit(1).cast("bigint")))).drop("salts")
        right = right.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts") - 1, F.lit(0).cast("bigint"))))).drop("salts")
        keys = [*keys, "salt"]
    d = left.join(right, keys).where("instant_us >= from_us AND instant_us < to_us")
    return d.select("event_id", "entity_id", F.col("state.status").alias("status"), F.col("state.superseded_by").alias("superseded_by"))
