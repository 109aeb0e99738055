"""Ordered scans over keyed series that split hot keys.

A window over ``partitionBy(key).orderBy(time)`` puts a whole key into one task, and one key may hold a third of all
rows.  The scans here cut every series into time chunks, scan inside (key, chunk), and carry one summary row per chunk
across.  Keys that hold many rows get finer chunks.  A key may be split into at most ``SPAN / width`` chunks, so the
window over chunk summaries has a bounded number of rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.timestamps import DAY_US
from annalist.operators.skew import join_unique, largest
from annalist.session import cut

#: Width of a chunk in days for keys with few rows; a power of two times this many microseconds divides evenly.
WIDTH_DAYS = 128
#: Rows of a key for which one chunk width is meant; keys with more get chunks 2, 4, ... times finer.
ROWS_PER_CHUNK = 256
#: Finest division of a chunk (the shortest chunk is then three hours).
MAX_SPLIT = 1024


def split_factors(rows: DataFrame, key: str, per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, list]:
    """(``key`` and ``split`` of the keys that need finer chunks, the largest keys), from counts made map side first."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    split = F.least(F.lit(MAX_SPLIT), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / F.lit(per_chunk)))).cast("bigint"))
    factors = cut(n.where(F.col("n") > per_chunk).select(key, "n", split.cast("bigint").alias("split")), "split")
    return factors.select(key, "split"), largest(factors, key)


def with_chunk(rows: DataFrame, factors: tuple[DataFrame, list], key: str, time_us: str, width_days: int = WIDTH_DAYS) -> DataFrame:
    """Adds ``split`` and ``chunk``, the number of the chunk of ``time_us``; rows of the largest keys are not shuffled."""
    d = join_unique(rows, factors[0], key, "left", hot=factors[1]).withColumn("split", F.coalesce("split", F.lit(1).cast("bigint")))
    return d.withColumn("chunk", chunk_of(F.col(time_us), F.col("split"), width_days))


def _width(split: Column, width_days: int) -> Column:
    return F.call_function("div", F.lit(width_days * DAY_US), split)


def chunk_of(time_us: Column, split: Column, width_days: int = WIDTH_DAYS) -> Column:
    """Number of the chunk of an instant, rounded down also before 1970."""
    w = _width(split, width_days)
    return F.call_function("div", time_us - F.pmod(time_us, w), w)


def chunk_start(chunk: Column, split: Column, width_days: int = WIDTH_DAYS) -> Column:
    """First microsecond of a chunk."""
    return chunk * _width(split, width_days)


def lag_across(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the row before in its key, also across chunks; needs ``chunk``.

    ``order`` must be unique in a key.  The last value of each chunk is carried to the next chunk that has rows.
    """
    inner = Window.partitionBy(key, "chunk").orderBy(*order)
    d = rows.withColumn("c_lag", F.lag(value).over(inner)).withColumn("c_first", F.row_number().over(inner) == 1)
    ends = rows.groupBy(key, "chunk").agg(F.max_by(value, F.struct(*order)).alias("c_end"))
    carried = ends.select(key, "chunk", F.lag("c_end").over(Window.partitionBy(key).orderBy("chunk")).alias("c_in"))
    return d.join(carried, [key, "chunk"], "left").withColumn(out, F.when(F.col("c_first"), F.col("c_in")).otherwise(F.col("c_lag"))).drop("c_lag", "c_first", "c_in")


def lead_across(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the row after in its key, also across chunks; needs ``chunk``."""
    inner = Window.partitionBy(key, "chunk").orderBy(*order)
    last = Window.partitionBy(key, "chunk").orderBy(*[F.col(o).desc() for o in order])
    d = rows.withColumn("c_lead", F.lead(value).over(inner)).withColumn("c_last", F.row_number().over(last) == 1)
    starts = rows.groupBy(key, "chunk").agg(F.min_by(value, F.struct(*order)).alias("c_start"))
    carried = starts.select(key, "chunk", F.lead("c_start").over(Window.partitionBy(key).orderBy("chunk")).alias("c_out"))
    return d.join(carried, [key, "chunk"], "left").withColumn(out, F.when(F.col("c_last"), F.col("c_out")).otherwise(F.col("c_lead"))).drop("c_lead", "c_last", "c_out")
