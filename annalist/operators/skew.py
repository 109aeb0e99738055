"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; there can be at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.005


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """Keys that hold at least ``share`` of the rows and ``least`` rows; at most 1 / share values reach the driver.

    A key of fewer than ``least`` rows cannot burden a task, so it is never treated apart; results are the same.
    """
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n")).limit(int(1 / share)).collect()
    if not top:
        return []
    total = rows.count()
    return [r[0] for r in top if r["n"] >= share * total]


def largest(counts: DataFrame, key: str, n: str = "n", most: int = int(1 / HOT_SHARE), least: int = 10_000) -> list:
    """Of counted keys those with the most rows, at most ``most`` and each with ``least`` rows or more."""
    return [r[0] for r in counts.where(F.col(n) >= least).orderBy(F.desc(n), key).limit(most).select(key).collect()]


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE, hot: list | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per key, without sending a hot key to one task.

    Rows of hot keys stay where they are and meet their few lookup rows by broadcast (their number is bounded by
    1 / share); all others are shuffled.  ``hot`` may be given where it has been found already.
    """
    if hot is None:
        hot = hot_keys(rows, key, share)
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = rows.where(~is_hot).join(lookup, key, how)
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(lookup.where(F.col(key).isin(hot))), key, how))
