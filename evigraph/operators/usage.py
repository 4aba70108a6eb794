"""Budgets and usage history: running totals, thresholds and deltas. Windows are per key and range, never over a whole table or key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import cut


def _ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows in sorted ranges of (key, order), each with its range as ``_part``: a key with many rows spans several tasks."""
    return cut(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def ledger(calls: DataFrame, key: str, order: list[str], credits: str, limit: float, warn: float = 0.8) -> DataFrame:
    """Adds used_before, allowed (what was used before is below ``limit``), and warned: the first row at which the share of
    the limit reaches ``warn``. ``order`` must be total within a key.

    Running sums within sorted ranges, shifted by the sums of the ranges before, so a hot key is not one task's work.
    """
    rows = _ranged(calls.where(F.col(key).isNotNull()), key, order)
    per = rows.groupBy(key, "_part").agg(F.sum(credits).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(credits).over(inside), F.lit(0))
    out = rows.withColumn("_before", before).join(per, [key, "_part"]).withColumn("used_before", F.col("_before") + F.col("_shift")).drop("_part", "_before", "_shift")
    after = F.col("used_before") + F.coalesce(F.col(credits), F.lit(0))
    return out.withColumn("allowed", F.col("used_before") < limit).withColumn("warned", (after >= warn * limit) & (F.col("used_before") < warn * limit))


def used_fraction(queries, credits, max_queries, max_credits):
    """Largest share of the limits that are set (above 0)."""
    return F.greatest(*[F.when(m > 0, u / m).otherwise(0.0) for u, m in ((queries, max_queries), (credits, max_credits))])


def usage_deltas(history: DataFrame) -> DataFrame:
    """Adds delta to rows of (key_tail, timestamp, key_usage, credits_used): usage, or credits, less the previous row's usage.

    Rows without key are dropped; the last row of a range is carried into the next."""
    rows = _ranged(history.where("key_tail IS NOT NULL"), "key_tail", ["timestamp", "ord"])
    last = rows.groupBy("key_tail", "_part").agg(F.max_by("key_usage", F.struct("timestamp", "ord")).alias("_last"))
    last = last.select("key_tail", "_part", F.lag("_last").over(Window.partitionBy("key_tail").orderBy("_part")).alias("_carried"))
    w = Window.partitionBy("key_tail", "_part").orderBy("timestamp", "ord")
    before = F.when(F.row_number().over(w) > 1, F.lag("key_usage").over(w)).otherwise(F.col("_carried"))
    return rows.join(last, ["key_tail", "_part"]).withColumn("delta", F.coalesce("key_usage", "credits_used") - before).drop("_part", "_carried")


def tail(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")
