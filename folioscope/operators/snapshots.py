"""Changes between consecutive full snapshots, by gaps and islands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import written

#: Up to so many deliveries their list is broadcast (20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _ordinals(df: DataFrame, snapshot: str) -> DataFrame:
    """``(_id, _ord, _following)``: the deliveries in order; one row for each, so the window over all of them is small."""
    ids = df.select(F.col(snapshot).alias("_id")).where("_id IS NOT NULL").distinct()
    in_order = Window.orderBy("_id")
    return ids.select("_id", F.row_number().over(in_order).alias("_ord"), F.lead("_id").over(in_order).alias("_following"))


def validity_intervals(df: DataFrame, snapshot: str, key: str, compared: Mapping[str, Column]) -> DataFrame:
    """One row per maximal run of consecutive snapshots in which ``key`` kept the same compared values.

    Columns: the key, ``first_snapshot``, ``first_ord``, ``last_ord``, ``following_snapshot`` (the
    delivery after the run, null at the end), ``row_hash`` and the compared values. Ordinals number
    the deliveries present in ``df``, so gaps in the ids do not matter and neither does arrival
    order. A key delivered repeatedly in one snapshot counts once; if its copies differ, the least
    values (nulls first) stand. Null is a value of its own among the compared columns. Rows without key or snapshot id belong to no record
    and are left out. An empty table gives no rows.

    Copies are combined before the shuffle, and a window then holds at most one row of a key per
    snapshot, so no key can grow into a large task.
    """
    order = written(_ordinals(df, snapshot), "deliveries")
    if order.count() <= BROADCAST_ROWS:
        order = F.broadcast(order)
    names = list(compared)
    narrow = df.where(F.col(key).isNotNull()).select(F.col(snapshot).alias("_id"), F.col(key).alias("_key"), F.struct(*[c.alias(n) for n, c in compared.items()]).alias("_values"))
    once = (
        narrow.join(order, "_id")
        .groupBy("_key", "_ord", "_id", "_following")
        .agg(F.min("_values").alias("_values"))
        .withColumn("_hash", F.md5(F.to_json("_values")))
    )
    by_time = Window.partitionBy("_key").orderBy("_ord")
    breaks = (F.lag("_ord").over(by_time) == F.col("_ord") - 1) & (F.lag("_hash").over(by_time) == F.col("_hash"))
    islands = once.withColumn("_starts", F.when(F.coalesce(breaks, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_starts").over(by_time))
    return islands.groupBy("_key", "_island").agg(
        F.min_by("_id", "_ord").alias("first_snapshot"),
        F.min("_ord").alias("first_ord"),
        F.max("_ord").alias("last_ord"),
        F.max_by("_following", "_ord").alias("following_snapshot"),
        F.first("_hash").alias("row_hash"),
        *[F.first(F.col("_values")[n]).alias(n) for n in names],
    ).withColumnRenamed("_key", key).drop("_island")


def snapshot_changes(df: DataFrame, snapshot: str, key: str, compared: Mapping[str, Column]) -> DataFrame:
    """``(snapshot, key, change_kind)`` for every two consecutive deliveries.

    The start of an interval is ``added`` or, right after another interval, ``changed``; an end
    without an adjacent successor is ``removed`` in the following snapshot. The first snapshot has
    no changes. See :func:`validity_intervals` for nulls, copies and empty tables.
    """
    spans = validity_intervals(df, snapshot, key, compared)
    by_time = Window.partitionBy(key).orderBy("first_ord")
    adjacent = F.coalesce(F.lag("last_ord").over(by_time) == F.col("first_ord") - 1, F.lit(False))
    succeeded = F.coalesce(F.lead("first_ord").over(by_time) == F.col("last_ord") + 1, F.lit(False))
    started = F.when(F.col("first_ord") > 1, F.struct(F.col("first_snapshot").alias("at"), F.when(F.col("adjacent"), "changed").otherwise("added").alias("kind")))
    ended = F.when(F.col("following_snapshot").isNotNull() & ~F.col("succeeded"), F.struct(F.col("following_snapshot").alias("at"), F.lit("removed").alias("kind")))
    return (
        spans.select(key, "first_ord", "first_snapshot", "following_snapshot", adjacent.alias("adjacent"), succeeded.alias("succeeded"))
        .select(key, F.explode(F.array_compact(F.array(started, ended))).alias("event"))
        .select(F.col("event.at").alias(snapshot), key, F.col("event.kind").alias("change_kind"))
    )
