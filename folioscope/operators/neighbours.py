"""Predecessor of each row in its sequence, without putting a whole sequence into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import written


def with_previous(df: DataFrame, sequence: str, position: str, carry: str, into: str, block: int = 1024) -> DataFrame:
    """Add ``into``: the ``carry`` value of the row before in ``sequence`` by the number ``position``.

    One sequence may hold a third of all rows, so it is cut into blocks of ``block`` positions: a
    window finds the predecessor inside a block, a second window over one summary row per block
    supplies the predecessor of each block's first row. Rows need a non-null sequence and position;
    positions must be unique in a sequence. The first row of a sequence gets null.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    inside = Window.partitionBy(sequence, "_block").orderBy(position)
    edges = blocked.groupBy(sequence, "_block").agg(F.max_by(carry, position).alias("_last"))
    before = edges.withColumn("_carried", F.lag("_last").over(Window.partitionBy(sequence).orderBy("_block")))
    return (
        blocked.withColumn("_inside", F.lag(carry).over(inside))
        .join(before.drop("_last"), [sequence, "_block"])
        .withColumn(into, F.coalesce("_inside", "_carried"))
        .drop("_block", "_inside", "_carried")
    )


def running_total(df: DataFrame, position: str, amount: Column, into: str, block: int = 100_000) -> DataFrame:
    """Add ``into``: the sum of ``amount`` over all rows up to and including this one by ``position``.

    A global running sum, taken inside blocks of ``block`` positions and over the block totals, so
    no task sees more than one block or one row per block. Rows need a non-null, unique position.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_amount", amount.cast("bigint"))
    totals = blocked.groupBy("_block").agg(F.sum("_amount").alias("_total"))
    # One row per block: the only window over all of them.
    ahead = totals.select("_block", (F.sum("_total").over(Window.orderBy("_block")) - F.col("_total")).alias("_ahead"))
    inside = Window.partitionBy("_block").orderBy(position)
    return blocked.withColumn("_inside", F.sum("_amount").over(inside)).join(ahead, "_block").withColumn(into, F.col("_inside") + F.col("_ahead")).drop("_block", "_amount", "_inside", "_ahead")


def numbered(df: DataFrame, order: str, into: str) -> DataFrame:
    """Add ``into``: the number of each row by ``order``, from 0, without sorting all rows in one task.

    Rows are range-sorted and written, numbered inside their part, and moved up by the sizes of the parts before. Rows with
    equal ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))  # one row per part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_inside", inside).join(ahead, "_part").withColumn(into, F.col("_inside") + F.col("_ahead")).drop("_part", "_inside", "_ahead")


def running_by(df: DataFrame, keys: list[str], order: str, amount: Column, into: str) -> DataFrame:
    """Add ``into``: the sum of ``amount`` over the rows of the same ``keys`` up to and including this one by ``order``.

    Rows are range-sorted by key and order and written, so a key with a third of all rows is cut over many tasks; sums are taken
    inside a part and over the parts of a key. Null keys equal each other; ``order`` must be unique within a key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.withColumn("_amount", amount.cast("bigint")).repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = placed.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_part")
    ahead = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.sum("_n").over(along) - F.col("_n")).alias("_ahead"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.sum("_amount").over(Window.partitionBy(*keys, "_part").orderBy(order))
    return placed.withColumn("_inside", inside).join(ahead, same).withColumn(into, F.col("_inside") + F.col("_ahead")).select(*df.columns, into)
