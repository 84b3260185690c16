"""Per-key results over very unevenly filled keys, by value-frequency compression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import written


def value_frequencies(df: DataFrame, key: str, measures: Mapping[str, Column], latest: Column | None = None) -> DataFrame:
    """``(key, measure, value, freq, latest)``: how often each key holds each value of each measure.

    Grouping by key *and* value spreads a hot key over all tasks; equal pairs are combined before
    the shuffle. A null key is a key of its own; null values are kept with their frequency.
    """
    at = latest if latest is not None else F.lit(None).cast("timestamp")
    stacked = df.select(
        F.col(key).alias("_key"),
        at.alias("_at"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("string").alias("value")) for n, c in measures.items()])).alias("_m"),
    )
    return stacked.groupBy(F.col("_key").alias(key), F.col("_m.measure").alias("measure"), F.col("_m.value").alias("value")).agg(F.count(F.lit(1)).alias("freq"), F.max("_at").alias("latest"))


def keyed_profile(df: DataFrame, key: str, rows: str, distinct: Mapping[str, Column], labelled: tuple[Column, Column, Sequence[str]], latest: Column) -> DataFrame:
    """One row per key: row count, exact distinct counts, distinct ids per label, latest time, share of all rows.

    ``rows`` is the result name of the row count; ``distinct`` maps result names to columns counted by
    distinct non-null value (at least one); ``labelled`` is (id, label, labels): distinct ids per label come out as
    ``n_<label>``, any other or null label as ``n_other``. The weighted values of each key are
    reduced to one partial row per task before they meet, so a key with a third of all rows costs
    its final task no more than the number of map tasks.
    """
    ident, label, labels = labelled
    measures = {f"d:{n}": c for n, c in distinct.items()} | {"label": F.concat_ws("\x1f", F.coalesce(label.cast("string"), F.lit("")), F.coalesce(ident.cast("string"), F.lit("")))}
    freq = value_frequencies(df, key, measures, latest)
    of = lambda m: F.col("measure") == m
    tag = F.substring_index("value", "\x1f", 1)
    counted = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    every_row = of("label")  # this measure is never null, and as fine as the rows
    return freq.groupBy(key).agg(
        F.sum(F.when(every_row, F.col("freq")).otherwise(0)).cast("bigint").alias(rows),
        *[counted(of(f"d:{n}") & F.col("value").isNotNull()).alias(n) for n in distinct],
        *[counted(of("label") & (tag == v)).alias(f"n_{v}") for v in labels],
        counted(of("label") & ~tag.isin(*labels)).alias("n_other"),
        F.max(F.when(every_row, F.col("latest"))).alias("latest"),
    )


def heavy_keys(profile: DataFrame, count: str, percent: int) -> DataFrame:
    """Rows of ``profile`` whose ``count`` is at least ``percent`` of the total, as an exact integer test.

    The total is a scalar subquery over the (small) profile; no row is joined with every other.
    """
    total = profile.agg(F.sum(count)).scalar()
    return profile.where(F.col(count) * 100 >= total * percent)


def weighted_quantiles(df: DataFrame, key: str, value: str, at: Sequence[float], parts: int | None = None) -> DataFrame:
    """Exact lower quantiles and the mode of ``value`` per key, in its own type: ``(key, n, mode, q_<percent>...)``.

    Values are compressed to frequencies, and these are range-sorted by key and value over ``parts`` tasks, so that a
    hot key is cut where its weight lies, however its values are spread. A window over a key's weights by part (at most
    ``parts`` rows) finds the part of each rank; a second window orders the values inside a part. Null values are left
    out; a key with no value does not appear. Ties of the mode go to the smallest value.
    """
    spark = df.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    freq = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    # Written, since the borders of a range sort are drawn anew in every run.
    placed = written(freq.repartitionByRange(parts, "k", "v").withColumn("b", F.spark_partition_id()), "value-ranges")
    best = F.min(F.struct((-F.col("w")).alias("w"), F.col("v").alias("v")))
    spans = placed.groupBy("k", "b").agg(F.sum("w").alias("bw"), best.alias("best"))
    cumulative = Window.partitionBy("k").orderBy("b")
    whole = Window.partitionBy("k")
    spans = spans.select("k", "b", "bw", (F.sum("bw").over(cumulative) - F.col("bw")).alias("below"), F.sum("bw").over(whole).alias("n"), F.min("best").over(whole).alias("best"))
    ranks = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.ceil(F.col("n") * q), F.lit(1)).alias("rank")) for q in at]))
    wanted = spans.select("k", "b", "below", "n", "best", "bw", ranks.alias("r")).where((F.col("r.rank") > F.col("below")) & (F.col("r.rank") <= F.col("below") + F.col("bw")))
    ordered = placed.withColumn("upto", F.sum("w").over(Window.partitionBy("k", "b").orderBy("v"))).withColumnRenamed("k", "_k").withColumnRenamed("b", "_b")
    reached = F.col("below") + F.col("upto")
    hits = ordered.join(wanted, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_b") == F.col("b"))).where((reached >= F.col("r.rank")) & (reached - F.col("w") < F.col("r.rank")))
    return hits.groupBy(F.col("k").alias(key)).agg(
        F.max("n").alias("n"),
        F.min("best")["v"].alias("mode"),
        *[F.max(F.when(F.col("r.q") == q, F.col("v"))).alias(f"q_{round(q * 100)}") for q in at],
    )
