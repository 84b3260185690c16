"""File names made unique in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators.neighbours import running_by
from folioscope.runtime import written


def unique_names(files: DataFrame, folder: str, arrival: str, name: str) -> DataFrame:
    """``(arrival, folder, name)``: the first file of a name keeps it, the next ones become ``base-0.ext``, ``base-1.ext`` and so on.

    A made name may also be one that a file was given. Of two files with one name the one that arrived first keeps it;
    the other passes on to the next number of its own name, and so do the files of that name after it, one such step for a
    name in each round. Since a taken name is only ever taken over by a file that arrived earlier, the rounds end with what
    naming one by one gives; there are as many as a name meets taken ones, mostly none. Files without name are left
    out. ``arrival`` must be unique.
    """
    base = ["_folder", "_base"]
    rows = files.where(F.col(name).isNotNull()).select(F.col(arrival).alias("_at"), F.col(folder).alias("_folder"), F.col(name).alias("_base"))
    made = running_by(rows, base, "_at", F.lit(1), "_nth")
    ext = urls.extension(F.col("_base"))
    stem = F.col("_base").substr(F.lit(1), F.length("_base") - F.length(ext))
    while True:
        named = written(made.withColumn("_name", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat(stem, F.lit("-"), (F.col("_nth") - 2).cast("string"), ext))), "names")
        holder = named.groupBy("_folder", "_name").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_folder").alias("_f"), F.col("_name").alias("_m"), "_first")
        if holder.isEmpty():
            return named.select(F.col("_at").alias(arrival), F.col("_folder").alias(folder), F.col("_name").alias(name))
        met = named.join(holder, F.col("_folder").eqNullSafe(F.col("_f")) & (F.col("_name") == F.col("_m")), "left")
        first_late = met.where(F.col("_at") > F.col("_first")).groupBy("_folder", "_base").agg(F.min("_at").alias("_from")).select(F.col("_folder").alias("_f"), F.col("_base").alias("_b"), "_from")
        moved = named.join(first_late, F.col("_folder").eqNullSafe(F.col("_f")) & (F.col("_base") == F.col("_b")), "left")
        later = F.coalesce(F.col("_at") >= F.col("_from"), F.lit(False))
        made = moved.select("_at", *base, (F.col("_nth") + F.when(later, 1).otherwise(0)).alias("_nth"))
