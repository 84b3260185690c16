"""Manifest upkeep and windowed counts as files and links keep arriving."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.operators.manifest import upsert
from folioscope.runtime import read_text, remove, write_lines


class ManifestTable:
    """A manifest in buckets by URL, of which an upsert reads and writes only those it touches.

    ``manifest.json`` names, for each bucket, the folder that holds it, the last batch and the greatest position. It is
    replaced after the new folders are written, so a batch that fails half way, or is run again, changes nothing twice.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.state: dict = json.loads(read_text(spark, f"{folder}/manifest.json") or "null")

    @classmethod
    def create(cls, entries: DataFrame, folder: str, buckets: int = 64) -> ManifestTable:
        table = cls(entries.sparkSession, folder)
        top = entries.agg(F.max("entry_pos")).first()[0]
        table.state = {"buckets": buckets, "layout": entries.schema.jsonValue(), "held": {}, "batch": -1, "top": -1 if top is None else top}
        table._write(entries, "start", -1, table.state["top"])
        return table

    def _bucket(self, url: str = "url") -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.state["buckets"])).cast("int")

    def _write(self, entries: DataFrame, name: str, batch: int, top: int) -> None:
        entries.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        made = [r[0] for r in self.spark.read.parquet(f"{self.folder}/{name}").select("_bucket").distinct().collect()] if entries.limit(1).count() else []
        before = {f"{self.folder}/{self.state['held'][str(b)]}/_bucket={b}" for b in made if str(b) in self.state["held"]}
        self.state = self.state | {"held": self.state["held"] | {str(b): name for b in made}, "batch": batch, "top": top}
        write_lines(self.spark, f"{self.folder}/manifest.json", [json.dumps(self.state)])
        for path in before:
            remove(self.spark, path)

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """All entries, or those of some buckets."""
        held = [f"{self.folder}/{name}/_bucket={b}" for b, name in self.state["held"].items() if buckets is None or int(b) in buckets]
        layout = StructType.fromJson(self.state["layout"])
        return self.spark.read.schema(layout).parquet(*held) if held else self.spark.createDataFrame([], layout)

    def upsert(self, scan: DataFrame, number: int) -> None:
        """Take batch ``number``; one that was taken before is passed over."""
        if number <= self.state["batch"]:
            return
        known = scan.where("url IS NOT NULL")
        touched = known.select(self._bucket().alias("b")).groupBy("b").agg(F.lit(1)).collect()  # no more than there are buckets
        last = known.agg(F.max("scan_pos")).first()[0]
        held = self.entries([r["b"] for r in touched])
        if touched:
            self._write(upsert(held, known, self.state["top"]).select(*held.columns), f"batch-{number}", number, self.state["top"] + 1 + last)


def maintain(spark: SparkSession, scans: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each micro-batch of ``scans`` into the :class:`ManifestTable` at ``folder``."""
    def step(batch: DataFrame, number: int) -> None:
        ManifestTable(batch.sparkSession, folder).upsert(batch, number)

    writer = scans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def links_per_window(links: DataFrame, lateness: str = "2 days", width: str = "1 day") -> DataFrame:
    """New links per type and window of ``seen_at``; rows later than the watermark are too late to count, rows without time are ignored."""
    timed = links.where(F.col("seen_at").isNotNull()).withWatermark("seen_at", lateness)
    return timed.groupBy(F.window("seen_at", width), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")
