"""Manifest files in YAML as a Spark data source, ``manifest_yaml``, for reading and writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folioscope.runtime import named_files, read_in_task, write_lines
from folioscope.schema import ENTRY

NAME = "manifest_yaml"


def _plain(value: object) -> object:
    """YAML dates and other scalars as text."""
    return value if value is None or isinstance(value, (bool, int, float, str, list, dict)) else str(value)


def load_entries(text: str) -> list[dict]:
    """Entries of a YAML text; any top level but a list is an empty manifest."""
    import yaml

    found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    return [e for e in found if isinstance(e, dict)] if isinstance(found, list) else []


class ManifestSource(DataSource):
    """``spark.read.format("manifest_yaml").load(path)``: one row per entry, as JSON text, with its position."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, entry_pos bigint, entry string"

    def reader(self, schema: StructType) -> DataSourceReader:
        listed = self.options.get("files")
        return _Reader(json.loads(listed) if listed is not None else [self.options["path"]] if self.options.get("path") else [])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    """Tasks open the file they are given, wherever it lies; a folder's files are listed in ``files`` by :func:`read_manifest`."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.path:
            for pos, entry in enumerate(load_entries(read_in_task(partition.path).decode("utf-8"))):
                yield partition.path, pos, json.dumps(entry, default=str)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed entries with ``entry_pos``; a missing file is an empty manifest, unknown keys are ignored."""
    spark.dataSource.register(ManifestSource)
    listed = named_files(spark, path) or named_files(spark, f"{path}/*.y*ml")
    raw = spark.read.format(NAME).option("files", json.dumps(listed)).load(path)
    return raw.select("entry_pos", F.from_json("entry", ENTRY).alias("e")).select("entry_pos", "e.*")


def dump_entries(rows: Iterator[dict]) -> Iterator[str]:
    """YAML text of each entry, keys in order, without the notes where there are none."""
    import yaml

    for row in rows:
        kept = {k: _plain(v) for k, v in row.items() if k != "entry_pos" and not (k == "notes" and not v)}
        yield yaml.dump([kept], allow_unicode=True, sort_keys=False, default_flow_style=False)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Export to one YAML file in order, streaming rows through the driver; the list is one document by its format."""
    ordered = entries.orderBy("entry_pos").toLocalIterator()

    def lines() -> Iterator[str]:
        empty = True
        for text in dump_entries(r.asDict(recursive=True) for r in ordered):
            empty = False
            yield text
        if empty:
            yield "[]\n"

    write_lines(entries.sparkSession, path, lines())
