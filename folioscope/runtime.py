"""Session helpers: table loading, the shared folder, and cutting lineage through written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a plain local master may run without the setting; it then gets a temporary folder. A real
    cluster without it is refused, since a machine-local folder would be invisible to other hosts.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="folioscope-")
    sc.setCheckpointDir(f"file://{folder}")
    return sc.getCheckpointDir() or f"file://{folder}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/folioscope/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy is a durable cut of the lineage: losing an executor never forces the work before it to
    be repeated, and several readers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each core from which an input has tasks enough by itself.
SPREAD_BYTES = 2 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, for work that costs more than moving its rows.

    A small input in one file would else be one task. The planner's estimate of the bytes of the tables read decides, so nothing
    is run to find out; a larger input is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def _located(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _located(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark can reach; None if there is none."""
    fs, at = _located(spark, path)
    if not fs.exists(at):
        return None
    opened = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def read_in_task(uri: str) -> bytes:
    """Content of one file, from a task: any file system that Arrow opens by URI (local, HDFS, object stores)."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def named_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that a path or pattern names, hidden ones too, in order of name."""
    fs, at = _located(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(at) or [] if s.isFile())


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """A text file on any file system that Spark can reach, written beside and renamed, so readers see the old or the new one."""
    fs, at = _located(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    held: list[str] = []
    out = fs.create(beside, True)
    try:
        size = 0
        for line in lines:
            held.append(line)
            size += len(line)
            if size > 1 << 20:  # chunks, so that a long file does not call across for every line
                out.write(bytearray("".join(held).encode("utf-8", "surrogatepass")))
                held, size = [], 0
        out.write(bytearray("".join(held).encode("utf-8", "surrogatepass")))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"could not write {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _located(spark, path)
    fs.delete(at, True)
