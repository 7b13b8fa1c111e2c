"""What the operators of this subpackage share: tables, the shared folder, and slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in a local session without it one of our own.

    A cluster without the setting is a RuntimeError: a folder of the driver's would be another one on each executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_folder:
        _own_folder["path"] = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return _own_folder["path"]


def stored(df: DataFrame, label: str, compression: str = "snappy", by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read back, with its path; this cuts the lineage.

    Columns in `by` become folders, and come last.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/brindle/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    schema = StructType([f for f in df.schema if f.name not in by] + [df.schema[n] for n in by])
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() made, through the store's own file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Between:
    """Tables that are needed until a later one is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, [], []

    def stored(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        table, path = stored(df, label, compression)
        self.paths.append(path)
        return table

    def kept(self, df: DataFrame) -> DataFrame:
        """`df` kept on the executors' disks, for small tables in many partitions: a file each costs more than its rows, and
        on a local file system a process that sets its mode. What an executor loses is made anew."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def drop(self) -> None:
        """Deletes them; what was made from them must be stored by now."""
        for path in self.paths:
            discard(self.spark, path)
        for df in self.held:
            df.unpersist()
        self.paths.clear()
        self.held.clear()


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 1000, least: int = 100, size: Column | None = None, most_bytes: int = 16 << 20, between: Between | None = None) -> DataFrame:
    """left join right on `key`, of which right has one row each, where few keys may hold many of left's rows.

    Keys of more than 1 / share of left's rows (and of more than `least`) are fewer than `share`. Their rows of right are
    broadcast, so that left's rows of these keys stay where they are; the other rows are shuffled. Where right's rows are of no
    fixed size, `size` gives their bytes: with more than most_bytes in all they are not broadcast. left and right are stored
    tables: both are read twice.
    """
    total = left.count()
    names = (between or Between(left.sparkSession)).stored(left.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > max(total // share, least)).select("__hot"), "hot")
    rows = right.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_semi")
    if names.isEmpty() or (size is not None and (rows.agg(F.sum(size)).first()[0] or 0) > most_bytes):
        return left.join(right, key)
    warm = left.join(F.broadcast(rows), key)
    cold = left.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_anti").join(right, key)
    return warm.unionByName(cold)


def texts(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    return pc.fill_null(column, "")


def give_back() -> None:
    """Returns what a task has freed to the system: a worker lives on and serves the stages after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can't, nothing is lost but this
        ctypes.CDLL(None).malloc_trim(0)


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each piece has about `most` bytes in `column`, or a single longer row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    start = held = 0
    for i, size in enumerate(sizes.to_pylist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """parts() of all batches.

    Whole rows only: memory is bounded by the largest text, and no text is cut.
    """
    for batch in batches:
        yield from parts(batch, column, most)
    give_back()
