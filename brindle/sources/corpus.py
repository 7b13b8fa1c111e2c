"""The corpus table: reading, writing, point access, export and import; and views of other tables as corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest, NotFound, TypeMismatch
from ..model import CORPUS

COLUMNS = ("bucket", "external_id", "text", "metadata", "parent_doc_id", "chunk_index", "embedding")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus; it lies by bucket, so a filter on bucket reads that bucket's files only."""
    return spark.read.schema(CORPUS).parquet(path)


def write(corpus: DataFrame, path: str, mode: str = "errorifexists") -> None:
    corpus.select(*COLUMNS).write.mode(mode).partitionBy("bucket").parquet(path)


def as_corpus(rows: DataFrame, bucket: Column, external_id: Column, text: Column, metadata: Column | None = None, embedding: Column | None = None, parent: Column | None = None, index: Column | None = None) -> DataFrame:
    """Any rows as a corpus."""
    none = F.lit(None)
    return rows.select(
        bucket.cast("string").alias("bucket"), external_id.cast("string").alias("external_id"), text.cast("string").alias("text"), (none if metadata is None else metadata).cast("string").alias("metadata"),
        (none if parent is None else parent).cast("string").alias("parent_doc_id"), (none if index is None else index).cast("int").alias("chunk_index"), (none if embedding is None else embedding).cast("array<float>").alias("embedding"),
    )


def get(corpus: DataFrame, bucket: str, external_id: str) -> DataFrame:
    """The row under a key, or none."""
    return corpus.where((F.col("bucket") == bucket) & (F.col("external_id") == external_id))


def point_get(corpus: DataFrame, bucket: str, external_id: str) -> dict:
    row = get(corpus, bucket, external_id).first()
    if row is None:
        raise NotFound(f"{bucket}/{external_id}")
    return row.asDict()


def export_bucket(corpus: DataFrame, bucket: str) -> DataFrame:
    return corpus.where(F.col("bucket") == bucket).select(*COLUMNS)


def check_import(rows: DataFrame, dim: int | None) -> DataFrame:
    """The rows if every one has an id and a vector of the right length; else an error, and nothing is imported."""
    bad_id = F.sum((F.coalesce(F.length("external_id"), F.lit(0)) == 0).cast("int"))
    bad_dim = F.sum((F.coalesce(F.size("embedding"), F.lit(-1)) != (dim or 0)).cast("int")) if dim is not None else F.lit(0)
    ids, dims = rows.agg(bad_id, bad_dim).first()
    if ids:
        raise InvalidRequest(f"{ids} rows without an id")
    if dims:
        raise TypeMismatch(f"{dims} rows whose vector has not {dim} numbers")
    return rows.select(*COLUMNS)


def home_region(corpus: DataFrame, bucket: str, seed_bucket: str = "__regions__") -> DataFrame:
    """region, epoch, replicated_to of a bucket, from its seed document's metadata."""
    md = F.from_json("metadata", "home_region string, home_epoch bigint, replicated_to array<string>")
    return get(corpus, seed_bucket, bucket).select(md.alias("m")).select(F.col("m.home_region").alias("region"), F.col("m.home_epoch").alias("epoch"), F.col("m.replicated_to").alias("replicated_to"))
