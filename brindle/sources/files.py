"""File ingest: a folder's files as documents with type, text and metadata."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..functions import text as T
from ..operators.chunking import chunks, strategy_for

#: Formats that need a parser that isn't part of the engine.
UNREAD = ("pdf", "docx")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of every file below the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def pretty_json(text: Column) -> Column:
    """Valid JSON indented by two spaces, anything else as it is."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(value):
            try:
                return json.dumps(json.loads(value), indent=2, ensure_ascii=False)
            except (TypeError, ValueError):
                return value

        return column.map(one)

    return run(text)


def extract(files: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, source, doc_type, text, metadata of each file; files in a format that isn't read have a null text.

    With strict such a file is an error.
    """
    named = files.select(F.col("path").alias("source"), T.extension(F.col("path")).alias("ext"), T.doc_type_for(F.col("path")).alias("doc_type"), T.doc_id_for(F.col("path")).alias("doc_id"), F.decode("content", "UTF-8").alias("raw"))
    if strict:
        bad = named.where(F.col("ext").isin(*UNREAD)).first()
        if bad is not None:
            raise Unsupported(f"{bad['ext']} files: {bad['source']}")
    text = F.when(F.col("ext").isin(*UNREAD), F.lit(None)).when(F.col("doc_type") == "html", T.strip_html(F.col("raw"))).when(F.col("ext") == "json", pretty_json(F.col("raw"))).otherwise(F.col("raw"))
    read = named.withColumn("text", text)
    return read.select("doc_id", "source", "doc_type", "text", T.build_metadata(F.col("text"), F.col("doc_type"), F.col("source")).alias("metadata"))


def ingest(spark: SparkSession, path: str, bucket: str, size: int = 500, overlap: int = 50, strict: bool = True) -> DataFrame:
    """Corpus rows, without vectors, of a folder's files: each file cut by its type's strategy.

    A file in a format that isn't read is an error, unless strict is off: then it is left out, and extract() shows it.
    """
    docs = extract(read_files(spark, path), strict).where("text is not null")
    cut = docs.select("doc_id", "metadata", F.explode(chunks(F.col("text"), strategy_for(F.col("doc_type")), size, overlap)).alias("c"))
    return cut.select(F.lit(bucket).alias("bucket"), F.concat("doc_id", F.lit("#"), F.col("c.index").cast("string")).alias("external_id"), F.col("c.text").alias("text"), "metadata", F.col("doc_id").alias("parent_doc_id"), F.col("c.index").alias("chunk_index"))
