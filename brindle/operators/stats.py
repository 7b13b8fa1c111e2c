"""Counts over a corpus, retrieval quality, and the operator logs' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_stats(corpus: DataFrame, top_keys: int = 20) -> DataFrame:
    """bucket, docs, parent_docs, keys array<struct<key, count>>: the most frequent top-level metadata keys."""
    counts = corpus.groupBy("bucket").agg(F.count("*").alias("docs"), F.countDistinct("parent_doc_id").alias("parent_docs"))
    keys = corpus.select("bucket", F.explode(F.json_object_keys("metadata")).alias("key")).groupBy("bucket", "key").agg(F.count("*").alias("count"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("count").desc(), "key"))
    best = keys.withColumn("n", nth).where(F.col("n") <= top_keys).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("n", "key", "count"))).alias("k"))
    shown = F.transform(F.coalesce("k", F.array().cast("array<struct<n:int,key:string,count:bigint>>")), lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count")))
    return counts.join(best, "bucket", "left").select("bucket", "docs", "parent_docs", shown.alias("keys")).orderBy("bucket")


def count_chunks(corpus: DataFrame, bucket: str, doc_id: str) -> DataFrame:
    return corpus.where((F.col("bucket") == bucket) & (F.col("parent_doc_id") == doc_id)).agg(F.count("*").alias("chunks"))


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", row: str = "row_id") -> DataFrame:
    """queries, recall_at_k (the share of queries with a relevant row in the first k), mrr (mean of 1 / first relevant rank)."""
    first = ranked.where(F.col("rank") <= k).join(relevant.select(query, row).distinct(), [query, row]).groupBy(query).agg(F.min("rank").alias("first"))
    asked = relevant.select(query).distinct().join(first, query, "left")
    return asked.agg(F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def slow_queries(log: DataFrame, n: int = 32, least_ms: float = 10.0) -> DataFrame:
    """The n slowest statements of at least least_ms; of equal ones the earliest."""
    return log.where(F.col("took_ms") >= least_ms).orderBy(F.col("took_ms").desc(), "seq").limit(n)


def audit_ring(log: DataFrame, n: int = 1024) -> DataFrame:
    """The last n mutations, newest first."""
    return log.orderBy(F.col("seq").desc()).limit(n)


def lag(cursors: DataFrame, close_bytes: int = 4096) -> DataFrame:
    """Adds behind, lag_bytes and caught_up to rows of (leader_seg, leader_off, seg, off).

    Bytes are told only within one segment; a reader is caught up if it isn't behind or less than close_bytes behind.
    """
    behind = (F.col("leader_seg") > F.col("seg")) | ((F.col("leader_seg") == F.col("seg")) & (F.col("leader_off") > F.col("off")))
    same = F.when(F.col("leader_seg") == F.col("seg"), F.greatest(F.col("leader_off") - F.col("off"), F.lit(0)))
    return cursors.withColumns({"behind": behind, "lag_bytes": same, "caught_up": ~behind | F.coalesce(same <= close_bytes, F.lit(False))})
