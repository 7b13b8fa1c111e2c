"""Change events from the log, as batches or streams; filters, sinks, followers and cross-region readers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import CHANGELOG, OPS
from ..sources.changelog import fold


def tail(spark: SparkSession, log_path: str, files_a_trigger: int | None = None) -> DataFrame:
    """The log as a stream: what is there, then what comes. A checkpoint of the reading query is the cursor."""
    reader = spark.readStream.schema(CHANGELOG)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(log_path)


def to_events(log: DataFrame) -> DataFrame:
    """cursor, next_cursor, op, key{bucket, id}, body{text, vector, chunks, metadata}; deletes have no body, and metadata that isn't JSON is null."""
    insert = F.col("op").isin("insert", "insert_document")
    good = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    body = F.struct(F.when(F.col("op") == "insert", F.col("text")).alias("text"), F.when(F.col("op") == "insert", F.col("embedding")).alias("vector"), F.when(F.col("op") == "insert_document", F.col("chunks")).alias("chunks"), good.alias("metadata"))
    key = F.struct("bucket", F.when(F.col("op") != "empty_bucket", F.col("id")).alias("id"))
    return log.select(F.col("seq").alias("cursor"), (F.col("seq") + 1).alias("next_cursor"), "op", key.alias("key"), F.when(insert, body).alias("body"))


def filter_events(events: DataFrame, bucket: str | None = None, ops: Sequence[str] | None = None, vectors_only: bool = False) -> DataFrame:
    """Events of a bucket and of some operations (an empty set passes none), and only those with a vector."""
    if bucket is not None:
        events = events.where(F.col("key.bucket") == bucket)
    if ops is not None:
        unknown = set(ops) - set(OPS)
        if unknown:
            raise ValueError(f"unknown operations: {sorted(unknown)}")
        events = events.where(F.col("op").isin(*ops) if ops else F.lit(False))
    if vectors_only:
        has = F.col("body.vector").isNotNull() | F.coalesce(F.exists("body.chunks", lambda c: c["vector"].isNotNull()), F.lit(False))
        events = events.where(F.coalesce(has, F.lit(False)))
    return events


def to_files(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One JSON line an event, each once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_callable(events: DataFrame, sink: Callable[[list[dict]], None], checkpoint: str, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Hands each batch's events, in order, to a sink. What a sink fails on is dropped and the cursor goes on.

    A batch may come again after a crash: sinks go by the cursor. Partitions of a batch are read one at a time.
    """

    def each(batch: DataFrame, _: int) -> None:
        lines: list[dict] = []
        for row in batch.orderBy("cursor").toLocalIterator():
            lines.append(row.asDict(recursive=True))
            if len(lines) == 1000:
                _give(lines)
                lines = []
        if lines:
            _give(lines)

    def _give(lines: list[dict]) -> None:
        try:
            sink(lines)
        except Exception as e:  # a consumer's failure never stops the log
            if on_error:
                on_error(e)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def skip_home(log: DataFrame, owned: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """Records for a reader in another region: none of the buckets it owns, none older than its epoch for the bucket.

    owned: bucket; epochs: bucket, epoch known to the reader.
    """
    passed = log.join(F.broadcast(owned.select("bucket").distinct()), "bucket", "left_anti")
    if epochs is not None:
        known = F.broadcast(epochs.groupBy(F.col("bucket").alias("_b")).agg(F.max("epoch").alias("_e")))
        passed = passed.join(known, F.col("bucket") == F.col("_b"), "left").where(F.coalesce(F.col("home_epoch") >= F.col("_e"), F.lit(True))).drop("_b", "_e")
    return passed


def follow(log_stream: DataFrame, log_copy: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """A follower: every batch is appended to the follower's own log under its batch number, so that one that comes again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        keep(batch).write.mode("overwrite").parquet(f"{log_copy}/part={number:020d}")

    return log_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follower_state(spark: SparkSession, log_copy: str) -> DataFrame:
    """The follower's corpus: the fold of its log, records that came twice once."""
    log = spark.read.schema(CHANGELOG).parquet(f"{log_copy}/*")
    return fold(log.dropDuplicates(["seq"]))
