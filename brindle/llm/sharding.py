"""Sharding by vector bin packing.

Each group of equal texts is a vector of its shares of all bytes, tokens and rows; largest first, it goes to the shard
whose residual capacity has the largest dot product with it. At the end single groups move from the fullest shard to the
emptiest one while that brings the loads of all three kinds nearer to each other.

Groups are placed one by one as long as there are no more of them than UNITS, which is what the driver holds (32 bytes
each). Of more groups those of a small share are bundled by their hash, so that what is placed is UNITS vectors again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Vectors that the driver places.
UNITS = 1 << 15
#: Parts that a shard's share of rows has when its rows are numbered, so that no task numbers a large group by itself.
PARTS = 32
#: Fixed value: what a byte-level tokenizer takes for one piece at most, before merges; pieces are counted as tokens.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of shares (bytes, tokens, rows): largest first, each to the largest dot product.

    Equal vectors and equal products go in the order of the rows and shards.
    """
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else ():
        chosen[i] = to = int((residual @ vectors[i]).argmax())
        residual[to] -= vectors[i]
    return chosen


def even(vectors: np.ndarray, chosen: np.ndarray, shards: int, moves: int = 2000) -> np.ndarray:
    """Moves single items from the shard with the most bytes to the one with the fewest, or of the other kinds in turn, as
    long as that lowers the sum of the squares of all loads."""
    chosen = chosen.copy()
    loads = np.zeros((shards, vectors.shape[1]))
    np.add.at(loads, chosen, vectors)
    idle, kind = 0, 0
    for _ in range(moves):
        full, empty = int(loads[:, kind].argmax()), int(loads[:, kind].argmin())
        own = np.flatnonzero(chosen == full)
        change = ((loads[empty] - loads[full] + vectors[own]) * vectors[own]).sum(axis=1)  # half of what the sum changes by
        if len(own) and change.min() < -1e-15:
            best = own[int(change.argmin())]
            chosen[best] = empty
            loads[full] -= vectors[best]
            loads[empty] += vectors[best]
            idle = 0
        else:
            idle, kind = idle + 1, (kind + 1) % vectors.shape[1]
            if idle == vectors.shape[1]:
                break
    return chosen


def shard(docs: DataFrame, shards: int = 24, units: int = UNITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size is the text's UTF-8 bytes plus 8, a null text has none; the law is `bytes`: shards have nearly equal sums of
    size, and of tokens and rows as far as the groups allow. Equal texts go to one shard; only a group with more than a whole
    shard's share of bytes, tokens or rows is dealt in parts, by its ids. slot counts a shard's rows from 0 without gaps;
    grown_shard is null under this law. Repeated rows each get a slot, an empty table gives no rows, null ids are
    kept; texts may be of any length.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    slim, _ = stored(
        docs.select(
            F.col(id_column),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.regexp_count(text, F.lit(PIECES)).cast("bigint").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("nth"),
        ),
        "sizes",
    )
    groups, path = stored(slim.groupBy("h").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("size").alias("b")), "groups")
    count, *totals = groups.agg(F.count("*"), F.sum("b"), F.sum("t"), F.sum("n")).first()
    totals = [max(1, x or 0) for x in totals]
    share = F.greatest(*(F.col(c) / F.lit(float(total)) for c, total in zip("btn", totals, strict=True)))
    # At most three groups for each part can be so large, one for each kind of share.
    heavy = groups.withColumn("share", share).where(F.col("share") > 1.0 / (shards * PARTS)).select("h", "share").orderBy("h").toArrow()
    large, shares = heavy.column("h").to_numpy(), heavy.column("share").to_numpy()
    parts = np.ceil(shares * shards * PARTS).astype(np.int64)
    known = spark.createDataFrame(pa.table({"large": large, "parts": parts})) if len(large) else spark.createDataFrame([], "large bigint, parts bigint")
    # A unit is a group, a part of a large group, or a bundle of small ones; `part` tells these apart.
    bundle = F.col("h") if count <= units else F.pmod("h", F.lit(units))
    spread = F.pmod(F.xxhash64(F.col(id_column), F.when(F.col(id_column).isNull(), F.col("nth"))), F.col("parts"))
    dealt = slim.join(F.broadcast(known), F.col("h") == F.col("large"), "left").select(
        id_column, "size", "tokens", "text_crc32", "nth", F.when(F.col("large").isNull(), bundle).otherwise(F.col("h")).alias("unit"), F.when(F.col("large").isNull(), F.lit(-1)).otherwise(spread).alias("part")
    )
    discard(spark, path)

    stats = dealt.groupBy("unit", "part").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("unit", "part").toArrow()
    unit, part, rows = (stats.column(c).to_numpy() for c in ("unit", "part", "n"))
    each = np.stack([stats.column(c).to_numpy() / total for c, total in zip("btn", totals, strict=True)], axis=1)
    # A group's parts are placed together, unless no shard has room for the group.
    split = np.isin(unit, large[shares > 1.0 / shards]) & (part >= 0)
    fresh = np.ones(len(unit), bool)
    fresh[1:] = (unit[1:] != unit[:-1]) | split[1:] | ((part[1:] < 0) != (part[:-1] < 0))
    item = np.cumsum(fresh) - 1
    vectors = np.zeros((int(fresh.sum()), 3))
    np.add.at(vectors, item, each)
    placed = even(vectors, place(vectors, shards), shards)[item] if len(item) else np.zeros(0, np.int64)
    base = np.zeros(len(unit), np.int64)
    for s in range(shards):
        own = placed == s
        base[own] = np.cumsum(rows[own]) - rows[own]
    schema = "unit bigint, part bigint, shard int, base bigint"
    where = spark.createDataFrame(pa.table({"unit": unit, "part": part.astype(np.int64), "shard": placed.astype(np.int32), "base": base})) if len(unit) else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("unit", "part").orderBy(id_column, "text_crc32", "size", "nth"))
    numbered = dealt.withColumn("rank", rank).join(F.broadcast(where), ["unit", "part"])
    return numbered.select(
        id_column, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
