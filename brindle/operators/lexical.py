"""BM25 over tokenised documents. N, document frequency and mean length are those of all buckets.

bm25() scans the documents; a WordIndex keeps postings on disk, takes documents in and out, and reads a query's terms only.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..errors import InvalidPlan, NotFound
from ..functions.text import tokenize

K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    """The query's distinct tokens."""
    word, out = "", []
    for c in query + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word.lower())
            word = ""
    return list(dict.fromkeys(out))


def postings(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, term, tf, len: one row a document and term; the stored form of the index."""
    tokens = docs.select(*key, tokenize(F.col(text)).alias("tokens")).withColumn("len", F.size("tokens"))
    return tokens.select(*key, "len", F.explode("tokens").alias("term")).groupBy(*key, "term", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, k: int | None = 10, key: Sequence[str] = ("bucket", "external_id"), text: str = "text", bucket: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """docs' columns and score of the k documents that hold a query term, best first, ties by key.

    Term counts of the few query terms come out of each row's token array, so nothing but one row of statistics and
    the top k crosses the network.
    """
    terms = terms_of(query)
    tokens = docs.withColumn("_tokens", tokenize(F.col(text)))

    def times(word: str) -> Column:
        return F.size(F.filter("_tokens", lambda t: t == F.lit(word)))

    counts = [times(w).alias(f"_tf{i}") for i, w in enumerate(terms)]
    scanned = tokens.withColumns({"_len": F.size("_tokens")}).select(*docs.columns, "_len", *counts)
    stats = scanned.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.sum((F.col(f"_tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(terms))))
    rows = scanned if bucket is None else scanned.where(F.col("bucket") == bucket)
    matched = rows.where(" or ".join(f"_tf{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.when(tf > 0, _weigh(tf, df, F.col("_n"), F.col("_len"), F.col("_avg"), k1, b)).otherwise(0.0)
    found = matched.select(*docs.columns, score.alias("score"))
    ordered = found.orderBy(F.col("score").desc(), *key)
    return ordered.limit(k) if k is not None else ordered


def _weigh(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """A term's part of a document's score."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


class WordIndex:
    """Postings on disk, in segments that are written once.

    A segment has the postings of the documents that came with it, in folders by a hash of the term and sorted by term, so
    that a search reads the few files of its terms; the keys that it replaces or removes; and one row of counts. A
    segment counts once its counts are there. Postings of a key are those of the last segment that names it.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = ("bucket", "external_id"), parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), tuple(key), parts

    # Segments

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def segments(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        found = sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))
        return [n for n in found if fs.exists(self._fs(f"{self.path}/segment={n}/counts/_SUCCESS")[1])]

    def _read(self, what: str, segments: list[int]) -> DataFrame:
        keys = self.spark.read.parquet(f"{self.path}/segment={segments[0]}/keys").schema  # a segment may have no postings
        schema = keys if what == "keys" else StructType([*keys.fields, *(StructField(n, t()) for n, t in (("term", StringType), ("tf", LongType), ("part", IntegerType)))])
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/segment={n}/{what}").withColumn("segment", F.lit(n)) for n in segments]
        return reduce(DataFrame.unionByName, tables)

    def counts(self) -> tuple[int, int]:
        """(documents, tokens) of the index."""
        done = self.segments()
        if not done:
            raise NotFound(f"no index in {self.path}")
        return tuple(self.spark.read.parquet(f"{self.path}/segment={done[-1]}/counts").select("n", "tokens").first())

    # Writing

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Takes documents in; those whose key is there already replace them. A key comes once in docs."""
        self._write(docs.select(*self.key, F.coalesce(F.col(text), F.lit("")).alias("text")))

    def remove(self, keys: DataFrame) -> None:
        """Takes documents out; keys that aren't there change nothing."""
        self._write(keys.select(*self.key).distinct().withColumn("text", F.lit(None).cast("string")))

    def _write(self, docs: DataFrame) -> None:
        done = self.segments()
        number = done[-1] + 1 if done else 0
        at = f"{self.path}/segment={number}"
        fs, p = self._fs(at)
        if fs.exists(p):  # what a writer left that did not come to its end
            fs.delete(p, True)
        tokens = docs.select(*self.key, F.when(F.col("text").isNotNull(), tokenize(F.col("text"))).alias("tokens"))
        # Keys with their lengths; null for one that is only removed.
        tokens.select(*self.key, F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("len")).write.parquet(f"{at}/keys")
        rows = postings(docs.where("text is not null"), self.key).withColumn("part", (F.crc32("term") % self.parts).cast("int"))
        rows.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{at}/postings")
        new = self.spark.read.parquet(f"{at}/keys")
        n, total = new.agg(F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if done:
            before = self.counts()
            old = self._live_keys(done).join(new.select(*self.key), list(self.key), "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            n, total = before[0] + n - old[0], before[1] + total - old[1]
        self.spark.createDataFrame([(n, total)], "n bigint, tokens bigint").coalesce(1).write.parquet(f"{at}/counts")

    def _live_keys(self, done: list[int]) -> DataFrame:
        """key, len of the documents that are in."""
        last = self._read("keys", done).groupBy(*self.key).agg(F.max_by("len", "segment").alias("len"))
        return last.where("len is not null")

    # Reading

    def _live(self, found: DataFrame, done: list[int]) -> DataFrame:
        """Postings without those of keys that a later segment names."""
        if len(done) == 1:
            return found
        last = self._read("keys", done[1:]).groupBy(*self.key).agg(F.max("segment").alias("last"))
        joined = found.join(last, list(self.key), "left")
        return joined.where(F.coalesce(F.col("last") <= F.col("segment"), F.lit(True))).drop("last")

    def postings(self) -> DataFrame:
        """key, term, tf, len of all documents that are in."""
        done = self.segments()
        return self._live(self._read("postings", done), done).select(*self.key, "term", "tf", "len")

    def search(self, query: str, k: int | None = 10, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """key and score of the k documents that hold a query term, best first, ties by key.

        Files of other terms aren't read; what is shuffled are the postings of the query's terms, pre-aggregated by document.
        where, on the key, leaves documents out after the counts.
        """
        done = self.segments()
        n, total = self.counts()
        terms = terms_of(query)
        if not terms:
            schema = self.spark.read.parquet(f"{self.path}/segment={done[0]}/keys").select(*self.key)
            return schema.withColumn("score", F.lit(0.0)).limit(0)
        folders = sorted({zlib.crc32(t.encode()) % self.parts for t in terms})
        found = self._read("postings", done).where(F.col("part").isin(folders) & F.col("term").isin(terms))
        found = self._live(found, done).select(*self.key, "term", "tf", "len")
        df = F.broadcast(found.groupBy(F.col("term").alias("_term")).agg(F.count("*").alias("_df")))  # a row a term
        matched = found.join(df, F.col("term") == F.col("_term"))
        if where is not None:
            matched = matched.where(where)
        part = _weigh(F.col("tf"), F.col("_df"), F.lit(n), F.col("len"), F.lit(total / max(n, 1)), k1, b)
        scored = matched.groupBy(*self.key).agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), *self.key)
        return scored.limit(k) if k is not None else scored

    def compact(self, path: str) -> WordIndex:
        """The same index as one segment in a new folder."""
        other = WordIndex(self.spark, path, self.key, self.parts)
        if other.segments():
            raise InvalidPlan(f"{path} has an index")
        done = self.segments()
        at = f"{other.path}/segment=0"
        self._live_keys(done).write.parquet(f"{at}/keys")
        rows = self.postings().withColumn("part", (F.crc32("term") % self.parts).cast("int"))
        rows.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{at}/postings")
        self.spark.createDataFrame([self.counts()], "n bigint, tokens bigint").coalesce(1).write.parquet(f"{at}/counts")
        return other
