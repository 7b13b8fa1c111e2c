"""The change log: an append-only table of mutations, its fold into the current corpus, snapshots, compaction, backup.

The log is a folder of Parquet batches, named by their first and last seq; a batch counts once its commit is done, so what
a writer left half done is never read. seq rises strictly.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import InvalidPlan, InvalidRequest, NotFound, Unsupported
from ..functions.text import version_lt
from ..model import CHANGELOG, CORPUS
from ..operators.journal import AuditRing
from ..operators.stats import count_chunks
from .corpus import COLUMNS, check_import

CHUNKS = "array<struct<index:int,char_start:int,text:string,vector:array<float>>>"
VERSION = "0.1.0"
BULK_MOST = 1000
#: Buckets up to this many are broadcast to the rows of a fold.
BROADCAST_MOST = 100_000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).parquet(path)


def fold(log: DataFrame, base: DataFrame | None = None, after: int = -1) -> DataFrame:
    """The corpus after the records with seq > after, on top of a snapshot's rows if given.

    A row is the last upsert of its key; a later delete of the key, of its document or bucket, or a later upsert of its
    whole document takes it away. Deletes of what isn't there do nothing. One shuffle by bucket and key for the rows;
    deletes are pre-aggregated to one row for each thing deleted. Rows without a document aren't joined with the
    documents' deletes, and buckets are broadcast after a look at their number, so no bucket meets in one task.
    """
    log = log.where(F.col("seq") > after)
    plain = log.where("op = 'insert'").select("seq", "bucket", F.col("id").alias("external_id"), "text", "metadata", F.lit(None).cast("string").alias("parent_doc_id"), F.lit(None).cast("int").alias("chunk_index"), "embedding")
    cut = log.where("op = 'insert_document'").select("seq", "bucket", "id", "metadata", F.explode("chunks").alias("c"))
    chunked = cut.select("seq", "bucket", F.concat("id", F.lit("#"), F.col("c.index").cast("string")).alias("external_id"), F.col("c.text").alias("text"), "metadata", F.col("id").alias("parent_doc_id"), F.col("c.index").alias("chunk_index"), F.col("c.vector").alias("embedding"))
    rows = plain.unionByName(chunked)
    if base is not None:
        rows = rows.unionByName(base.select(F.lit(after).cast("bigint").alias("seq"), *COLUMNS))
    newest = F.row_number().over(Window.partitionBy("bucket", "external_id").orderBy(F.col("seq").desc()))
    latest = rows.withColumn("_n", newest).where("_n = 1").drop("_n")
    by_id = log.where("op = 'delete'").groupBy("bucket", F.col("id").alias("external_id")).agg(F.max("seq").alias("_k1"))
    by_doc = log.where("op in ('delete_document', 'insert_document')").groupBy("bucket", F.col("id").alias("parent_doc_id")).agg(F.max("seq").alias("_k2"))
    by_bucket = log.where("op = 'empty_bucket'").groupBy("bucket").agg(F.max("seq").alias("_k3"))
    known = latest.join(by_id, ["bucket", "external_id"], "left")
    whole = known.where("parent_doc_id is null").withColumn("_k2", F.lit(None).cast("bigint"))
    parts = known.where("parent_doc_id is not null").join(by_doc, ["bucket", "parent_doc_id"], "left")
    emptied = F.broadcast(by_bucket) if by_bucket.count() <= BROADCAST_MOST else by_bucket
    marked = whole.unionByName(parts).join(emptied, "bucket", "left")
    kill = F.greatest(F.coalesce("_k1", F.lit(-1)), F.coalesce("_k2", F.lit(-1)), F.coalesce("_k3", F.lit(-1)))
    return marked.where(kill <= F.col("seq")).select(*COLUMNS)


class ChangeLog:
    """A corpus kept as a change log in a folder."""

    def __init__(self, spark: SparkSession, path: str, model: str = "hash", dim: int | None = None):
        self.spark, self.path, self.model, self.dim = spark, path.rstrip("/"), model, dim
        self.audit = AuditRing()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    # Reading

    def _batches(self) -> list[tuple[int, int, str]]:
        """(first seq, last seq, name) of the batches whose commit is done, in order."""
        names = [n for n in self._names(f"{self.path}/log") if n.startswith("batch=") and self._exists(f"{self.path}/log/{n}/_SUCCESS")]
        return [(*map(int, n.removeprefix("batch=").split("-")), n) for n in names]

    def log(self) -> DataFrame:
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*(f"{self.path}/log/{n}" for _, _, n in batches))

    def head(self) -> int:
        """The last seq, of the log or of the newest snapshot; -1 with neither. Only names are read."""
        ends = [last for _, last, _ in self._batches()] + self.snapshots()
        return max(ends, default=-1)

    def snapshots(self) -> list[int]:
        names = [n for n in self._names(f"{self.path}/snapshots") if n.startswith("seq=")]
        return sorted(int(n.split("=")[1]) for n in names if self._exists(f"{self.path}/snapshots/{n}/_SUCCESS"))

    def corpus(self) -> DataFrame:
        done = self.snapshots()
        if not done:
            return fold(self.log())
        base = self.spark.read.schema(CORPUS).parquet(f"{self.path}/snapshots/seq={done[-1]}")
        return fold(self.log(), base, done[-1])

    def rows_of(self, bucket: str, key: str) -> DataFrame:
        """The corpus rows under a key, and those of the document of that name, from the records that bear on them."""
        doc = key.rpartition("#")[0]
        names = [key, doc] if doc else [key]
        touched = (F.col("bucket") == bucket) & (F.col("op").isin("empty_bucket") | F.col("id").isin(names))
        done = self.snapshots()
        base, after = None, -1
        if done:
            stored = self.spark.read.schema(CORPUS).parquet(f"{self.path}/snapshots/seq={done[-1]}")
            base, after = stored.where((F.col("bucket") == bucket) & (F.col("external_id").isin(names) | F.col("parent_doc_id").isin(names))), done[-1]
        rows = fold(self.log().where(touched), base, after)
        return rows.where((F.col("external_id") == key) | (F.col("parent_doc_id") == key))

    # Writing

    def append(self, records: DataFrame) -> int:
        """Appends records in the order of their column nth (0, 1, ..); returns the last seq. Records of one call are one batch.

        The log is not read: the batch before says in its name where this one begins.
        """
        last = records.agg(F.max("nth")).first()[0]
        start = self.head() + 1
        if last is None:
            return start - 1
        numbered = records.withColumn("seq", F.col("nth") + F.lit(start))
        schema = StructType.fromDDL(CHANGELOG)
        full = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in numbered.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        name = f"batch={start:020d}-{start + last:020d}"
        numbered.select(*full).write.mode("overwrite").parquet(f"{self.path}/log/{name}")  # over what a lost writer left
        return start + last

    def _rows(self, rows: Sequence[dict]) -> DataFrame:
        full = [{"nth": i, "op": None, "bucket": None, "id": None, "text": None, "embedding": None, "chunks": None, "metadata": None, "home_epoch": None} | r for i, r in enumerate(rows)]
        schema = "nth bigint, " + CHANGELOG.replace("seq bigint, ", "")
        return self.spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in ("nth", "op", "bucket", "id", "text", "embedding", "chunks", "metadata", "home_epoch")) for r in full], schema)

    def _check(self, bucket: str, key: str, embedding: Sequence[float] | None = None) -> None:
        if not bucket or not key:
            raise InvalidRequest("bucket and id must not be empty")
        if embedding is not None and self.dim is not None and len(embedding) != self.dim:
            raise InvalidRequest(f"the vector has {len(embedding)} numbers, the index has {self.dim}")

    def upsert(self, bucket: str, key: str, text: str, embedding: Sequence[float] | None = None, metadata: object = None) -> int:
        self._check(bucket, key, embedding)
        self.audit.note("insert", bucket, key)
        return self.append(self._rows([{"op": "insert", "bucket": bucket, "id": key, "text": text, "embedding": embedding, "metadata": None if metadata is None else json.dumps(metadata)}]))

    def bulk(self, bucket: str, items: Sequence[dict]) -> list[dict]:
        """Upserts up to BULK_MOST items {id, text, embedding?, metadata?}; says for each whether it went in."""
        if len(items) > BULK_MOST:
            raise InvalidRequest(f"at most {BULK_MOST} items")
        good, said = [], []
        for item in items:
            try:
                self._check(bucket, item.get("id") or "", item.get("embedding"))
                good.append({"op": "insert", "bucket": bucket, "id": item["id"], "text": item.get("text", ""), "embedding": item.get("embedding"), "metadata": None if item.get("metadata") is None else json.dumps(item["metadata"])})
                said.append({"id": item["id"], "ok": True})
            except InvalidRequest as e:
                said.append({"id": item.get("id"), "ok": False, "error": str(e)})
        if good:
            self.append(self._rows(good))
            for item in good:
                self.audit.note("insert", bucket, item["id"])
        return said

    def upsert_document(self, bucket: str, doc_id: str, chunks: Sequence[dict], metadata: object = None) -> int:
        """Replaces a document's chunks ({index, char_start, text, vector})."""
        self._check(bucket, doc_id)
        self.audit.note("insert_document", bucket, doc_id)
        values = [(c["index"], c["char_start"], c["text"], c.get("vector")) for c in chunks]
        return self.append(self._rows([{"op": "insert_document", "bucket": bucket, "id": doc_id, "chunks": values, "metadata": None if metadata is None else json.dumps(metadata)}]))

    def delete(self, bucket: str, key: str) -> None:
        if self.rows_of(bucket, key).where(F.col("external_id") == key).isEmpty():
            raise NotFound(f"{bucket}/{key}")
        self.append(self._rows([{"op": "delete", "bucket": bucket, "id": key}]))
        self.audit.note("delete", bucket, key)

    def delete_document(self, bucket: str, doc_id: str) -> int:
        n = count_chunks(self.rows_of(bucket, doc_id), bucket, doc_id).first()[0]
        if not n:
            raise NotFound(f"{bucket}/{doc_id}")
        self.append(self._rows([{"op": "delete_document", "bucket": bucket, "id": doc_id}]))
        self.audit.note("delete_document", bucket, doc_id)
        return n

    def empty_bucket(self, bucket: str) -> int:
        n = self.corpus().where(F.col("bucket") == bucket).count()
        self.append(self._rows([{"op": "empty_bucket", "bucket": bucket}]))
        self.audit.note("empty_bucket", bucket, None)
        return n

    def import_rows(self, rows: DataFrame) -> int:
        """Appends corpus rows, if every one has an id and a vector of the right length; else an error, and nothing is
        appended. Chunks come in as whole documents, so that they can be deleted as such. Returns how many rows."""
        good = check_import(rows, self.dim)
        none = F.lit(None)
        plain = good.where("parent_doc_id is null").select(F.lit("insert").alias("op"), "bucket", F.col("external_id").alias("id"), "text", "embedding", none.cast(CHUNKS).alias("chunks"), "metadata")
        chunk = F.struct(F.col("chunk_index").alias("index"), F.lit(0).alias("char_start"), "text", F.col("embedding").alias("vector"))
        whole = good.where("parent_doc_id is not null").groupBy("bucket", F.col("parent_doc_id").alias("id")).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.first("metadata").alias("metadata"))
        docs = whole.select(F.lit("insert_document").alias("op"), "bucket", "id", none.cast("string").alias("text"), none.cast("array<float>").alias("embedding"), F.col("chunks").cast(CHUNKS).alias("chunks"), "metadata")
        # Rows are numbered partition by partition, without gathering them: only a partition's number of rows is.
        both = plain.unionByName(docs).withColumn("_id", F.monotonically_increasing_id())
        path = f"{self.path}/incoming-{uuid.uuid4().hex}"
        both.write.parquet(path)
        stored = self.spark.read.schema(both.schema).parquet(path)
        sizes = stored.groupBy(F.shiftright("_id", 33).alias("p")).count().orderBy("p").collect()
        bases, total = [], 0
        for p, n in sizes:
            bases.append((p, total))
            total += n
        if total:
            starts = F.broadcast(self.spark.createDataFrame(bases, "p bigint, base bigint"))  # a row a partition
            placed = stored.join(starts, F.shiftright("_id", 33) == F.col("p"))
            self.append(placed.withColumn("nth", F.col("base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
        fs, p = self._fs(path)
        fs.delete(p, True)
        return good.count()

    # Durability

    def snapshot(self) -> int:
        """Writes the current corpus; it counts once its commit is done. Returns its seq."""
        seq = self.head()
        if seq not in self.snapshots():
            self.corpus().write.parquet(f"{self.path}/snapshots/seq={seq}")
        return seq

    def compact(self, acks: Sequence[int] = ()) -> int:
        """Drops batches that the newest snapshot covers and every reader in acks has seen; returns how many."""
        done = self.snapshots()
        if not done:
            return 0
        limit = min([done[-1], *acks])
        dropped = 0
        for _, last, name in self._batches():
            if last <= limit:
                fs, p = self._fs(f"{self.path}/log/{name}")
                fs.delete(p, True)
                dropped += 1
        return dropped

    def backup(self, target: str) -> dict:
        """The corpus and, last of all, a manifest that makes it count."""
        if self._names(target):
            raise InvalidPlan(f"{target} is not empty")
        corpus = self.corpus()
        corpus.write.parquet(f"{target}/corpus")
        stored = self.spark.read.schema(CORPUS).parquet(f"{target}/corpus")
        rows, digest = stored.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(bucket, external_id, text, metadata, embedding)), 0)")).first()
        manifest = {"version": VERSION, "model": self.model, "dim": self.dim, "seq": self.head(), "rows": rows, "digest": digest, "created": int(time.time())}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{target}/manifest")
        return manifest

    def restore(self, source: str) -> dict:
        """Fills this empty log's folder from a backup, once manifest, model, rows and digest hold."""
        if self._names(self.path):
            raise InvalidPlan(f"{self.path} is not empty")
        if not self._exists(f"{source}/manifest/_SUCCESS"):
            raise NotFound(f"no manifest in {source}")
        manifest = json.loads(self.spark.read.text(f"{source}/manifest").first()[0])
        if manifest["model"] != self.model or manifest["dim"] != self.dim:
            raise InvalidPlan("the backup has another embedding model")
        if version_lt(VERSION, manifest["version"]):
            raise Unsupported("the backup is of a newer version")
        stored = self.spark.read.schema(CORPUS).parquet(f"{source}/corpus")
        rows, digest = stored.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(bucket, external_id, text, metadata, embedding)), 0)")).first()
        if (rows, digest) != (manifest["rows"], manifest["digest"]):
            raise InvalidPlan("the backup is damaged")
        stored.write.parquet(f"{self.path}/snapshots/seq={manifest['seq']}")
        return manifest
