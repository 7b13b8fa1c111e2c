"""Nearest neighbours: exact search as a distance and a top-k, and an inverted-file index that searches few cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequest, TypeMismatch
from ..functions import vectors

MAX_TOP_K = 100


def check_top_k(k: int, most: int | None = MAX_TOP_K) -> int:
    if k <= 0:
        raise InvalidRequest("top_k must be > 0")
    if most is not None and k > most:
        raise InvalidRequest(f"top_k must be <= {most}")
    return k


def check_dim(query: Sequence[float], dim: int | None) -> None:
    if dim is not None and len(query) != dim:
        raise TypeMismatch(f"the vector has {len(query)} numbers, the index has {dim}")


def topk(rows: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", embedding: str = "embedding", tie: Sequence[str] = ("bucket", "external_id"), score: str = "score") -> DataFrame:
    """The k rows nearest to the query, with their distance; ties by the given columns.

    One scan, a partial top-k in each task and k rows a task to the last one: no shuffle of the rows.
    """
    found = rows.withColumn(score, vectors.distance_to(metric, F.col(embedding), query))
    return found.orderBy(F.col(score).asc_nulls_last(), *tie).limit(k)


def batch_topk(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", row_id: str = "vec_id", query_id: str = "query_id", embedding: str = "embedding", block: int = 256) -> DataFrame:
    """(query_id, row_id, score, rank): the k nearest rows of each of a stated set of queries.

    The queries are a set of bounded size; they go to every task in blocks as a matrix. A task keeps k rows a query,
    and only those are shuffled.
    """
    asked = queries.select(query_id, embedding).orderBy(query_id).collect()
    if not asked:
        return rows.select(F.lit(None).cast("bigint").alias(query_id), row_id, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    ids = [r[0] for r in asked]
    matrix = np.array([r[1] for r in asked], np.float64)

    def nearest(batches):
        import pandas as pd

        best: dict[int, pd.DataFrame] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[embedding].to_numpy()).astype(np.float64)
            for at in range(0, len(matrix), block):
                d = _distances(matrix[at : at + block], x, metric)
                kept = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
                for q in range(len(d)):
                    limit = d[q, kept[q]].max()
                    near = np.flatnonzero(d[q] <= limit)  # all ties of the last one
                    part = pd.DataFrame({query_id: ids[at + q], row_id: pdf[row_id].to_numpy()[near], "score": d[q, near]})
                    old = best.get(at + q)
                    both = part if old is None else pd.concat([old, part])
                    best[at + q] = both.sort_values(["score", row_id]).head(k)
        if best:
            yield pd.concat(best.values())

    id_type = rows.schema[row_id].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    partial = rows.select(row_id, embedding).mapInPandas(nearest, f"{query_id} {query_type}, {row_id} {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("score", row_id))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ rows.T
    if metric == "neg_dot":
        return -dots
    if metric == "l2sq":
        return ((queries[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2) if queries.size * len(rows) < 1 << 24 else np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * dots, 0)
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1, norms))


class IvfIndex:
    """Cells around centroids fitted on a bounded sample; every row is in one cell, a search reads the nearest cells.

    With the rows stored by cell (partitionBy("cell")) a search reads only the directories of its cells.
    """

    def __init__(self, centroids: np.ndarray, metric: str = "cosine"):
        self.centroids, self.metric = centroids, metric

    @classmethod
    def fit(cls, rows: DataFrame, cells: int = 16, metric: str = "cosine", sample_rows: int = 20_000, rounds: int = 10, embedding: str = "embedding", row_id: str = "vec_id", seed: int = 1) -> IvfIndex:
        """Centroids by k-means over at most sample_rows rows, those of the smallest hashes."""
        sample = rows.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(row_id), row_id).limit(sample_rows).select(embedding).toArrow()
        x = np.array(sample.column(0).to_pylist(), np.float64)
        if not len(x):
            return cls(np.zeros((1, 1)), metric)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            of = _distances(centres, x, "l2sq").argmin(axis=0)
            centres = np.stack([x[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        return cls(centres, metric)

    def assign(self, rows: DataFrame, embedding: str = "embedding", block: int = 4096) -> DataFrame:
        """The rows with their nearest cell; all rows, not only those fitted on. A null vector's cell is null."""
        centroids, own = self.centroids, self.metric if self.metric == "cosine" else "l2sq"

        @F.arrow_udf("int")
        def nearest(batch: pa.Array) -> pa.Array:
            keep = batch.is_valid().to_numpy(zero_copy_only=False)
            x = batch.filter(batch.is_valid()).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centroids.shape[1])
            out = np.zeros(len(batch), np.int32)
            cells = [_distances(centroids, x[at : at + block], own).argmin(axis=0) for at in range(0, len(x), block)]
            out[keep] = np.concatenate(cells) if cells else 0
            return pa.array(out, mask=~keep)

        return rows.withColumn("cell", nearest(F.col(embedding)))

    def cells(self, query: Sequence[float], probes: int) -> list[int]:
        own = self.metric if self.metric == "cosine" else "l2sq"
        d = _distances(np.array([query], np.float64), self.centroids, own)[0]
        return np.argsort(d, kind="stable")[:probes].tolist()

    def search(self, assigned: DataFrame, query: Sequence[float], k: int, probes: int = 4, tie: Sequence[str] = ("vec_id",)) -> DataFrame:
        """The k nearest rows of the nearest cells; rows kept as codes and scale (see store()) are compared as such."""
        rows = assigned.where(F.col("cell").isin(self.cells(query, probes)))
        if "codes" not in rows.columns:
            return topk(rows, query, k, self.metric, tie=tie)
        found = rows.withColumn("score", vectors.distance_to_codes(self.metric, F.col("codes"), F.col("scale"), query))
        return found.orderBy(F.col("score").asc_nulls_last(), *tie).limit(k)

    # On disk

    def store(self, rows: DataFrame, path: str, quantized: bool = False, embedding: str = "embedding", mode: str = "errorifexists") -> None:
        """Writes the rows by cell, and the centroids; a search then reads the folders of its cells only.

        quantized: vectors are kept in 8 bits with a scale each, a quarter of the bytes, instead of as they are. With mode
        append, new rows join the cells of the centroids that are there.
        """
        kept = self.assign(rows, embedding)
        if quantized:
            kept = kept.withColumn("q", vectors.quantize_int8(F.col(embedding))).select("*", "q.codes", "q.scale").drop("q", embedding)
        kept.repartition("cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
        if mode != "append":
            table = [(i, c.tolist(), self.metric) for i, c in enumerate(self.centroids)]
            rows.sparkSession.createDataFrame(table, "cell int, centre array<double>, metric string").coalesce(1).write.mode(mode).parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[IvfIndex, DataFrame]:
        """The index of a folder, and its rows."""
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # a row a centroid
        return cls(np.array([r.centre for r in cells]), cells[0].metric), spark.read.parquet(f"{path}/rows")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", row_id: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    hits = exact.join(found.select(query_id, row_id).withColumn("hit", F.lit(1)), [query_id, row_id], "left")
    return float(hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)
