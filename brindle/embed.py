"""Embedders: a batch of texts to as many vectors, in order."""

from __future__ import annotations

from collections import OrderedDict
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import cache_key


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Vectors that a text's hash seeds: FNV-1a, then xorshift64; the top 24 bits of each number, in (-1, 1), unit length.

    In single precision unless dtype is np.float64.
    """

    def __init__(self, dim: int = 64, model: str = "hash", dtype: type = np.float32):
        self.dim, self.model, self.dtype = dim, model, dtype

    def embed(self, texts: list[str]) -> np.ndarray:
        state = np.array([self._seed(t.encode()) for t in texts], np.uint64)
        out = np.empty((len(texts), self.dim), self.dtype)
        for k in range(self.dim):
            state ^= state << np.uint64(13)
            state ^= state >> np.uint64(7)
            state ^= state << np.uint64(17)
            out[:, k] = (state >> np.uint64(40)).astype(self.dtype) / self.dtype(1 << 24) * 2 - 1
        norms = np.zeros(len(texts), self.dtype)
        for k in range(self.dim):  # in this precision, one after the other
            norms += out[:, k] * out[:, k]
        norms = np.sqrt(norms)
        return out / np.where(norms > 0, norms, 1)[:, None]

    @staticmethod
    def _seed(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for byte in data:
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h or 0x9E3779B97F4A7C15


class CachedEmbedder:
    """An embedder behind a cache of the last `size` texts; only misses reach it. Driver side."""

    def __init__(self, inner: Embedder, size: int = 10_000):
        self.inner, self.size, self.model, self.dim = inner, size, inner.model, inner.dim
        self.cache: OrderedDict[str, np.ndarray] = OrderedDict()
        self.hits = self.misses = self.inserts = self.evictions = 0

    def embed(self, texts: list[str]) -> np.ndarray:
        fresh = list(dict.fromkeys(t for t in texts if t not in self.cache))
        found = dict(zip(fresh, self.inner.embed(fresh), strict=True)) if fresh else {}
        out = []
        for t in texts:
            if t in found:
                self.misses += 1
                out.append(found[t])
            else:
                self.hits += 1
                self.cache.move_to_end(t)
                out.append(self.cache[t])
        for t, v in found.items():
            self.cache[t] = v
            self.inserts += 1
        while len(self.cache) > self.size:
            self.cache.popitem(last=False)
            self.evictions += 1
        return np.array(out, np.float32).reshape(len(texts), self.dim)


def embed_column(embedder: Embedder, text: Column) -> Column:
    """array<float> of a text column, by Arrow batches; array<double> of an embedder in doubles."""

    @F.pandas_udf("array<double>" if getattr(embedder, "dtype", np.float32) == np.float64 else "array<float>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(column.fillna("").tolist())))

    return run(text)


def embed_with_table(rows: DataFrame, cache: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """rows with key and embedding; only texts whose key isn't in the cache table (key, embedding) are embedded, once each."""
    keyed = rows.withColumn("key", cache_key(F.lit(embedder.model), F.col(text)))
    missing = keyed.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = missing.select("key", embed_column(embedder, F.col(text)).alias("embedding"))
    return keyed.join(cache.select("key", "embedding").unionByName(fresh), "key", "left")
