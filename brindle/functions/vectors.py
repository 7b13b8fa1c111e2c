"""Vector distances, and storage in 8 bits, as column expressions over array<float> columns; all sums are in doubles.

Between two columns a distance is a fold over the arrays. Against one constant vector it is worked out for a whole
Arrow batch at once: folds are interpreted an element at a time, and a search does nothing but these sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2sq", "neg_dot")


def vector(values: Sequence[float]) -> Column:
    """A constant array<double>."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a||b|); 1 if either is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def neg_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "l2sq": l2sq, "neg_dot": neg_dot}[metric](a, b)


def distances(metric: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The distance of each row to the query; equal rows have equal distances wherever they stand."""
    if metric == "l2sq":
        return ((rows - query) ** 2).sum(axis=1)
    dots = (rows * query).sum(axis=1)
    if metric == "neg_dot":
        return -dots
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1.0, norms))


def distance_to(metric: str, column: Column, query: Sequence[float]) -> Column:
    """The distance of an array column to a constant vector; null for a null array, for null elements and for another length."""
    if metric not in METRICS:
        raise KeyError(metric)
    asked = np.array(query, np.float64)

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        good = pc.fill_null(pc.equal(pc.list_value_length(batch), len(asked)), False)
        if batch.flatten().null_count:
            good = pa.array([bool(g) and None not in v for g, v in zip(good.to_pylist(), batch.to_pylist(), strict=True)])
        rows = batch.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
        out = np.full(len(batch), np.nan)
        keep = good.to_numpy(zero_copy_only=False)
        out[keep] = distances(metric, asked, rows)
        return pa.array(out, mask=~keep)

    return run(column)


def scale_int8(v: Column) -> Column:
    """Largest magnitude / 127; 0 for an all-zero vector."""
    return F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0)) / 127


def quantize_int8(v: Column) -> Column:
    """struct<codes, scale>: each value / scale, rounded half away from zero and held to +-127."""
    scale = scale_int8(v)
    codes = F.transform(v, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int")))).cast("tinyint"))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def dequantize(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale)


def asymmetric_distance(metric: str, query: Column, codes: Column, scale: Column) -> Column:
    """A full-precision query against a stored 8-bit vector."""
    return distance(metric, query, dequantize(codes, scale))


def distance_to_codes(metric: str, codes: Column, scale: Column, query: Sequence[float]) -> Column:
    """distance_to() of a stored 8-bit vector; null for null codes and for another length."""
    if metric not in METRICS:
        raise KeyError(metric)
    asked = np.array(query, np.float64)

    @F.arrow_udf("double")
    def run(batch: pa.Array, scales: pa.Array) -> pa.Array:
        good = pc.fill_null(pc.equal(pc.list_value_length(batch), len(asked)), False)
        rows = batch.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
        keep = good.to_numpy(zero_copy_only=False)
        out = np.full(len(batch), np.nan)
        out[keep] = distances(metric, asked, rows * scales.to_numpy(zero_copy_only=False)[keep][:, None])
        return pa.array(out, mask=~keep)

    return run(codes, scale)
