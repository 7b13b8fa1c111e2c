"""Plans to DataFrames over a corpus (model.CORPUS) and an embedder.

Retrieval comes first: filters, order, groups and joins see only the rows that a scan retrieved, as many as
Scan.top_k says, or `candidates` rows if that is given (None there: the whole bucket).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..embed import Embedder
from ..functions.metadata import json_key, json_number, json_string, json_text, literal_key
from ..operators import knn
from .plan import Aggregate, Filter, Join, Match, Order, Scan

DEFAULT = object()


@dataclass
class Context:
    corpus: DataFrame
    embedder: Embedder
    metric: str = "cosine"
    dim: int | None = None
    candidates: object = DEFAULT  # rows that a scan retrieves; None: all


def filter_column(f: Filter) -> Column:
    key = json_key(F.col("metadata"), f.path)
    keys = [literal_key(v) for v in f.values]
    known = [k for k in keys if k is not None]
    match = F.coalesce(key.isin(*known), F.lit(False)) if known else F.lit(False)
    return match | key.isNull() if None in keys else match


def hits(scan: Scan, ctx: Context) -> DataFrame:
    """bucket, id, text, metadata, score of the rows retrieved, filters applied."""
    query = ctx.embedder.embed([scan.semantic.query])[0].tolist() if isinstance(scan.semantic, Match) else list(scan.semantic.vector)
    knn.check_dim(query, ctx.dim)
    rows = ctx.corpus.where(F.col("bucket") == scan.bucket)
    k = scan.top_k if ctx.candidates is DEFAULT else ctx.candidates
    if k is None:
        found = rows.withColumn("score", knn.vectors.distance_to(ctx.metric, F.col("embedding"), query))
    else:
        found = knn.topk(rows, query, k, ctx.metric)
    found = found.select("bucket", F.col("external_id").alias("id"), "text", "metadata", "score")
    for f in scan.filters:
        found = found.where(filter_column(f))
    return found


def _by_path(path: str, descending: bool) -> list[Column]:
    """A total order: numbers, then strings, then what has neither."""
    number, string = json_number(F.col("metadata"), path), json_string(F.col("metadata"), path)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in (number, string)]


def _ordered(rows: DataFrame, order: Order | None) -> DataFrame:
    if order is None:
        return rows.orderBy("score", "bucket", "id")
    if order.key.lower() == "score":
        # NaN scores come last either way
        value = F.when(~F.isnan("score"), F.col("score"))
        return rows.orderBy(value.desc_nulls_last() if order.descending else value.asc_nulls_last(), "bucket", "id")
    return rows.orderBy(*_by_path(order.key, order.descending), "bucket", "id")


def column(name: str) -> Column:
    return F.col(name) if name in ("id", "bucket", "text", "score") else json_text(F.col("metadata"), name)


def run_scan(scan: Scan, ctx: Context) -> DataFrame:
    rows = _ordered(hits(scan, ctx), scan.order_by)
    rows = rows.limit(knn_limit(scan))
    if scan.columns is None:
        return rows.select("id", "bucket", "score", "text", "metadata")
    return rows.select(*(column(c).alias(c) for c in scan.columns))


def knn_limit(scan: Scan) -> int:
    from .plan import DEFAULT_LIMIT

    return scan.limit if scan.limit is not None else (scan.top_k if scan.filters else DEFAULT_LIMIT)


VIRTUAL = ("id", "bucket", "text")


def run_aggregate(plan: Aggregate, ctx: Context) -> DataFrame:
    rows = hits(plan.input, ctx)
    md = F.col("metadata")
    keys = {k: (F.col(k) if k in VIRTUAL else json_key(md, k)) for k in plan.group_keys}
    shown = {k: (F.col(k) if k in VIRTUAL else json_text(md, k)) for k in plan.group_keys}
    exprs = []
    for a in plan.aggs:
        if a.path is None:
            exprs.append(F.count(F.lit(1)).alias(a.alias))
            continue
        virtual = a.path in VIRTUAL
        number = F.lit(None).cast("double") if virtual else json_number(md, a.path)
        string = F.col(a.path) if virtual else json_string(md, a.path)
        any_value = F.col(a.path) if virtual else json_key(md, a.path)
        exprs.append({
            "count": lambda: F.count(any_value),
            "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
            "avg": lambda: F.avg(number),
            "min": lambda: F.coalesce(F.min(number).cast("string"), F.min(string)),
            "max": lambda: F.coalesce(F.max(number).cast("string"), F.max(string)),
        }[a.fn]().alias(a.alias))
    grouped = rows.groupBy(*(c.alias(f"_key_{i}") for i, c in enumerate(keys.values()))).agg(*exprs, *(F.min(shown[k]).alias(f"_shown_{i}") for i, k in enumerate(keys)))
    out = grouped.select(*(F.col(f"_shown_{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"`{a.alias}`") for a in plan.aggs))
    ties = [F.col(f"`{k}`").asc_nulls_last() for k in plan.group_keys]
    if plan.order_by:
        value = F.col(f"`{plan.order_by.key}`")
        out = out.orderBy(value.desc_nulls_last() if plan.order_by.descending else value.asc_nulls_last(), *ties)
    else:
        out = out.orderBy(*ties)
    return out.limit(plan.limit) if plan.limit is not None else out


def run_join(plan: Join, ctx: Context) -> DataFrame:
    def side(scan: Scan, prefix: str, key: str) -> DataFrame:
        rows = hits(scan, ctx)
        value = F.concat(F.lit("s"), F.to_json(F.struct(F.col(key).alias("v")))) if key in VIRTUAL else json_key(F.col("metadata"), key)
        return rows.select(value.alias(f"{prefix}key"), *(F.col(c).alias(f"{prefix}{c}") for c in ("id", "text", "metadata", "score")))

    left, right = side(plan.left, "l_", plan.left_column), side(plan.right, "r_", plan.right_column)
    both = left.join(right, F.col("l_key") == F.col("r_key"))
    names = plan.columns
    if names is None:
        names = tuple(f"{a}.{c}" for a in (plan.left_alias, plan.right_alias) for c in ("id", "text", "score", "metadata"))

    def value(name: str) -> Column:
        alias, _, rest = name.partition(".")
        prefix = {plan.left_alias: "l_", plan.right_alias: "r_"}.get(alias)
        if prefix is None or not rest or "." in rest:
            return F.lit(None).cast("string")
        if rest in ("id", "text", "score", "metadata"):
            return F.col(prefix + rest)
        return json_text(F.col(f"{prefix}metadata"), rest)

    def order_value(name: str) -> list[Column]:
        alias, _, rest = name.partition(".")
        prefix = {plan.left_alias: "l_", plan.right_alias: "r_"}.get(alias)
        if prefix is None or not rest or "." in rest:
            return []
        if rest in ("id", "text", "score", "metadata"):
            return [F.col(prefix + rest)]
        md = F.col(f"{prefix}metadata")
        return [json_number(md, rest), json_string(md, rest)]

    mean = (F.col("l_score") + F.col("r_score")) / 2
    keys = [mean]
    descending = False
    if plan.order_by:
        descending = plan.order_by.descending
        keys = [mean] if plan.order_by.key.lower() == "score" else order_value(plan.order_by.key)
    ordered = both.orderBy(*(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys), "l_id", "r_id")
    if plan.limit is not None:
        ordered = ordered.limit(plan.limit)
    return ordered.select(
        F.concat("l_id", F.lit(":"), "r_id").alias("id"), F.lit(f"{plan.left_alias}⋈{plan.right_alias}").alias("bucket"), mean.alias("score"), *(value(n).alias(n) for n in names)
    )


def run(plan: Scan | Aggregate | Join, ctx: Context) -> DataFrame:
    return {"scan": run_scan, "aggregate": run_aggregate, "join": run_join}[plan.node](plan, ctx)
