"""Hybrid search: two ranked lists with scores brought to 0..1, weighed and merged; merging of query variants; reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07
DEFAULT_WEIGHTS = (0.5, 0.5)

#: What the default expander puts for a word.
SYNONYMS = {
    "vpn": ["virtual private network", "remote access"],
    "k8s": ["kubernetes"],
    "dns": ["domain name system"],
    "tls": ["ssl", "transport layer security"],
    "db": ["database"],
}
MAX_VARIANTS = 8


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The column brought to 0..1 over all rows; 1 for every row if all are alike. Meant for a stage's few hits."""
    bounds = rows.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    return rows.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(spread <= EPSILON, F.lit(1.0)).otherwise((F.col(column) - F.col("_low")) / spread)).drop("_low", "_high")


def stage_k(k: int) -> int:
    return max(4 * k, 16)


def fuse(by_vector: DataFrame, by_words: DataFrame, k: int, weights: tuple[float, float] = DEFAULT_WEIGHTS, key: Sequence[str] = ("bucket", "external_id")) -> DataFrame:
    """The k best by weights[0] * vector part + weights[1] * word part; a missing part is 0. score of by_vector is a distance."""
    near = min_max(by_vector.withColumn("_s", similarity(F.col("score"))), "_s", "_v").select(*key, "_v", *(F.col(c).alias(f"_l_{c}") for c in by_vector.columns if c not in (*key, "score")))
    said = min_max(by_words, "score", "_b").select(*key, "_b", *(F.col(c).alias(f"_r_{c}") for c in by_words.columns if c not in (*key, "score")))
    both = near.join(said, list(key), "full_outer")
    shared = [c for c in by_vector.columns if c not in (*key, "score") and c in by_words.columns]
    score = weights[0] * F.coalesce("_v", F.lit(0.0)) + weights[1] * F.coalesce("_b", F.lit(0.0))
    return both.select(*key, *(F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in shared), score.alias("score")).orderBy(F.col("score").desc(), *key).limit(k)


class Weights:
    """Weights of hybrid search, with exceptions by bucket."""

    def __init__(self, default: tuple[float, float] = DEFAULT_WEIGHTS, by_bucket: dict[str, tuple[float, float]] | None = None):
        self.default, self.by_bucket = default, dict(by_bucket or {})

    def resolve(self, bucket: str | None) -> tuple[float, float]:
        return self.by_bucket.get(bucket, self.default) if bucket is not None else self.default


def expand_query(query: str, synonyms: dict[str, list[str]] | None = None, most: int = MAX_VARIANTS) -> list[str]:
    """The query, and for each word with synonyms the query with that word replaced; at most `most` different ones."""
    table = {k.lower(): [v.lower() for v in vs] for k, vs in (SYNONYMS if synonyms is None else synonyms).items()}
    words = query.split()
    variants = {query: None}
    for at, word in enumerate(words):
        bare = word
        while bare and not bare[0].isalnum():
            bare = bare[1:]
        while bare and not bare[-1].isalnum():
            bare = bare[:-1]
        for other in table.get(bare.lower(), ()):
            if len(variants) >= most:
                return list(variants)
            variants[" ".join([*words[:at], other, *words[at + 1 :]])] = None
    return list(variants)


def merge_variants(hits: Sequence[DataFrame], higher_is_better: bool, key: Sequence[str] = ("bucket", "external_id")) -> DataFrame:
    """The union of the lists with each document's best score, in order."""
    union = hits[0]
    for more in hits[1:]:
        union = union.unionByName(more)
    order = F.col("score").desc() if higher_is_better else F.col("score").asc()
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return union.withColumn("_nth", first).where("_nth = 1").drop("_nth").orderBy(order, *key)


def rerank(hits: DataFrame, query: str, k: int, scorer: Callable[[str, list[str]], list[float]] | None = None, higher_is_better: bool = False, key: Sequence[str] = ("bucket", "external_id")) -> DataFrame:
    """The k best by a scorer's scores (higher is better); without one the order stays and scores are n, n-1, ..

    hits are a search's few rows; a scorer sees them in one call.
    """
    order = F.col("score").desc() if higher_is_better else F.col("score").asc()
    rank = F.row_number().over(Window.orderBy(order, *key))
    ranked = hits.withColumn("_rank", rank)
    if scorer is None:
        total = F.count("*").over(Window.partitionBy())
        return ranked.withColumn("score", (total - F.col("_rank") + 1).cast("double")).orderBy("_rank").limit(k).drop("_rank")
    rows = ranked.orderBy("_rank").collect()
    scores = scorer(query, [r["text"] for r in rows])
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:k]
    kept = hits.sparkSession.createDataFrame([(rows[i]["_rank"], n, float(scores[i])) for n, i in enumerate(best)], "_rank int, _new int, _score double")
    return ranked.join(F.broadcast(kept), "_rank").orderBy("_new").withColumn("score", F.col("_score")).drop("_rank", "_new", "_score")
