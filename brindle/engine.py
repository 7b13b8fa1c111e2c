"""The engine: SQL, search and answers over a corpus."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import rag
from .embed import CachedEmbedder, Embedder, HashEmbedder
from .errors import InvalidRequest
from .operators import fusion, journal, knn, lexical
from .plans import execute
from .plans.plan import Answer, plan, to_json


class ResultCache:
    """Results by statement and model: the last `size` of them, for `ttl` seconds or until the corpus changes."""

    def __init__(self, size: int = 512, ttl: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(model: str, sql: str) -> str:
        return hashlib.sha256(f"{model}\0{sql}".encode()).hexdigest()

    def get(self, key: str):
        entry = self.entries.get(key)
        if entry is None or self.clock() - entry[0] > self.ttl:
            self.misses += 1
            return None
        self.hits += 1
        self.entries.move_to_end(key)
        return entry[1]

    def put(self, key: str, value: object) -> None:
        self.entries[key] = (self.clock(), value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def clear(self) -> None:
        self.entries.clear()


class Engine:
    """Queries over a corpus DataFrame (model.CORPUS).

    words, near: a WordIndex over bucket and external_id, and the folder of an IvfIndex over the corpus; with them search reads a
    query's terms and cells only, else it scans. Whoever changes the corpus keeps them up to date.

    candidates: rows that a SQL scan retrieves before filters, groups and joins; None means the whole bucket; by
    default LIMIT, or 4 times that and 32 at least with filters.
    """

    def __init__(
        self,
        corpus: DataFrame,
        embedder: Embedder | None = None,
        language_model: rag.LanguageModel | None = None,
        metric: str = "cosine",
        dim: int | None = None,
        weights: fusion.Weights | None = None,
        synonyms: dict[str, list[str]] | None = None,
        reranker: Callable[[str, list[str]], list[float]] | None = None,
        candidates: object = execute.DEFAULT,
        cache: ResultCache | None = None,
        words: lexical.WordIndex | None = None,
        near: str | None = None,
        probes: int = 8,
    ):
        self.corpus, self.metric, self.dim = corpus, metric, dim
        self.embedder = CachedEmbedder(embedder or HashEmbedder(dim or 64))
        self.model = language_model or rag.EchoModel()
        self.weights, self.synonyms, self.reranker = weights or fusion.Weights(), synonyms, reranker
        self.candidates, self.cache = candidates, cache or ResultCache()
        self.words, self.probes = words, probes
        self.slow = journal.SlowLog()
        self.index, self.indexed = knn.IvfIndex.load(corpus.sparkSession, near) if near else (None, None)

    def replace_corpus(self, corpus: DataFrame) -> None:
        self.corpus = corpus
        self.cache.clear()

    # SQL

    def sql(self, text: str) -> DataFrame:
        if not text.strip():
            raise InvalidRequest("sql must not be empty")
        planned = plan(text)  # before the cache: a bad statement never hits it
        if isinstance(planned, Answer):
            answer = self.rag_answer(planned.query, planned.top_k, planned.bucket, most_k=None)
            rows = [("ai_answer", answer["answer"], [(s["doc"], s["chunk"], s["score"]) for s in answer["sources"]])]
            return self.corpus.sparkSession.createDataFrame(rows, "id string, answer string, sources array<struct<doc:string,chunk:int,score:double>>")
        key = self.cache.key(self.embedder.model, text)
        found = self.cache.get(key)
        if found is None:
            found = execute.run(planned, execute.Context(self.corpus, self.embedder, self.metric, self.dim, self.candidates))
            self.cache.put(key, found)
        return found

    def query(self, text: str) -> list[Row]:
        """The rows of a statement, brought to the driver; how long it took goes to the slow log."""
        began = time.perf_counter()
        rows = self.sql(text).collect()
        self.slow.note(text, (time.perf_counter() - began) * 1000, len(rows))
        return rows

    def explain(self, text: str) -> str:
        """The typed plan as JSON; nothing runs and the cache isn't touched."""
        if not text.strip():
            raise InvalidRequest("sql must not be empty")
        return to_json(plan(text))

    # Search

    def _hits(self, rows: DataFrame) -> DataFrame:
        return rows.select("bucket", F.col("external_id").alias("id"), "text", "metadata", "score")

    def _bucket(self, bucket: str | None) -> DataFrame:
        return self.corpus if bucket is None else self.corpus.where(F.col("bucket") == bucket)

    def _nearest(self, vector: Sequence[float], k: int, bucket: str | None, probes: int | None = None) -> DataFrame:
        if self.index is None:
            return knn.topk(self._bucket(bucket), vector, k, self.metric)
        rows = self.indexed if bucket is None else self.indexed.where(F.col("bucket") == bucket)
        return self.index.search(rows, vector, k, probes or self.probes, ("bucket", "external_id"))

    def _said(self, query: str, k: int, bucket: str | None) -> DataFrame:
        columns = ("bucket", "external_id", "text", "metadata")
        if self.words is None:
            return lexical.bm25(self.corpus.select(*columns), query, k, bucket=bucket)
        best = self.words.search(query, k, None if bucket is None else F.col("bucket") == bucket)
        found = self.corpus.select(*columns).join(F.broadcast(best), ["bucket", "external_id"])  # k rows
        return found.orderBy(F.col("score").desc(), "bucket", "external_id")

    def vector_search(self, vector: Sequence[float], top_k: int = 10, bucket: str | None = None, ef: int | None = None) -> DataFrame:
        """Nearest rows by distance. ef, how wide to search, is the number of cells to read; without an index the search is exact."""
        knn.check_top_k(top_k)
        knn.check_dim(vector, self.dim)
        return self._hits(self._nearest(vector, top_k, bucket, ef))

    def search(self, query: str, top_k: int = 10, bucket: str | None = None, ef: int | None = None, hybrid: bool = False, most_k: int | None = knn.MAX_TOP_K) -> DataFrame:
        knn.check_top_k(top_k, most_k)
        vector = self.embedder.embed([query])[0].tolist()
        if not hybrid:
            return self._hits(self._nearest(vector, top_k, bucket, ef))
        k = fusion.stage_k(top_k)
        near = self._nearest(vector, k, bucket, ef).select("bucket", "external_id", "text", "metadata", "score")
        said = self._said(query, k, bucket)
        return self._hits(fusion.fuse(near, said, top_k, self.weights.resolve(bucket)))

    def bm25(self, query: str, top_k: int = 10, bucket: str | None = None) -> DataFrame:
        knn.check_top_k(top_k)
        return self._hits(self._said(query, top_k, bucket))

    # Answers

    def grounding(self, query: str, top_k: int = 5, bucket: str | None = None, hybrid: bool = False, expand: bool = False, rerank: bool = False, most_k: int | None = knn.MAX_TOP_K) -> DataFrame:
        knn.check_top_k(top_k, most_k)
        variants = fusion.expand_query(query, self.synonyms) if expand else [query]
        fetch = 3 * top_k if rerank or len(variants) > 1 else top_k
        merged = fusion.merge_variants([self.search(v, fetch, bucket, hybrid=hybrid, most_k=None) for v in variants], hybrid, ("bucket", "id"))
        if rerank:
            return fusion.rerank(merged, query, top_k, self.reranker, hybrid, ("bucket", "id"))
        return merged.limit(top_k)

    def rag_answer(self, query: str, top_k: int = 5, bucket: str | None = None, hybrid: bool = False, expand: bool = False, rerank: bool = False, most_k: int | None = knn.MAX_TOP_K) -> dict:
        hits = [r.asDict() for r in self.grounding(query, top_k, bucket, hybrid, expand, rerank, most_k).collect()]
        answer = "".join(self.model.stream(rag.build_prompt(query, [h["text"] for h in hits])))
        return {"query": query, "answer": answer, "sources": [rag.attribute(h["id"], h["score"]) for h in hits]}

    def rag(self, query: str, top_k: int = 5, bucket: str | None = None) -> dict:
        return self.rag_answer(query, top_k, bucket)

    def rag_stream(self, query: str, top_k: int = 5, bucket: str | None = None, **options) -> Iterator[dict]:
        hits = [r.asDict() for r in self.grounding(query, top_k, bucket, **options).collect()]
        return rag.answer_events(query, hits, self.model)
