"""What the engine asks of other machines over HTTP: a reranker's scores, and a place that change events go to."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from .errors import InvalidRequest


def post(url: str, body: object, timeout: float = 5.0, headers: dict[str, str] | None = None) -> object:
    """Posts JSON and returns the JSON that comes back, None for an empty answer."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}), method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        raw = answer.read()
    return json.loads(raw) if raw else None


class HttpReranker:
    """A scorer for fusion.rerank: posts {query, documents}, takes {scores: [..]} or {results: [{index, score}, ..]}.

    A document that the results leave out comes last; an answer of another shape is an error.
    """

    def __init__(self, url: str, timeout: float = 10.0, headers: dict[str, str] | None = None):
        self.url, self.timeout, self.headers = url, timeout, headers

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        if not documents:
            return []
        said = post(self.url, {"query": query, "documents": documents}, self.timeout, self.headers)
        if isinstance(said, dict) and isinstance(said.get("scores"), list):
            if len(said["scores"]) != len(documents):
                raise InvalidRequest(f"{len(said['scores'])} scores for {len(documents)} documents")
            return [float(x) for x in said["scores"]]
        if isinstance(said, dict) and isinstance(said.get("results"), list):
            scores = [float("-inf")] * len(documents)
            for r in said["results"]:
                if not 0 <= r["index"] < len(documents):
                    raise InvalidRequest(f"no document {r['index']}")
                scores[r["index"]] = float(r["score"])
            return scores
        raise InvalidRequest("the reranker's answer has neither scores nor results")


def webhook(url: str, timeout: float = 5.0, headers: dict[str, str] | None = None) -> Callable[[list[dict]], None]:
    """A sink for cdc.to_callable: each event is posted by itself, in order, once; no retry."""

    def sink(events: list[dict]) -> None:
        for event in events:
            post(url, event, timeout, headers)

    return sink
