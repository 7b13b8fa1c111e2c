"""Retrieval-augmented answers: grounding, prompt, a language model, and where the answer comes from."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import AnswerFailure


class LanguageModel(Protocol):
    def stream(self, prompt: str) -> Iterator[str]: ...


class EchoModel:
    """Says `Answer: ` and its prompt, a word at a time."""

    def stream(self, prompt: str) -> Iterator[str]:
        if not prompt.strip():
            raise AnswerFailure("empty prompt")
        word = ""
        for c in f"Answer: {prompt}":
            word += c
            if c == " ":
                yield word
                word = ""
        if word:
            yield word


def build_prompt(question: str, snippets: list[str]) -> str:
    context = "Context:\n" + "".join(f"[{i}] {s}\n" for i, s in enumerate(snippets)) + "\n" if snippets else ""
    return f"{context}Question: {question}\nAnswer concisely using only the context above."


def prompt_column(question: Column, snippets: Column) -> Column:
    """build_prompt over an array column of snippets in order."""
    lines = F.transform(snippets, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s, F.lit("\n")))
    context = F.when(F.size(snippets) > 0, F.concat(F.lit("Context:\n"), F.array_join(lines, ""), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(context, F.lit("Question: "), question, F.lit("\nAnswer concisely using only the context above."))


def generate_column(model: LanguageModel, prompt: Column) -> Column:
    """What the model says to each prompt, its deltas joined; null for a null prompt. An Arrow batch goes to a task's model at a time."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if p is None else "".join(model.stream(p)) for p in batch.to_pylist()], pa.string())

    return run(prompt)


def attribute(hit_id: str, score: float) -> dict:
    doc, mark, chunk = hit_id.rpartition("#")
    if not mark:
        return {"doc": hit_id, "chunk": None, "score": score}
    return {"doc": doc, "chunk": int(chunk) if chunk.isascii() and chunk.isdecimal() else None, "score": score}


def answer_events(question: str, hits: list[dict], model: LanguageModel) -> Iterator[dict]:
    """context events, answer_delta events, then done; error if the model fails."""
    for i, hit in enumerate(hits):
        yield {"event": "context", "index": i, "id": hit["id"], "text": hit["text"], "score": hit["score"]}
    try:
        for delta in model.stream(build_prompt(question, [h["text"] for h in hits])):
            yield {"event": "answer_delta", "delta": delta}
    except Exception as e:  # what a model raises is told to the reader of the stream
        yield {"event": "error", "message": str(e)}
        return
    yield {"event": "done"}
