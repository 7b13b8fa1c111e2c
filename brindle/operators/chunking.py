"""Texts to chunks: fixed windows in SQL, and sentence, heading and code chunkers as Arrow-batched functions.

A chunk is struct<index, char_start, text>; places are code points. A null text has no chunks, as an empty one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..model import CHUNK

CHARS, OVERLAP = 500, 50

#: Words that open a definition at the start of a line.
DEFINITIONS = ("fn", "pub", "async", "def", "class", "func", "impl", "struct", "enum", "trait", "interface", "type", "export", "function", "module")

HEADING = re.compile(r"\s*#{1,6} ")
DEFINITION = re.compile(rf"(?:{'|'.join(DEFINITIONS)})(?!\S)")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise InvalidRequest("chunk size must be > 0")
    if overlap < 0 or overlap >= size:
        raise InvalidRequest("overlap must be smaller than the chunk size")


def fixed_chunks(text: Column, size: int = CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each starting size - overlap after the last; the last one ends with the text."""
    check_sizes(size, overlap)
    stride = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / stride).cast("int") * stride
    starts = F.sequence(F.lit(0), last, F.lit(stride))
    windows = F.transform(starts, lambda s, i: F.struct(i.alias("index"), s.alias("char_start"), F.substring(text, s + 1, F.lit(size)).alias("text")))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast(f"array<{CHUNK}>"))


Part = tuple[int, str]


def fixed_parts(text: str, size: int, overlap: int) -> list[Part]:
    stops = range(0, max(len(text) - size, 0) + size - overlap, size - overlap)
    parts = [(s, text[s : s + size]) for s in stops if s < len(text)]
    while len(parts) > 1 and parts[-2][0] + size >= len(text):
        parts.pop()
    return parts


def sentence_parts(text: str, size: int, overlap: int) -> list[Part]:
    """Sentences packed up to `size`; a full chunk's tail begins the next one, as far as the next sentence leaves room."""
    out: list[Part] = []
    held, start = "", 0
    for m in SENTENCE.finditer(text):
        sentence = m[0]
        if len(sentence) > size:
            if held:
                out.append((start, held))
                held = ""
            out += [(m.start() + s, t) for s, t in fixed_parts(sentence, size, overlap)]
        elif len(held) + len(sentence) > size:
            out.append((start, held))
            room = min(overlap, size - len(sentence))
            tail = held[len(held) - room :] if room else ""
            held, start = tail + sentence, max(m.start() - len(tail), 0)
        else:
            start = start if held else m.start()
            held += sentence
    if held:
        out.append((start, held))
    return out


def _sections(text: str, opens: re.Pattern) -> list[Part]:
    """The text cut before each line that `opens` matches."""
    starts, at = [0], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if at and opens.match(line):
            starts.append(at)
        at += len(line)
    return [(a, text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True) if b > a]


def section_parts(text: str, size: int, overlap: int, opens: re.Pattern, inner) -> list[Part]:
    out: list[Part] = []
    for start, section in _sections(text, opens):
        if not section.strip():
            continue
        out += [(start, section)] if len(section) <= size else [(start + s, t) for s, t in inner(section, size, overlap)]
    return out


def heading_parts(text: str, size: int, overlap: int) -> list[Part]:
    return section_parts(text, size, overlap, HEADING, sentence_parts)


def code_parts(text: str, size: int, overlap: int) -> list[Part]:
    return section_parts(text, size, overlap, DEFINITION, fixed_parts)


STRATEGIES = {"fixed": fixed_parts, "sentence": sentence_parts, "heading": heading_parts, "code": code_parts}
#: Which strategy a document type has.
BY_TYPE = {"markdown": "heading", "html": "heading", "code": "code", "text": "sentence", "structured": "fixed"}


def chunks(text: Column, strategy: Column | str = "sentence", size: int = CHARS, overlap: int = OVERLAP) -> Column:
    """array<chunk> by a strategy, the same for all rows or one a row; unknown ones count as sentence."""
    check_sizes(size, overlap)
    if isinstance(strategy, str) and strategy == "fixed":
        return fixed_chunks(text, size, overlap)

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(texts: pd.Series, strategies: pd.Series) -> pd.Series:
        return pd.Series([
            [{"index": i, "char_start": s, "text": t} for i, (s, t) in enumerate(STRATEGIES.get(how, sentence_parts)(text, size, overlap))] if text else []
            for text, how in zip(texts, strategies, strict=True)
        ])

    return run(text, F.lit(strategy) if isinstance(strategy, str) else strategy)


def strategy_for(doc_type: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for kind, strategy in BY_TYPE.items():
        found = found.when(doc_type == kind, F.lit(strategy))
    return found.otherwise(F.lit("sentence"))


def explode_documents(docs: DataFrame, strategy: Column | str = "sentence", size: int = CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Corpus rows of documents (bucket, doc_id, text, metadata): one a chunk, named doc_id#index, metadata copied."""
    cut = docs.select("bucket", "doc_id", "metadata", F.explode(chunks(F.col("text"), strategy, size, overlap)).alias("c"))
    return cut.select("bucket", F.concat(F.col("doc_id"), F.lit("#"), F.col("c.index").cast("string")).alias("external_id"), F.col("c.text").alias("text"), "metadata", F.col("doc_id").alias("parent_doc_id"), F.col("c.index").alias("chunk_index"), F.col("c.char_start").alias("char_start"))
