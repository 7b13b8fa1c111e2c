"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are",
    "was", "were", "be", "been", "as", "at", "by", "it", "this", "that", "these", "those", "from",
    "we", "you", "they", "i", "he", "she", "his", "her", "its", "our", "their", "not", "no", "do",
    "does", "did", "can", "will", "would", "should", "if", "then", "else", "so", "than", "too",
)

#: Document types by file extension; all others are text.
DOC_TYPES = {
    "markdown": ("md", "markdown"),
    "html": ("html", "htm"),
    "code": ("rs", "py", "js", "ts", "go", "java", "c", "h", "cpp", "hpp", "rb", "php", "cs", "swift", "kt", "scala", "sh"),
    "structured": ("csv", "tsv", "jsonl", "ndjson"),
}


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Text between tags; scripts and styles go with what is in them, entities stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return collapse(F.regexp_replace(bare, r"<[^>]*>", " "))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def doc_type_for(path: Column) -> Column:
    kind = F.when(F.lit(False), F.lit(""))
    for name, extensions in DOC_TYPES.items():
        kind = kind.when(extension(path).isin(*extensions), F.lit(name))
    return kind.otherwise(F.lit("text"))


def doc_id_for(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def summarize(text: Column, most: int = 280) -> Column:
    """White space collapsed; longer texts end at the last space within `most` characters, with an ellipsis."""
    flat = collapse(text)
    head = F.substring(flat, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def keywords(text: Column, n: int = 8) -> Column:
    """The n most frequent words of three letters or more that are no stopwords, ties by the alphabet."""
    words = F.array_sort(F.filter(tokenize(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))

    def best(o: Column) -> Column:
        """o: sorted words; each distinct one is a stretch from one change to the next."""
        changes = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))

        def counted(at: Column) -> Column:
            runs = F.transform(at, lambda s, k: F.struct((s - F.coalesce(F.get(at, k + 1), F.size(o))).alias("n"), F.get(o, s).alias("w")))
            return F.transform(F.slice(F.array_sort(runs), 1, n), lambda r: r["w"])

        return F.when(F.size(o) > 0, _bound(changes, counted)).otherwise(F.array().cast("array<string>"))

    return _bound(words, best)


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once and not again for each element that use looks at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def char_count(text: Column) -> Column:
    return F.length(text)


def build_metadata(text: Column, doc_type: Column, source: Column | None = None, n: int = 8) -> Column:
    parts = [char_count(text).alias("char_count"), doc_type.alias("doc_type"), keywords(text, n).alias("keywords")]
    return F.to_json(F.struct(*parts, *([source.alias("source")] if source is not None else []), summarize(text).alias("summary")))


def attribution(chunk_id: Column) -> Column:
    """struct<doc, chunk>: the part before the last #, and the number after it or null."""
    split = F.regexp_extract(chunk_id, r"(?s)^(.*)#([^#]*)$", 1)
    tail = F.regexp_extract(chunk_id, r"(?s)^(.*)#([^#]*)$", 2)
    has = F.instr(chunk_id, "#") > 0
    return F.struct(F.when(has, split).otherwise(chunk_id).alias("doc"), F.when(has & tail.rlike(r"^\+?[0-9]+$"), tail.try_cast("int")).alias("chunk"))


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), text), 256)


def to_text(value: Column) -> Column:
    """How a text-only protocol shows a value: null is the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def principal_fingerprint(authorization: Column, peer_ip: Column) -> Column:
    token = F.when(authorization.startswith("Bearer "), F.concat(F.lit("bearer:"), F.substring(authorization, 8, 16)))
    return F.coalesce(token, F.concat(F.lit("ip:"), peer_ip), F.lit("anon"))


def version_lt(a: str, b: str) -> bool:
    """Whether version a comes before b; False unless both have three numbers."""

    def numbers(version: str) -> tuple[int, ...] | None:
        parts = [p.partition("-")[0] for p in version.split(".")][:3]
        return tuple(map(int, parts)) if len(parts) == 3 and all(p.isdecimal() for p in parts) else None

    x, y = numbers(a), numbers(b)
    return x is not None and y is not None and x < y
