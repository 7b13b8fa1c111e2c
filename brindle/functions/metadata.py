"""JSON metadata: paths, and keys under which 1, 1.0 and "1" are three values."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def _value(metadata: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(metadata), json_path(path), "variant")


def json_key(metadata: Column, path: str) -> Column:
    """A string that is equal for equal JSON values only; null where the path is missing or JSON null."""
    v = _value(metadata, path)
    kind = F.schema_of_variant(v)
    tag = F.when(kind == "BIGINT", F.lit("i")).when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), F.lit("f")).otherwise(F.lit(""))
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).otherwise(F.concat(tag, F.to_json(v)))


def literal_key(value: object) -> str | None:
    """The key of a literal; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        text = repr(value)
        return "f" + (text[:-2] if text.endswith(".0") else text)
    return json.dumps(value, ensure_ascii=False)


def json_number(metadata: Column, path: str) -> Column:
    """The value as a double if it is a JSON number, else null."""
    v = _value(metadata, path)
    kind = F.schema_of_variant(v)
    return F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), F.try_variant_get(v, "$", "double"))


def json_string(metadata: Column, path: str) -> Column:
    """The value if it is a JSON string, else null."""
    v = _value(metadata, path)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_text(metadata: Column, path: str) -> Column:
    """The value for display: strings bare, other values as JSON, null where missing."""
    return F.get_json_object(metadata, json_path(path))
