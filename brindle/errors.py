"""Errors of the query layer; each has an HTTP-like code and a SQLSTATE."""

from __future__ import annotations


class EngineError(Exception):
    code, sqlstate = 500, "XX000"


class ParseError(EngineError):
    code, sqlstate = 400, "42601"


class Unsupported(EngineError):
    code, sqlstate = 400, "42601"


class InvalidPlan(EngineError):
    code, sqlstate = 400, "42601"


class TypeMismatch(EngineError):
    code, sqlstate = 400, "42804"


class InvalidRequest(EngineError):
    code, sqlstate = 400, "42601"


class NotFound(EngineError):
    code, sqlstate = 404, "XX000"


class IndexFailure(EngineError):
    code, sqlstate = 500, "XX000"


class AnswerFailure(EngineError):
    code, sqlstate = 502, "XX000"
