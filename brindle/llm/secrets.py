"""Secret scan by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs (`name = "literal"`, `name: literal`,
`"name" => 'a' + 'b'`), constants are carried from name to name (`k = "..."; password = k`), and each literal is
scored by how sensitive the names are that it reaches and by how random it looks. Three fixed patterns are searched
beside it; their spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

KINDS = ("assign", "access", "hex", "named")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: What the parts of a name add to the score of its literal.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "bearer": 2.0, "private": 1.5, "auth": 1.5, "access": 1.0, "api": 1.0,
    "key": 1.0, "signing": 1.0, "client": 0.5, "session": 0.5,
}

TOKEN = re.compile(
    r"""(?P<comment>(?:\#|//)[^\n]*)
    |(?P<quote>["'])
    |(?P<word>[^\W\d][\w.$-]*+|[A-Za-z0-9+/_.=-]{8,}+)
    |(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]\n])
    |(?P<other>\S)""",
    re.X,
)
STRINGS = {'"': re.compile(r'"(?:\\.|[^"\\\n])*+"'), "'": re.compile(r"'(?:\\.|[^'\\\n])*+'")}
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ASSIGNS = {"=", ":", ":=", "=>"}


def name_weight(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in {*parts, *joined})


def randomness(literal: str) -> float:
    """0 to about 3: bits a character, less for short literals and for plain words."""
    n = len(literal)
    if n < 6:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = bool(re.search("[a-z]", literal)) + bool(re.search("[A-Z]", literal)) + bool(re.search("[0-9]", literal)) + bool(re.search("[^A-Za-z0-9]", literal))
    return min(bits, 4.0) / 2 + 0.5 * (kinds - 1) - (0.5 if n < 10 else 0.0)


def _tokens(text: str, at: int, end: int) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of the tokens but for comments. A quote that no other closes on its line is a sign by itself."""
    out = []
    open_till = dict.fromkeys(STRINGS, -1)  # from a quote that nothing closes, no later one of its kind is closed on the line
    while m := TOKEN.search(text, at, end):
        kind, at = m.lastgroup, m.end()
        if kind == "quote":
            kind = "other"
            if m.start() >= open_till[m[0]]:
                whole = STRINGS[m[0]].match(text, m.start(), end)
                if whole:
                    m, kind, at = whole, "string", whole.end()
                else:
                    stop = text.find("\n", m.start(), end)
                    open_till[m[0]] = end if stop < 0 else stop
        if kind != "comment":
            out.append((kind, m[0], m.start(), m.end()))
    return out


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[int]]]:
    """(name, spans of its own literals, numbers of the assignments whose names it takes on) of each assignment.

    Only lines with `=` or `:`, and the lines that they go on in, are lexed: no other line holds an assignment.
    """
    constants: dict[str, int] = {}
    at = nth = 0
    for start, end in _regions(text):
        at = max(at, start)
        tokens = _tokens(text, at, end)
        at = end
        i = 0
        while i + 1 < len(tokens):
            kind, name, _, _ = tokens[i]
            if kind not in ("word", "string") or tokens[i + 1][1] not in ASSIGNS:
                i += 1
                continue
            name = name.strip("\"'")
            i += 2
            spans: list[tuple[int, int]] = []
            taken: list[int] = []
            while i < len(tokens):
                while i < len(tokens) and tokens[i][1] in ("\n", "("):
                    i += 1
                if i == len(tokens) or tokens[i][0] not in ("string", "word"):
                    break
                kind, value, a, b = tokens[i]
                if i + 1 < len(tokens) and tokens[i + 1][1] in ASSIGNS and kind == "word" and "\n" in text[tokens[i - 1][2] : a]:
                    break  # the next line's own name
                if kind == "string":
                    spans.append((a + 1, b - 1))
                elif value in constants:
                    taken.append(constants[value])
                else:
                    spans.append((a, b))
                i += 1
                if i < len(tokens) and tokens[i][1] == "+":
                    i += 1
                    continue
                break
            if spans or taken:
                yield name, spans, taken
                constants[name] = nth
                nth += 1


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of lines to lex: those with an assignment sign, and each line after one that ends in a sign that goes on."""
    n, done = len(text), 0
    signs = {"=": -1, ":": -1}
    while done < n:
        for sign, p in signs.items():  # n: there is no further one
            if p < done:
                found = text.find(sign, done)
                signs[sign] = n if found < 0 else found
        sign = min(signs.values())
        if sign == n:
            return
        start = max(done, text.rfind("\n", done, sign) + 1)
        line, end = start, text.find("\n", sign)
        while end >= 0 and text[line:end].rstrip()[-1:] in ("=", ":", "+", "(", "\\"):
            line = end + 1
            end = text.find("\n", line)
            if not text[line : end if end >= 0 else n].strip():
                break
        end = n if end < 0 else end
        yield start, end
        done = end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def named_spans(text: str, threshold: float) -> list[tuple[str, int, int, float]]:
    """Literals whose names and looks together reach the threshold; each literal once, with its best score."""
    if "=" not in text and ":" not in text:
        return []
    found = list(assignments(text))
    reach = [name_weight(name) for name, _, _ in found]
    for i in range(len(found) - 1, -1, -1):  # a literal counts by the most sensitive name that takes it on
        for taken in found[i][2]:
            reach[taken] = max(reach[taken], reach[i])
    best: dict[tuple[int, int], float] = {}
    for weight, (_, spans, _) in zip(reach, found, strict=True):
        if weight < 1.0:
            continue
        for span in spans:
            score = weight + randomness(text[span[0] : span[1]])
            if span[1] - span[0] >= 6 and score >= threshold:
                best[span] = max(best.get(span, 0.0), score)
    return [("named", a, b, s) for (a, b), s in best.items()]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_secrets(docs: DataFrame, threshold: float = 4.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, spans array<struct<kind, start, end, score>> (code points, end exclusive) by start.

    Rows are looked at one by one, with no shuffle; copies of a row give equal rows. A null text counts as empty and
    has no spans; a null id stays null; an empty table gives no rows. Other columns are left out, whatever their names.
    Whole texts are lexed in time that grows with their length, names assigned from themselves or in long chains too.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def scan(batches):
        for piece in slices(batches, text_column):
            spans = []
            for text in texts(piece.column(1)).to_pylist():
                own = [{"kind": k, "start": a, "end": b, "score": 9.0} for k, a, b in base_spans(text)]
                own += [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in named_spans(text, threshold)]
                spans.append(sorted(own, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, kind)], [id_column, "spans"])

    kept = docs.select(id_column, docs[text_column].cast("string").alias(text_column))
    return kept.mapInArrow(scan, f"`{id_column}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
