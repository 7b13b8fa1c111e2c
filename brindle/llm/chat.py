"""Chat formatting as a prefix tree.

Conversations that share their first turns share tree nodes, and a node's tokens are emitted once. A node is a longest run
of turns that the same conversations pass through. Nodes lie depth first in one line of tokens; each carries the position
id of its first token (the tokens of its ancestors) and its ancestors' stretches of the line, which are what its tokens
may attend to besides the node's own earlier ones. Turns are named by a chained hash of all turns up to them, so that
the tree needs no node with all its children in one place: a first turn that a third of the corpus shares is one row.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. In texts a backslash is doubled and `<|` becomes `<\\|`, in roles a line
break becomes `\\n` too; a backslash followed by any character gives that character back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Between, join_hot, stored

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def tokenizer(path: str):
    """A byte-level tokenizer, so that decoding gives the text back; marks in a text are ordinary text to it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


def _grouped(batches, width: int) -> Iterator[list[tuple]]:
    """The rows of each run with equal first column, over batch borders."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _chunks(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _table(held, schema)
            held = []
    if held:
        yield _table(held, schema)


def format_tree(conversations: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the prefix tree of conversations (conv_id, turn, role, text).

    nodes: key, start, n_tokens, position, ids array<int>, loss and ancestors array<struct<a, b>>, owner. start is the
    node's place in the depth-first line; loss are the stretches of its ids that are an assistant's texts; ancestors
    are stretches of the line, joined where they touch. members: conv_id, nth, key: a conversation's nodes from the root.

    Turns are taken in order of turn, role and text, null turns first; repeated rows are turns of their own. A null role
    or text counts as empty; the rows with a null conv_id are one conversation, laid out by one task. No rows give an empty
    tree; other columns are left out. A conversation is held by one task at a time; nothing else is gathered. Nodes that
    very many conversations share are broadcast to where these lie if they are small (see join_hot()), not shuffled.
    """
    spark = conversations.sparkSession
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    arrow_id = to_arrow_type(conversations.schema["conv_id"].dataType)
    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    named_schema = pa.schema([("conv_id", arrow_id), ("k", pa.int64()), ("key", pa.binary()), ("role", pa.string()), ("text", pa.string())])

    def chain(batches):
        """The turns with their places and chained hashes; only the last hash is held."""

        def turns():
            current, key, k = object(), b"", 0
            for batch in batches:
                for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if conv != current:
                        current, key, k = conv, b"", 0
                    own = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                    key = hashlib.sha256(key + own).digest()[:16]
                    yield conv, k, key, role, text
                    k += 1

        yield from _chunks(turns(), named_schema)

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    between = Between(spark)
    named = between.stored(sorted_rows.mapInArrow(chain, f"conv_id {id_type}, k bigint, key binary, role string, text string"), "turns")
    passing = between.stored(named.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")), "passing")
    counted = join_hot(named, passing, "key", between=between).select("conv_id", "k", "key", "role", "text", "n", "owner")

    node_schema = pa.schema([("conv_id", arrow_id), ("nth", pa.int64()), ("key", pa.binary()), ("owned", pa.bool_()), ("path", pa.binary()), ("position", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def merge(batches):
        """Runs of turns with the same number of conversations become nodes; the owner of a node emits its tokens."""
        coder = tokenizer(tokenizer_path)

        def nodes():
            for turns in _grouped(batches, 7):
                path, position, nth, at = b"", 0, 0, 0
                pieces = [x for _, _, _, role, text, _, _ in turns for x in (f"{START}{escape_role(role)}\n", escape(text), f"{END}\n")]
                coded = [e.ids for e in coder.encode_batch_fast(pieces, add_special_tokens=False)]
                while at < len(turns):
                    last = at
                    while last + 1 < len(turns) and turns[last + 1][5] == turns[at][5]:
                        last += 1
                    ids: list[int] = []
                    loss = []
                    for t in range(at, last + 1):
                        head, body, tail = coded[3 * t : 3 * t + 3]
                        if turns[t][3] == "assistant":
                            loss.append({"a": len(ids) + len(head), "b": len(ids) + len(head) + len(body)})
                        ids += head + body + tail
                    conv, _, key, _, _, _, owner = turns[last]
                    path += key[:8]
                    owned = owner == conv
                    yield conv, nth, key, owned, path, position, len(ids), ids if owned else None, loss if owned else None
                    position += len(ids)
                    nth += 1
                    at = last + 1

        yield from _chunks(nodes(), node_schema, 200)

    merged, _ = stored(
        counted.repartition("conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(merge, f"conv_id {id_type}, nth bigint, key binary, owned boolean, path binary, position bigint, n_tokens bigint, ids array<int>, loss array<struct<a:bigint,b:bigint>>"),
        "tree",
    )

    def lay(batches):
        """Places in the part of the line that this partition holds."""
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), batch.column(1)], ["key", "part", "local", "n_tokens"])
            at = int(ends[-1]) if len(n) else at

    line = merged.where("owned").select("path", "key", "n_tokens")
    laid = between.stored(line.repartitionByRange("path").sortWithinPartitions("path").select("key", "n_tokens").mapInArrow(lay, "key binary, part bigint, local bigint, n_tokens bigint"), "line")
    parts = laid.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect()  # a row a partition
    base, bases = 0, []
    for part, n in parts:
        bases.append((part, base))
        base += n
    starts = laid.join(F.broadcast(spark.createDataFrame(bases, "part bigint, base bigint")), "part").select("key", (F.col("base") + F.col("local")).alias("start"))

    trail_schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("ancestors", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

    def trail(batches):
        """The stretches of the line before each owned node."""

        def nodes():
            for members in _grouped(batches, 6):
                before: list[dict] = []
                for _, _, key, owned, start, n in members:
                    if owned:
                        yield key, start, [dict(x) for x in before]
                    if before and before[-1]["b"] == start:
                        before[-1]["b"] = start + n
                    else:
                        before.append({"a": start, "b": start + n})

        yield from _chunks(nodes(), trail_schema)

    placed = between.stored(starts, "places")
    walked = join_hot(merged.select("conv_id", "nth", "key", "owned", "n_tokens"), placed, "key", between=between).select("conv_id", "nth", "key", "owned", "start", "n_tokens")
    trails = walked.repartition("conv_id").sortWithinPartitions("conv_id", "nth").mapInArrow(trail, "key binary, start bigint, ancestors array<struct<a:bigint,b:bigint>>")
    bodies = merged.where("owned").select("key", "n_tokens", "position", "ids", "loss", F.col("conv_id").alias("owner"))
    nodes, _ = stored(bodies.join(trails, "key").select("key", "start", "n_tokens", "position", "ids", "loss", "ancestors", "owner"), "nodes")
    between.drop()
    return nodes, merged.select("conv_id", "nth", "key")


def read_back(nodes: DataFrame, members: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each conversation's turns, read from the tree's tokens: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_nodes, n_shared_tokens (those that another conversation owns)."""
    id_type = members.schema["conv_id"].dataType.simpleString()
    arrow_id = to_arrow_type(members.schema["conv_id"].dataType)
    schema = pa.schema([("conv_id", arrow_id), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_nodes", pa.int64()), ("n_shared_tokens", pa.int64())])

    def read(batches):
        coder = tokenizer(tokenizer_path)

        def conversations():
            for rows in _grouped(batches, 5):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = formatted = shared = 0
                for conv, _, ids, masks, owner in rows:
                    text = coder.decode(ids, skip_special_tokens=False)
                    formatted += len(text)
                    shared += len(ids) if owner != conv else 0
                    at = 0
                    for m in TURN.finditer(text):
                        if m.start() != at:
                            raise ValueError("a node that is no row of turns")
                        at = m.end()
                        n_turns += 1
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    if at != len(text):
                        raise ValueError("a node that is no row of turns")
                    for mask in masks:
                        own = unescape(coder.decode(ids[mask["a"] : mask["b"]], skip_special_tokens=False))
                        loss_chars += len(own)
                        loss.update(own.encode())
                yield rows[0][0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, len(rows), shared

        yield from _chunks(conversations(), schema)

    joined = join_hot(members, nodes.select("key", "ids", "loss", "owner"), "key", size=F.size("ids") * 4 + F.size("loss") * 16).select("conv_id", "nth", "ids", "loss", "owner")
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "nth").mapInArrow(read, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_nodes bigint, n_shared_tokens bigint")
