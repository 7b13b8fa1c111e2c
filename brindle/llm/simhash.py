"""SimHash near-duplicates, linked by BK-trees.

Every text gets a 64-bit fingerprint. Distinct fingerprints that differ in at most `radius` bits are linked. A link's two
fingerprints agree on at least one of radius + 1 stretches of bits, so each fingerprint goes to the shards of its
stretches, and in each shard a BK-tree (children keyed by their integer Hamming distance to the parent) is built and
asked. A shard that is too large for one tree is dealt again by stretches of the remaining bits, which loses no link
for the same reason. Within a shard only a spanning forest of the links is handed on, never all pairs, and
components are found over those stars by rounds of joins and aggregations, without the driver.

The trees stay in the tasks that hold their shards: all fingerprints of a corpus have no size bound, so they are dealt
out and not broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Between, discard, slices, stored, texts

BITS = 64
#: Fingerprints that one tree may hold before its shard is dealt again; it bounds the time of a task, not the result.
TREE_MOST = 1500


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit k is 1 if it is set in over half of the XXH64s of the word shingles; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.array([digest(s, seed) for s in joined], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed bigint) of every row; a null text counts as empty."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for piece in slices(batches, text_column):
            values = np.array([fingerprint(t, width) for t in texts(piece.column(1)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(values)], [id_column, "fp"])

    return docs.select(id_column, docs[text_column].cast("string").alias(text_column)).mapInArrow(run, f"`{id_column}` {id_type}, fp bigint")


class BKTree:
    """Fingerprints under the Hamming metric; a search follows only the edges whose length can hold a match."""

    def __init__(self, root: int):
        self.values = [root]
        self.children: list[dict[int, int]] = [{}]

    def add(self, value: int) -> int:
        """Inserts the value and returns its node; equal values share one."""
        node = 0
        while True:
            distance = (self.values[node] ^ value).bit_count()
            if not distance:
                return node
            below = self.children[node].get(distance)
            if below is None:
                self.children[node][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            node = below

    def within(self, value: int, radius: int):
        """The nodes at most `radius` from the value."""
        values, children = self.values, self.children
        stack = [0]
        while stack:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            for edge, child in children[node].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its component) for each value that isn't that smallest one itself."""
    values = sorted(set(values))
    tree, parent = BKTree(values[0]), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values[1:], 1):
        for near in tree.within(value, radius):
            a, b = root(near), root(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _stretches(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of `parts` stretches that cover n_bits bits."""
    cuts = [n_bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(shift: int, width: int) -> int:
    value = ((1 << width) - 1) << shift
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int, tree_most: int = TREE_MOST, between: Between | None = None) -> DataFrame:
    """Star links (a, b), b < a, whose components are those of all pairs within the radius. distinct: column fp, once each."""
    parts = radius + 1
    first = _stretches(BITS, parts)
    masks = [(k, _mask(*s)) for k, s in enumerate(first)]
    dealt = _deal(distinct, ["fp"], masks, "k", "key")
    once = (between or Between(distinct.sparkSession)).stored(dealt.repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(_grow(2, radius, tree_most), "a bigint, b bigint, k bigint, key bigint"), "shards")

    def rest(k: int) -> list[int]:
        """Masks of stretches of the bits outside stretch k."""
        others = [b for b in range(BITS) if not first[k][0] <= b < first[k][0] + first[k][1]]
        sums = [sum(1 << b for b in others[a : a + w]) for a, w in _stretches(len(others), parts)]
        return [v - (1 << 64) if v >> 63 else v for v in sums]

    large = once.where("b is null").select(F.col("a").alias("fp"), "k", "key")
    again = reduce(DataFrame.unionByName, [_deal(large.where(F.col("k") == k), ["fp", "k", "key"], list(enumerate(rest(k))), "k2", "key2") for k in range(parts)])
    split = again.repartition("k", "key", "k2", "key2").sortWithinPartitions("k", "key", "k2", "key2").mapInArrow(_grow(4, radius, None), "a bigint, b bigint, k bigint, key bigint")
    return once.where("b is not null").select("a", "b").union(split.select("a", "b"))


def _deal(values: DataFrame, columns: list[str], masks: list[tuple[int, int]], k: str, key: str) -> DataFrame:
    """Each row once for each mask, with the mask's number and the bits under it."""
    shards = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("i"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for i, m in masks))).alias("s")
    return values.select(*columns, shards).select(*columns, F.col("s.i").alias(k), F.col("s.bits").alias(key))


def _grow(width: int, radius: int, tree_most: int | None):
    """A task over rows sorted by shard (fp, then `width` columns that name the shard).

    Gives the links of each shard; the values of a shard with more than tree_most of them come back as they are, with
    their shard and no b. At most one tree's values are held.
    """

    def run(batches):
        held: list[np.ndarray] = []
        count, current, passing = 0, None, False

        def close() -> list[tuple]:
            flat = np.concatenate(held).view(np.uint64).tolist() if held else []
            return [(a, b, None, None) for a, b in np.array(forest(flat, radius), np.uint64).reshape(-1, 2).view(np.int64).tolist()] if len(flat) > 1 else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "k", "key"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + width)]
            if not len(columns[0]):
                continue
            keys = np.stack(columns[1:])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(columns[0])], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != current:
                    out += close()
                    held, count, current, passing = [], 0, key, False
                held.append(columns[0][a:b])
                count += b - a
                passing = passing or tree_most is not None and count > tree_most
                if passing:
                    out += [(v, None, key[0], key[1]) for part in held for v in part.tolist()]
                    held = []
            if out:
                yield batch_of(out)
        if out := close():
            yield batch_of(out)

    return run


def components(stars: DataFrame, most_rounds: int = 60, between: Between | None = None) -> DataFrame:
    """(node, root) of every node in a link, root the smallest signed value of its component.

    Alternates two steps till nothing changes: every node's larger neighbours are linked to its smallest one, then
    every node's smaller neighbours are. Each round is written to the shared folder, so a lost executor costs a round
    at most, and only a count of changes reaches the driver.
    """
    spark = stars.sparkSession
    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())

    edges, path = stored(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(least, "u")
        pairs = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        further, further_path = stored(pairs.select("e.a", "e.b").where("a != b").distinct(), "links")
        discard(spark, path)
        edges, path = further, further_path
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if between is not None:
        between.paths.append(path)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fp bigint, component_id of every row: the smallest id that links within the radius reach, its own included.

    Equal fingerprints are linked, those of texts without words (zero) like any others. A null text counts as empty; a
    row with a null id gets a component like any other but never gives its name to one, unless all ids are null: then
    component_id is null. Repeated rows come back as often as they came.
    """
    printed, _ = stored(fingerprints(docs, width, id_column, text_column), "fingerprints")
    least = printed.groupBy("fp").agg(F.min(id_column).alias("least"))
    between = Between(docs.sparkSession)
    roots = components(links(least.select("fp"), radius, between=between), between=between)
    labelled, _ = stored(least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    between.drop()
    names = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "root").select(F.col("fp").alias("f"), "component_id")
    return printed.join(named, F.col("fp") == F.col("f")).select(id_column, "fp", "component_id")
