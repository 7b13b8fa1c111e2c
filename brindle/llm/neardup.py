"""Near-duplicate groups by SimHash where links are texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

At that similarity fingerprints differ in about 10 of 64 bits, too many for shards by equal stretches of bits. So a
shard is named by two least hashes of the shingles instead, BANDS times over: two texts of similarity s share a shard with
a chance of 1 - (1 - s^2)^BANDS, all but 4 in 100,000 at 0.8, whatever the size of the corpus or of a shard. The BK-tree of
a shard finds the rows that have others within RADIUS bits, which texts of 0.8 exceed with a chance of about 1 in 100,000;
fingerprints of a few shingles say little, so texts of fewer than SHORT are not held to it. Those rows are sent on with
their sets of shingles, and every pair of them within the radius is compared exactly, unless exact links join its rows
already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Between, slices, stored, texts
from .simhash import BKTree, _majority, components

WIDTH, LEAST, RADIUS, BANDS = 5, 0.8, 22, 10
#: Texts of fewer shingles are compared with all texts of like size in their shards.
SHORT = 32
#: Fingerprints so close to one in the tree are kept beside it and not put into the tree themselves.
CLOSE = 3
#: Names of rows up to this many (16 MB) are broadcast, more are joined by a shuffle.
BROADCAST_MOST = 1_000_000


def _factors(n: int) -> np.ndarray:
    """n odd numbers that have nothing to do with each other, by the rule of a 64-bit counter whose bits are mixed."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (z ^ z >> np.uint64(31)) | np.uint64(1)


FACTORS = _factors(2 * BANDS)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.array([digest(s, 42) for s in joined], np.uint64))


def least_hashes(own: np.ndarray) -> list[int]:
    """The names of a text's shards, one a band: each from two least hashes of its shingles."""
    if not len(own):
        return []
    with np.errstate(over="ignore"):
        spread = own ^ own >> np.uint64(31)
        least = np.array([(spread * f).min() for f in FACTORS], np.uint64)
        both = least[::2] * np.uint64(0xFF51AFD7ED558CCD) ^ least[1::2]
        return ((both ^ both >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64).tolist()


def row_name(id_column: str, text_column: str) -> Column:
    """What names a row: a hash of its id and text, so that rows which share an id, or have none, stay apart."""
    return F.xxhash64(F.col(id_column).cast("string"), F.col(text_column).cast("string"))


def sketches(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, row, fp, sig, n, keys array<bigint> of every row: its name, fingerprint, a hash of its set of shingles, their number,
    and the names of its shards."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for piece in slices(batches, "__text"):
            fps, sigs, sizes, keys = [], [], [], []
            for text in texts(piece.column(2)).to_pylist():
                own = shingles(text, width)
                fps.append(_majority(own))
                sigs.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                keys.append(least_hashes(own))
            hashes = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (fps, sigs))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *hashes, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["id", "row", "fp", "sig", "n", "keys"])

    chosen = docs.select(F.col(id_column).alias("__id"), row_name(id_column, text_column).alias("__row"), F.col(text_column).cast("string").alias("__text"))
    return chosen.mapInArrow(run, f"id {id_type}, row bigint, fp bigint, sig bigint, n int, keys array<bigint>")


def partnered(fps: list[int], sizes: list[int], radius: int) -> list[bool]:
    """For each row of a shard, whether another row is within the radius, or is about as short as it is.

    Rows close to a fingerprint in the tree are kept beside it, and are asked about along with it.
    """
    tree = BKTree(fps[0])
    beside: list[list[int]] = [[0]]
    few = sum(n < SHORT / LEAST for n in sizes) > 1
    out = [few and n < SHORT / LEAST for n in sizes]
    for i in range(1, len(fps)):
        near = [((tree.values[n] ^ fps[i]).bit_count(), n) for n in tree.within(fps[i], radius + CLOSE)]
        for _, n in near:
            for j in beside[n]:
                if not (out[i] and out[j]) and (fps[j] ^ fps[i]).bit_count() <= radius:
                    out[i] = out[j] = True
        closest = min(near, default=(radius, 0))
        if near and closest[0] <= CLOSE:
            beside[closest[1]].append(i)
        else:
            tree.add(fps[i])
            beside.append([i])
    return out


def links(rows: list[int], fps: list[int], sets: list[bytes], radius: int, least: float) -> list[tuple[int, int]]:
    """Pairs of rows that are similar, enough of them to link all that similar pairs within the radius, or of short texts, link.

    Every such pair is compared exactly unless links that were found already join its rows.
    """
    fp, out = np.array(fps, np.uint64), []
    own = [np.frombuffer(s, np.uint32) for s in sets]
    short = [s.astype(np.uint16) for s in own]
    size, part = np.array([len(s) for s in own]), np.arange(len(own))
    mark = np.zeros(1 << 16, np.bool_)
    for i in range(1, len(own)):
        far = np.bitwise_count(fp[:i] ^ fp[i])
        smaller = np.minimum(size[:i], size[i])
        rest = np.flatnonzero(((far <= radius) | (smaller < SHORT)) & (smaller >= least * np.maximum(size[:i], size[i])))
        rest, step = rest[np.argsort(far[rest], kind="stable")], 1
        while len(rest := rest[part[rest] != part[i]]):
            now, rest, step = rest[:step], rest[step:], min(step * 4, 256)
            if len(now) > 1:  # at most so many are shared, by 16 bits of each hash
                mark[short[i]] = True
                most = np.add.reduceat(mark[np.concatenate([short[j] for j in now])], np.cumsum([0, *size[now[:-1]]]), dtype=np.int64)
                mark[short[i]] = False
                now = now[most >= least * (size[now] + size[i] - most)]
            for j in now:
                if part[j] != part[i] and _similar(own[j], own[i], least):
                    out.append((rows[j], rows[i]))
                    part[part == part[j]] = part[i]
    return out


def _similar(s: np.ndarray, t: np.ndarray, least: float) -> bool:
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared >= least * (len(s) + len(t) - shared)


def _by_shard(found, names: list[str]):
    """A task over rows whose first two columns name the shard, sorted by shard: what found gives for the rows of each shard
    of two rows or more."""

    def run(batches):
        held: list[tuple] = []
        current = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[:2] != current:
                    out += found(sorted(held)) if len(held) > 1 else []
                    held, current = [], row[:2]
                held.append(row)
            if out:
                yield table(out)
        if len(held) > 1 and (out := found(sorted(held))):
            yield table(out)

    return run


def _unsigned(fps) -> list[int]:
    return [f & (1 << 64) - 1 for f in fps]


def similar_pairs(reps: DataFrame, sets, between: Between, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(a, b), a < b, of rows (row, fp, n, keys): links that join what similar pairs join, each once.

    sets gives the table (row, s) for a table of rows. Whatever its size, a shard is one task's at a time: its rows are
    fingerprints first, and the sets of those that have a partner then.
    """
    shard = ["k", "key"]
    dealt = reps.select(F.posexplode("keys").alias("k", "key"), "row", "fp", "n")

    def met(rows):
        ks, keys, names, fps, sizes = zip(*rows, strict=True)
        return [(k, key, name, fp) for k, key, name, fp, yes in zip(ks, keys, names, fps, partnered(_unsigned(fps), list(sizes), radius), strict=True) if yes]

    def linked(rows):
        _, _, names, fps, own = zip(*rows, strict=True)
        return [(min(p), max(p)) for p in links(list(names), _unsigned(fps), list(own), radius, least)]

    sharded = dealt.repartition(*shard).sortWithinPartitions(*shard)
    own_between = Between(reps.sparkSession)
    near = own_between.stored(sharded.mapInArrow(_by_shard(met, [*shard, "row", "fp"]), "k bigint, key bigint, row bigint, fp bigint"), "near")
    full = near.join(own_between.stored(sets(near.select("row").distinct()), "shingles"), "row").select(*shard, "row", "fp", "s")
    found = full.repartition(*shard).sortWithinPartitions(*shard).mapInArrow(_by_shard(linked, ["a", "b"]), "a bigint, b bigint")
    pairs = between.stored(found.distinct(), "candidates")
    own_between.drop()
    return pairs


def shingle_sets(docs: DataFrame, rows: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, s): the sorted 32-bit hashes of the shingles of each of the rows named."""
    ends = rows.select(F.col("row").alias("end"))
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_MOST else ends
    named = docs.select(row_name(id_column, text_column).alias("row"), F.col(text_column).cast("string").alias("text"))

    def sets(batches):
        for piece in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([np.unique(shingles(t, width).astype(np.uint32)).tobytes() for t in texts(piece.column(1)).to_pylist()], pa.binary())], ["row", "s"])

    return named.join(ends, F.col("row") == F.col("end"), "left_semi").mapInArrow(sets, "row bigint, s binary").groupBy("row").agg(F.min("s").alias("s"))


def groups(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, row, component, first) of every row: its name, the smallest id that links of similar texts reach, and whether the row is the
    one that stands for its group: that of the smallest id, of equal ones that of the smaller name.

    Texts with equal sets of shingles, such as copies and texts without words, are linked; a null text counts as empty.
    Rows with a null id are linked like any other; they stand for a group, with a null component, only if all its ids
    are null. Rows that share an id are linked by their texts alone; repeated rows have one name. Ids may be of any type
    that has an order. An empty table gives no rows.
    """
    between = Between(docs.sparkSession)
    sketched, _ = stored(sketches(docs, width, id_column, text_column), "sketches")
    reps = between.stored(sketched.groupBy("sig").agg(F.min(F.struct("row", "fp", "n", "keys")).alias("r")).select("sig", "r.*"), "representatives")
    pairs = similar_pairs(reps.select("row", "fp", "n", "keys"), lambda rows: shingle_sets(docs, rows, width, id_column, text_column), between, least=least)
    roots = components(pairs, between=between)
    named, _ = stored(reps.select("sig", "row").join(roots, F.col("row") == F.col("node"), "left").select(F.col("sig").alias("s"), F.coalesce("root", "row").alias("group")), "groups")
    between.drop()
    members = sketched.select("id", "row", "sig").join(named, F.col("sig") == F.col("s")).select("id", "row", "group")
    firsts = members.groupBy(F.col("group").alias("g")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f"))
    return members.join(firsts, F.col("group") == F.col("g")).select("id", "row", F.col("f.id").alias("component"), (F.col("row") == F.col("f.row")).alias("first"))


def drop_near_duplicates(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, all columns, that stand for their group (see groups()): one document of each, that with the smallest id.

    Rows that share an id, or have none, go only if their text is a near-duplicate; of repeated rows one stays.
    """
    told, _ = stored(groups(docs, least, width, id_column, text_column), "dropped")
    dropped = told.where("not first").select(F.col("row").alias("__dropped")).distinct()
    gone = F.broadcast(dropped) if dropped.count() <= BROADCAST_MOST else dropped
    kept = docs.withColumn("__row", row_name(id_column, text_column)).join(gone, F.col("__row") == F.col("__dropped"), "left_anti")
    repeated, _ = stored(told.where("first").groupBy(F.col("row").alias("__repeated")).count().where("count > 1").select("__repeated"), "repeated")
    if repeated.isEmpty():
        return kept.drop("__row")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_MOST else repeated
    nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    twice = kept.join(repeated, F.col("__row") == F.col("__repeated"), "left_semi").withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return kept.join(repeated, F.col("__row") == F.col("__repeated"), "left_anti").unionByName(twice).drop("__row")
