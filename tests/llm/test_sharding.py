import random
import zlib

import numpy as np

from brindle.llm import queries, sharding


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_place_balances():
    rng = np.random.default_rng(0)
    v = rng.random((3000, 3))
    v /= v.sum(axis=0)
    where = sharding.place(v, 24)
    sums = np.zeros((24, 3))
    np.add.at(sums, where, v)
    assert sums.max() * 24 < 1.02 and sums.min() * 24 > 0.98


def test_groups_edges_and_balance(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 300)) for i in range(3000)] + [(5000 + i, f"rare {i} " * 40) for i in range(2000)]
    rows += [(9000 + i, "hot copy of a text " * 5) for i in range(3000)] + [(1, None), (None, "é"), (None, "é"), (7, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, shard string")
    got = sharding.shard(df, 24).collect()
    check(rows, got, 24)
    total = np.zeros(24)
    count = np.zeros(24)
    for r in got:
        total[r.shard] += r.size
        count[r.shard] += 1
    assert total.max() / total.mean() < 1.01 and total.min() / total.mean() > 0.99
    assert count.max() / count.mean() < 1.1
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(("hot copy of a text " * 5).encode())
    assert len(where[hot]) > 1 and all(len(s) == 1 for c, s in where.items() if c != hot)
    again = sharding.shard(df.repartition(7), 24).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard(df.limit(0), 24).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op4_sharding(spark, "/root/testdata/sf0.001").collect(), 24)


def plain_place(vectors, shards):
    """The rule of place(), by loops."""
    free = [[1.0 / shards] * 3 for _ in range(shards)]
    chosen = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        products = [sum(f * v for f, v in zip(own, vectors[i], strict=True)) for own in free]
        chosen[i] = to = max(range(shards), key=lambda s: (round(products[s], 15), -s))
        free[to] = [f - v for f, v in zip(free[to], vectors[i], strict=True)]
    return chosen


def test_place_against_a_plain_packer():
    rng = np.random.default_rng(3)
    for n, shards in ((1, 3), (50, 4), (400, 24)):
        v = rng.random((n, 3)) ** 3
        v /= v.sum(axis=0)
        assert sharding.place(v, shards).tolist() == plain_place(v.tolist(), shards)


def test_even_only_brings_loads_nearer():
    rng = np.random.default_rng(4)
    v = rng.random((500, 3)) ** 4
    v /= v.sum(axis=0)
    chosen = rng.integers(0, 8, 500)

    def squares(where):
        loads = np.zeros((8, 3))
        np.add.at(loads, where, v)
        return (loads**2).sum(), loads

    after = sharding.even(v, chosen, 8)
    assert squares(after)[0] < squares(chosen)[0]
    assert np.ptp(squares(after)[1], axis=0).max() < 0.2 * np.ptp(squares(chosen)[1], axis=0).max()


def test_groups_are_placed_as_the_plain_packer_places_them(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.choice(['a b', 'c', 'd. e, f'])} {rng.randint(0, 40)} " * rng.randint(1, 60)) for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    check(rows, got, 5)
    import re

    import xxhash

    groups = {}
    for _, t in rows:
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        g = groups.setdefault(h - (1 << 64) if h >> 63 else h, [0, 0, 0])
        g[0] += len(t) + 8
        g[1] += len(re.findall(r"'(?:[sdmt]|ll|ve|re)| ?[a-z]+| ?[0-9]+| ?[^\sa-z0-9]+|\s+", t))
        g[2] += 1
    names = sorted(groups)
    v = np.array([groups[h] for h in names], float)
    v /= v.sum(axis=0)
    placed = sharding.even(v, np.array(plain_place(v.tolist(), 5)), 5)
    want = {zlib.crc32(t.encode()): placed[names.index((lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42)))] for _, t in rows}
    assert all(r.shard == want[r.text_crc32] for r in got)


def test_more_groups_than_the_driver_holds(spark):
    rows = [(i, f"text {i} " * (1 + i % 50)) for i in range(3000)] + [(None, "none " * 30)] * 400
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6, units=500).collect()
    check(rows, got, 6)
    total = np.zeros(6)
    for r in got:
        total[r.shard] += r.size
    assert total.max() / total.mean() < 1.02
