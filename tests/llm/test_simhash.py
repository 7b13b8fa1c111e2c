import itertools
import random

import numpy as np

from brindle.llm import neardup, queries, simhash


def brute(rows, radius=3):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = simhash.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in values[:50]:
        got = sorted(tree.values[n] for n in tree.within(q, 3))
        assert got == sorted({v for v in values if (v ^ q).bit_count() <= 3})


def links_of(spark, values, radius, tree_most):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    return {(r.node, r.root) for r in simhash.components(simhash.links(df, radius, tree_most)).collect()}


def test_split_shards_lose_no_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    whole, split = links_of(spark, values, 3, 10_000), links_of(spark, values, 3, 5)
    assert whole == split and whole


def test_query_against_all_pairs(spark, tmp_path):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.5:
            old = rng.choice(rows)[1].split()
            if old:
                old[rng.randrange(len(old))] = rng.choice(words)
            rows.append((rng.randint(0, 999), " ".join(old)))
        else:
            rows.append((rng.randint(0, 999), " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 200])))))
    rows += [(7, None), (8, ""), (9, " \n\t"), rows[0], (None, rows[1][1]), (None, "só ÉÉ ÀB"), (12, "a\x1cb C"), (13, "x " * 30_000)]
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op10_simhash(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def similar_brute(rows):
    sets = [set(neardup.shingles(t or "").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_similar_groups_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            old = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                old[rng.randrange(len(old))] = rng.choice(words)
            rows.append((i, " ".join(old)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 60, 200])))))
    rows += [(900, None), (901, "")]
    df = spark.createDataFrame([(d, t, "y") for d, t in rows], "doc_id long, text string, component string")
    want = similar_brute(rows)
    assert {r.id: r.component for r in neardup.groups(df).collect()} == want
    more = df.union(spark.createDataFrame([(None, rows[0][1], "n"), (0, rows[0][1], "y"), (0, rows[0][1], "y"), (0, "no near copy of anything else in here", "other"), (None, "nor is this one of any other text", "alone")], df.schema))
    kept = [(r.doc_id, r.component) for r in neardup.drop_near_duplicates(more).collect()]
    assert sorted(kept, key=str) == sorted([(d, "y") for d, c in want.items() if d == c] + [(0, "other"), (None, "alone")], key=str)


def test_text_ids_and_short_texts(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [("b", line), ("a", line + " twelve"), ("c", line.replace("one", "once")), ("d", "other words"), (None, "other  words"), ("e", "some other words")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: r.component for r in neardup.groups(df).collect()}
    assert got == similar_brute_named(rows)
    assert got["b"] == "a" and got[None] == "d"


def similar_brute_named(rows):
    number = {d: i for i, d in enumerate(sorted((d for d, _ in rows if d is not None)))}
    number[None] = 10**6
    back = {i: d for d, i in number.items()}
    return {back[i]: back[c] for i, c in similar_brute([(number[d], t) for d, t in rows]).items()}


def test_links_of_the_given_tables(spark):
    """Rows whose id is divisible by 3 against all rows, by all pairs: what is similar is in one group."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(neardup.shingles(r.text or "").tolist()) for r in rows}
    group = {r.id: r.component for r in neardup.groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(group) == len(rows)
    wanted = found = 0
    for a in (d for d in sets if d % 3 == 0):
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                wanted += 1
                found += group[a] == group[b]
    assert wanted > 20 and found >= 0.99 * wanted


def template_rows(rng):
    """A group of texts that share a passage, each pair below 0.8, and planted copies of 0.8 or more of some of them."""
    words = ["w%d" % i for i in range(5000)]
    shared = [rng.choice(words) for _ in range(170)]
    rows = [(i, shared + [rng.choice(words) for _ in range(34)]) for i in range(300)]
    for i in range(40):
        own = list(rows[i][1])
        for k in range(3):
            own[4 + 50 * k + rng.randrange(40)] = rng.choice(words)
        rows.append((1000 + i, own))
    return [(i, " ".join(own)) for i, own in rows]


def test_copies_among_texts_that_share_a_passage(spark):
    rows = template_rows(random.Random(3))
    want = similar_brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in neardup.groups(df).collect()} == want
    assert sum(d != c for d, c in want.items()) >= 35


def version_rows(rng):
    """Triples: the second text is near the first, the third is similar to the second and too far from the first."""
    words = ["w%d" % i for i in range(5000)]
    rows = []
    for n in range(30):
        first = [rng.choice(words) for _ in range(304)]
        second = list(first)
        for k in (20, 40):
            second[k] = "new%d" % k
        third = list(second)
        for k in range(80, 260, 30):
            third[k] = "other%d" % k
        rows += [(3 * n + k, " ".join(t)) for k, t in enumerate((first, second, third))]
    return rows


def test_a_text_close_to_another_keeps_its_own_links(spark):
    rows = version_rows(random.Random(4))
    want = similar_brute(rows)
    assert want == {d: d - d % 3 for d, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in neardup.groups(df).collect()} == want
