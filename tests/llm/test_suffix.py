import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import queries, suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_the_order_of_suffixes(s):
    assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_on_repetitive_input():
    for s in ([1] * 400, [1, 2] * 200, [2, 1] * 150 + [2], list(b"mississippi") * 20, []):
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    """(n_bytes, removed runs) of each row, by every string of 50 bytes."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        key = 1 << 70 if doc is None else doc
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], key), key)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        key = 1 << 70 if doc is None else doc
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made_up(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(words) + str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 60)))
        if kind < 0.6:
            for p in rng.sample(passages, rng.randint(1, 3)):
                a = rng.randint(0, 30)
                at = rng.randint(0, len(text))
                text = text[:at] + p[a : len(p) - rng.randint(0, 30)] + text[at:]
        elif kind < 0.75 and rows:
            old = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(old))
            text = old[:at] + "X" + old[at:]
        rows.append((rng.randint(0, 2 * n), text))
    return rows


def test_against_every_string(spark, tmp_path):
    rng = random.Random(4)
    rows = made_up(rng, 250)
    rows += [(3, "ab" * 200), (4, "ab" * 200), (5, "a" * 300), (6, "a" * 299), (7, "z" * 49), (8, "z" * 49), (9, None), (None, "ab" * 100), (None, rows[0][1]), rows[1], rows[1], (2, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, removed string").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op8_suffix(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_regions_of_one_anchor_against_every_string():
    """Groups split at every size, so that suffix arrays get few or all of the lines."""
    import numpy as np

    rng = random.Random(9)
    anchor = bytes(range(97, 97 + suffix.K))
    regions = []
    for k in range(120):
        left = bytes(rng.choice(b"xy") for _ in range(rng.randint(0, 4))) + rng.choice([b"lll", b"lmm", b"mmm"]) * rng.randint(3, 9)
        right = rng.choice([b"rr", b"rs"]) * rng.randint(3, 14) + bytes(rng.choice(b"uv") for _ in range(rng.randint(0, 4)))
        left, right = left[-suffix.REST :], right[: suffix.REST]
        if len(left) + suffix.K + len(right) >= suffix.LENGTH:
            regions.append((len(left), rng.randint(0, 60), left + anchor + right))
    least = {}
    for off, doc, raw in regions:
        for at in range(min(off, len(raw) - suffix.LENGTH) + 1):
            own = raw[at : at + suffix.LENGTH]
            least[own] = min(least.get(own, doc), doc)
    data = np.frombuffer(b"".join(r for _, _, r in regions), np.uint8)
    off, doc = (np.array([r[i] for r in regions], np.int64) for i in (0, 1))
    size = np.array([len(r) for _, _, r in regions], np.int64)
    for group in (1, 2, 5, 1000):
        told = {}
        got = suffix.least_starts(data, np.cumsum(size) - size, off, size, doc, np.zeros(len(off), np.uint64), group=group, told=told)
        for k, (o, _, raw) in enumerate(regions):
            for at in range(min(o, len(raw) - suffix.LENGTH) + 1):
                assert got[k, o - at] == least[raw[at : at + suffix.LENGTH]]
        assert (told["starts"] > 0) == (group > 1)


def test_ids_must_be_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError):
        suffix.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    assert suffix.remove_repeats(spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "doc_id smallint, text string")).where("n_bytes > length(kept)").count() == 1
