import random
import zlib

import numpy as np
import pyarrow as pa

from brindle.llm import queries, toxicity


def made_up(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(rng.randint(5, 250))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["zornig", "zornhaft", "zornlos", "pfui"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_gradients():
    net = toxicity.BiGru(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))])
    index = rng.integers(0, 20, (4, 9))
    index[0, 5:] = index[1, :] = 20
    wanted = np.array([1.0, 0, 1, 0])

    def loss():
        p = toxicity._sigmoid(net.run(x, index))
        return -float((wanted * np.log(p) + (1 - wanted) * np.log(1 - p)).sum())

    out, cache = net.run(x, index, keep=True)
    g = net.gradients(cache, toxicity._sigmoid(out) - wanted)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-4
        up = loss()
        value[at] = old - 1e-4
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-3 + 1e-2 * abs(g[name][at]), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 64, 65, 300])
    codes = np.arange(counts.sum())
    index, owner = toxicity.windows(codes, counts, 9999)
    assert set(index[index != 9999].tolist()) == set(codes.tolist()) and set(owner.tolist()) == {0, 1, 2, 3, 4}


def test_held_out_accuracy_and_edges(spark, tmp_path):
    rows = made_up(random.Random(1), 700)
    extra = [(9001, None, 0), (9002, "", 0), (9003, rows[0][1], 0), (9003, rows[0][1], 0), (None, "pfui zornig zornlos", 1), (9004, "word " * 30_000 + "pfui zornig pfui", 1)]
    spark.createDataFrame([(d, t, "x") for d, t, _ in rows + extra], "doc_id long, text string, toxic string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (9001, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[9004].predicted == 1 and by[9001].score == by[9002].score and 0 <= by[9001].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_one_class_and_nothing(spark):
    assert toxicity.train(pa.array(["a b", "c"]), np.array([0, 0])).scores(pa.array(["a", None])).max() < 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def plain_score(net, text):
    """The score of a text by loops over its words, windows and units, with hashes of whole numbers."""
    import math
    import re

    mask = (1 << 64) - 1

    def bucket(n, of):
        mixed = (n ^ n >> 29) * 0xBF58476D1CE4E5B9 & mask
        return (mixed >> 32) % of

    def word_input(word):
        raw = [1, *word.encode(), 1]
        h = 0
        for k, c in enumerate(raw):
            h = (h + (c + 11) * pow(0x100000001B3, k + 1, 1 << 64)) & mask
        own = list(net.word[bucket(h, toxicity.WORD_BUCKETS)])
        for size, table in zip(toxicity.GRAM_SIZES, net.grams):
            values = []
            for at in range(max(len(raw) - size, 0) + 1):
                h = 0
                for c in (raw[at : at + size] + [None] * size)[:size]:
                    h = (h * 0x100000001B3 + (c if c is not None else 0)) & mask
                values.append(table[bucket(h, toxicity.GRAM_BUCKETS)])
            own += [max(values), sum(values) / len(values)]
        return [float(v) for v in own]

    words = [w for w in (re.sub(r"[\W\d_]+", "", x.lower()) for x in re.split(r"[ \t\n\r\f\v]+", text)) if w]
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    best = -math.inf
    n = 1 + max(0, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE))
    for w in range(n):
        xs = [word_input(x) for x in words[w * toxicity.STRIDE : w * toxicity.STRIDE + toxicity.WINDOW]]
        sides = {}
        for side in "fb":
            state, states = [0.0] * toxicity.HIDDEN, []
            for x in xs if side == "f" else xs[::-1]:
                a = [sum(x[i] * p[f"W{side}"][i, j] for i in range(len(x))) + p[f"c{side}"][j] for j in range(3 * toxicity.HIDDEN)]
                g = [sum(state[i] * p[f"U{side}"][i, j] for i in range(toxicity.HIDDEN)) for j in range(3 * toxicity.HIDDEN)]
                h = toxicity.HIDDEN
                z, r = [sig(a[j] + g[j]) for j in range(h)], [sig(a[h + j] + g[h + j]) for j in range(h)]
                new = [math.tanh(a[2 * h + j] + r[j] * g[2 * h + j]) for j in range(h)]
                state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
                states.append(state)
            sides[side] = states if side == "f" else states[::-1]
        both = [f + b for f, b in zip(sides["f"], sides["b"])]
        weights = [math.exp(sum(math.tanh(sum(s[i] * p["A"][i, k] for i in range(len(s)))) * p["v"][k] for k in range(toxicity.ATTEND))) for s in both]
        pooled = [sum(w_ * s[i] for w_, s in zip(weights, both)) / sum(weights) for i in range(2 * toxicity.HIDDEN)] if both else [0.0] * (2 * toxicity.HIDDEN)
        best = max(best, sum(x * y for x, y in zip(pooled, p["w"])) + p["o"][0])
    return sig(best)


def test_scores_against_loops():
    rows = made_up(random.Random(4), 250)
    net = toxicity.train(pa.array([t for _, t, _ in rows]), np.array([y for _, _, y in rows]))
    made = [t for _, t, _ in rows[:6]] + ["", "pfui", "Zornig! zorn-los 7 a", "word " * 90 + "pfui zornig", "éà Über größe ab", " . 12 "]
    got = net.scores(pa.array(made))
    for text, score in zip(made, got):
        assert abs(plain_score(net, text) - score) < 2e-3, text[:40]
