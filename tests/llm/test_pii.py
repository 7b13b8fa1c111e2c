import hashlib
import re

import numpy as np

from brindle.llm import pii, queries


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    "write to the.34@mail7.example.com or a@b or x@@y.z q@r.s.t@u.v +1 (017) 555-7713 now",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 1..2.3.4.5 01.002.0003.4 999.12.3.4.5 10.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1111x 9807915762804490 4111111111111111 4111111111111111",
    "+49 30 1234567 +1     + 12 +1.2 (((5 +12345678901234567 é+44 20 7946 0958é",
    "", "nothing here", "a@" * 30 + "b.c", "1" * 3000, "..." * 500, "0" * 5000 + "1.1.1.1 10.0.0." + "0" * 6000 + "7 " + "9" * 5000 + ".1.1.1",
]


def test_base_spans():
    for text in TEXTS:
        assert sorted(pii.base_spans(text)) == sorted(plain_base(text)), text[:40]
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("01259.@-+ ()ab\n"), 40))
        assert sorted(pii.base_spans(text)) == sorted(plain_base(text)), text


def test_gradients():
    net = pii.Tagger(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 16, (3, 6)).astype(np.uint8), rng.integers(0, pii.LABELS, (3, 6)).astype(np.uint8)
    _, g = net.step(x, y)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up, _ = net.step(x, y)
        value[at] = old - 1e-3
        down, _ = net.step(x, y)
        value[at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3 + 2e-2 * abs(g[name][at]), name


def test_viterbi_is_the_best_path():
    net = pii.Tagger(2)
    rng = np.random.default_rng(1)
    net.p["T"] = rng.normal(size=(pii.LABELS, pii.LABELS)).astype(np.float32)
    scores = rng.normal(size=(3, 2, pii.LABELS)).astype(np.float32)
    import itertools

    for b in range(2):
        value = lambda p: sum(scores[t, b, p[t]] for t in range(3)) + net.p["T"][p[0], p[1]] + net.p["T"][p[1], p[2]]
        best = max(itertools.product(range(pii.LABELS), repeat=3), key=value)
        assert tuple(net.viterbi(scores)[b]) == best


def line_of(text):
    cls = pii.classes(pii.coded(text))
    return cls[pii.reduced(cls)]


def test_whole_texts_are_decoded_at_once():
    """Against sums over plain windows and one Viterbi pass from end to end."""
    net = pii.trained()
    rng = np.random.default_rng(11)
    made = ["".join(pii.example(rng)[0] for _ in range(n)) for n in (1, 3, 20, 60)]
    for text in [*made, "4 5-6 " * 400, "12 34 56 78 " * 300, "+1 (2) 3.4@5-" * 200, "".join(rng.choice(list("019.@-+ ()ab\n"), 6000))]:
        line = line_of(text)
        sums = np.zeros((len(line), pii.LABELS), np.float32)
        for start in range(-pii.STEP, len(line), pii.STEP):
            at = np.arange(start, start + pii.WINDOW)
            inside = (at >= 0) & (at < len(line))
            window = np.where(inside, line[np.where(inside, at, 0)], pii.PAD).astype(np.uint8)
            sums[at[inside]] += net.emissions(window[None])[:, 0].astype(np.float16).astype(np.float32)[inside] / 2
        scores = net.scores(line)
        assert np.abs(scores - sums).max() < 0.05  # halves of numbers near 30, rounded alike but for the order of sums
        trans = net.p["T"].astype(np.float64)
        best, back = scores[0] + trans[0], []
        for row in scores[1:]:
            total = best[:, None] + trans
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        path = [int((best + trans[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        labels = net.labels(line)
        value = lambda p: sum(float(scores[i, k]) for i, k in enumerate(p)) + sum(float(trans[a, b]) for a, b in zip([0, *p], [*p, 0]))
        assert abs(value(path[::-1]) - value(labels.tolist())) < 0.05
        assert pii.allowed()[np.concatenate([[0], labels[:-1]]), labels].all()
    both = np.concatenate([line_of(made[1]), [pii.PAD], line_of(made[2])]).astype(np.uint8)
    assert (net.labels(line_of(made[1])) == net.labels(both)[: len(line_of(made[1]))]).mean() > 0.99


def test_held_out_accuracy():
    net = pii.trained()
    rng = np.random.default_rng(999)
    found = wanted = right = 0
    for _ in range(300):
        text, spans = pii.example(rng)
        cls = pii.classes(pii.coded(text))
        stay = pii.reduced(cls)
        label = net.labels(cls[stay])
        gold = np.zeros(len(cls), np.uint8)
        for kind, a, b in spans:
            gold[a:b] = 2 + 2 * kind
            gold[a] = 1 + 2 * kind
        gold = gold[stay]
        right += int(((label > 0) & ((label + 1) // 2 == (gold + 1) // 2)).sum())
        found += int((label > 0).sum())
        wanted += int((gold > 0).sum())
    assert right / found > 0.95 and right / wanted > 0.95


def test_network_adds_spans():
    text = "call (487) 555-7209 or 487-555-7209, thanks " * 2
    spans = pii.find_spans(pii.trained(), [text, "", "the and of " * 200])
    assert any(k == "net_phone" for k, _, _ in spans[0]) and spans[1] == [] and spans[2] == []


def test_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], "y"), (55, None, None), (56, "word " * 40_000 + TEXTS[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        base = sorted(plain_base(text), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined) and r.n_email == sum(k == "email" for k, _, _ in base)
    clean = {(r.doc_id, r.spans): r.text for r in pii.redact(df).collect()}
    assert "@mail7" not in clean[(0, "x")] and "<EMAIL>" in clean[(0, "x")] and clean[(55, None)] is None
    assert pii.redact(df.limit(0)).count() == 0
