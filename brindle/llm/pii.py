"""Personal data by a character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

A text is a line of character classes in which the inside of a run of letters is left out: where a word begins and ends
is known, its length isn't. Windows of WINDOW classes that overlap by half run through the network; a place's label
scores are the mean of those that its two windows give it, and one Viterbi pass over the whole text decodes them. Windows
that look alike have the same scores, which are kept, so that each distinct window runs through the network once.

Four fixed patterns are searched beside it and their spans always stay; the network adds spans that don't touch them
and that hold up as numbers (digits, parts, check digit).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

KINDS = ("email", "ip", "card", "phone")
NET_KINDS = tuple(f"net_{k}" for k in KINDS)
WINDOW, STEP = 32, 16
HIDDEN = 12
LABELS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
#: Windows whose scores a task keeps (576 bytes each); only speed depends on it.
WINDOWS_KEPT = 50_000
#: Bytes of text that a task works on at a time.
SLICE = 3 << 19
#: What a forbidden transition costs: an inside label must follow its own kind.
NEVER = -1e4

LETTER, DIGIT, SPACE, BREAK, OTHER, PAD = 0, 2, 3, 4, 14, 15
_CLASS = np.full(128, OTHER, np.uint8)
for _chars, _class in (("abcdefghijklmnopqrstuvwxyz", LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", DIGIT), (" \t", SPACE), ("\n\r", BREAK), ("@", 5), (".", 6), ("-", 7), ("+", 8), ("(", 9), (")", 10), ("_%", 11), (",;", 12), ("\"'=:", 13)):
    _CLASS[[ord(c) for c in _chars]] = _class

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and not overlapping, in linear time."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str, has_digit: bool = True) -> list[tuple[str, int, int]]:
    found = _emails(text)
    if not has_digit:
        return found
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        while len(parts) >= 4:
            size = sum(map(len, parts[:4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[:4]):
                found.append(("ip", at, at + size))
            at += size + 1
            parts = parts[4:]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; letters outside ASCII count as small letters."""
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.where(codes >= 0xC0, LETTER, OTHER)).astype(np.uint8)


def reduced(cls: np.ndarray) -> np.ndarray:
    """The places that stay: all but the inside of runs of small letters."""
    inside = np.zeros(len(cls), bool)
    inside[1:-1] = (cls[1:-1] == LETTER) & (cls[:-2] == LETTER) & (cls[2:] == LETTER)
    return np.flatnonzero(~inside)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def allowed() -> np.ndarray:
    """LABELS x LABELS: whether a label may follow another; an inside label follows the begin or inside label of its kind."""
    label = np.arange(LABELS)
    inside = (label > 0) & (label % 2 == 0)
    return ~inside[None, :] | ((label[:, None] + 1) // 2 == (label[None, :] + 1) // 2)


class Tagger:
    """The network: class rows as inputs, an LSTM each way, label scores, and CRF transitions."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"W{side}"] = rng.normal(0, 0.5, (16, 4 * h)).astype(np.float32)
            self.p[f"U{side}"] = rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p[f"W{side}"][:, h : 2 * h] += 1  # the forget gate starts open
        self.p |= {"O": rng.normal(0, 0.3, (2 * h, LABELS)).astype(np.float32), "o": np.zeros(LABELS, np.float32), "T": np.zeros((LABELS, LABELS), np.float32)}
        self.known: dict[bytes, bytes] = {}
        self.p["T"][~allowed()] = NEVER

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Label scores, time x batch x labels, of the class windows x (batch x time)."""
        h, steps, size = HIDDEN, x.shape[1], len(x)
        states = np.zeros((steps, size, 2 * h), np.float32)
        saved = {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            w, u = self.p[f"W{side}"], self.p[f"U{side}"]
            out, cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
            kept = []
            for t in order:
                a = w[x[:, t]] + out @ u
                gates = _sig(a[:, : 3 * h])
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                g = np.tanh(a[:, 3 * h :])
                before, out_before = cell, out
                cell = f * cell + i * g
                squashed = np.tanh(cell)
                out = o * squashed
                states[t, :, slice(0, h) if side == "f" else slice(h, None)] = out
                if keep:
                    kept.append((t, out_before, before, i, f, o, g, squashed))
            saved[side] = kept
        scores = states @ self.p["O"] + self.p["o"]
        return (scores, (x, states, saved)) if keep else scores

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best label sequence of each window (batch x time)."""
        steps, size, _ = scores.shape
        t_scores = self.p["T"]
        best, back = scores[0], np.zeros((steps, size, LABELS), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + t_scores[None]
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + scores[t]
        path = np.zeros((size, steps), np.uint8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(size)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        return path

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels y, and its gradients."""
        scores, (_, states, saved) = self.emissions(x, keep=True)
        steps, size, _ = scores.shape
        trans = self.p["T"]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            top = v.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha = np.zeros_like(scores)
        beta = np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans[None], 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(size)
        gold = sum(scores[t, rows, y[:, t]] for t in range(steps)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, steps))
        d = np.exp(alpha + beta - z[None, :, None])
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - z[:, None, None])
            d_trans += pair.sum(axis=0)
            np.subtract.at(d_trans, (y[:, t - 1], y[:, t]), 1)
        for t in range(steps):
            d[t, rows, y[:, t]] -= 1
        d /= size
        g = {"T": d_trans / size, "o": d.sum(axis=(0, 1)), "O": np.einsum("tbi,tbk->ik", states, d)}
        d_states = d @ self.p["O"].T
        h = HIDDEN
        for side in "fb":
            u, cut = self.p[f"U{side}"], slice(0, h) if side == "f" else slice(h, None)
            d_w, d_u = np.zeros_like(self.p[f"W{side}"]), np.zeros_like(u)
            d_out, d_cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
            for t, out_before, before, i, f, o, gg, squashed in reversed(saved[side]):
                d_out = d_out + d_states[t][:, cut]
                d_cell = d_cell + d_out * o * (1 - squashed * squashed)
                d_a = np.concatenate([d_cell * gg * i * (1 - i), d_cell * before * f * (1 - f), d_out * squashed * o * (1 - o), d_cell * i * (1 - gg * gg)], axis=1)
                np.add.at(d_w, x[:, t], d_a)
                d_u += out_before.T @ d_a
                d_out, d_cell = d_a @ u.T, d_cell * f
            g[f"W{side}"], g[f"U{side}"] = d_w, d_u
        return float((z - gold).mean()), g

    def scores(self, line: np.ndarray) -> np.ndarray:
        """Label scores of each place of a line of classes: the mean of those of the two windows that hold it."""
        n = -(-len(line) // STEP)
        if not n:
            return np.zeros((0, LABELS), np.float32)
        padded = np.full((n + 1) * STEP + STEP, PAD, np.uint8)
        padded[STEP : STEP + len(line)] = line
        windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
        packed = np.ascontiguousarray(windows[:, ::2] << 4 | windows[:, 1::2])
        halves = packed.view(np.uint64)
        with np.errstate(over="ignore"):
            mixed = halves[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (halves[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ halves[:, 1]
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        if bool((halves[first][which] != halves).any()):  # two windows mixed to one number
            _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        keys = [packed[i].tobytes() for i in first]
        if len(self.known) > WINDOWS_KEPT:
            self.known.clear()
        table = np.empty((len(keys), WINDOW, LABELS), np.float16)
        fresh = []
        for k, key in enumerate(keys):
            if (kept := self.known.get(key)) is None:
                fresh.append(k)
            else:
                table[k] = np.frombuffer(kept, np.float16).reshape(WINDOW, LABELS)
        for a in range(0, len(fresh), 2048):
            part = fresh[a : a + 2048]
            table[part] = self.emissions(windows[first[part]]).transpose(1, 0, 2)
        for k in fresh[: WINDOWS_KEPT]:
            self.known[keys[k]] = table[k].tobytes()
        # Window w covers the steps w - 1 and w of the line.
        sums = table[which[1:], :STEP].astype(np.float32) + table[which[:-1], STEP:]
        sums *= np.float32(0.5)  # transitions were learnt beside the scores of one window
        return sums.reshape(-1, LABELS)[: len(line)]

    def _outside(self, scores: np.ndarray, forced: np.ndarray) -> np.ndarray:
        """The places that are outside on every best path, and the forced ones.

        Were such a place in a span, turning the span into outside labels would win: for no kind do the scores of a begin
        label and the inside labels after it, up to the place or beyond, with all that transitions can add, make up for
        those of outside labels.
        """
        t_scores = self.p["T"].astype(np.float64)
        base = scores[:, 0].astype(np.float64)
        sure = np.ones(len(scores), bool)
        for begin in range(1, LABELS, 2):
            inside = begin + 1
            stay = scores[:, inside] - base + (t_scores[inside, inside] - t_scores[0, 0])
            stay[forced] = -1e6
            total = np.cumsum(stay)
            start = scores[:, begin] - base - total
            start[forced] = -1e9
            most = np.maximum.accumulate(start) + np.maximum.accumulate(total[::-1])[::-1]
            before = (t_scores[:, begin] - t_scores[:, 0]).max()
            first = max(0.0, t_scores[begin, inside] - t_scores[inside, inside])
            after = max((t_scores[k, y] - t_scores[0, y]) for k in (begin, inside) for y in (0, *range(1, LABELS, 2)))
            sure &= most + before + first + after < -1e-2
        return sure | forced

    def labels(self, line: np.ndarray) -> np.ndarray:
        """The labels of a line of classes, decoded as a whole; a place of class PAD is outside and parts what lies around it.

        The stretches between places that are surely outside are decoded by themselves, together, which gives the same
        labels as decoding the line from end to end.
        """
        scores = self.scores(line)
        out = np.zeros(len(line), np.uint8)
        if not len(line):
            return out
        t_scores = self.p["T"]
        sure = self._outside(scores, line == PAD)
        edge = np.diff(np.concatenate([[1], sure.astype(np.int8), [1]]))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = end - begin
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # Stretches of about one length, so that little is decoded in vain, and no more than a bounded number of places.
            longest = max(8, int(sizes[order[at]] * 5 // 4))
            to = min(int(np.searchsorted(sizes[order], longest, side="right")), at + max(1, (1 << 19) // longest))
            own = order[at:to]
            at = to
            steps = int(sizes[own].max())
            place = begin[own][:, None] + np.arange(steps)
            inside = np.arange(steps) < sizes[own][:, None]
            block = scores[np.where(inside, place, 0)]
            block[~inside] = NEVER
            block[~inside, 0] = 0
            block[:, 0] += t_scores[0]  # what lies before a stretch is outside, and what comes after it too
            out[place[inside]] = self.viterbi(np.concatenate([block, np.broadcast_to(np.where(np.arange(LABELS) == 0, 0, NEVER), (len(own), 1, LABELS))], axis=1).transpose(1, 0, 2).astype(np.float32))[:, :steps][inside]
        return out

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.p, self.known = state["p"], {}


def example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text and its labelled spans (kind number, start, end)."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(low: int = 1, high: int = 9) -> str:
        return "".join(letters[k] for k in rng.integers(0, 26, rng.integers(low, high)))

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(*options):
        return options[rng.integers(len(options))]

    def email() -> str:
        user = pick(word(2), f"{word(2)}.{digits(2)}", f"{word(2)}_{word(2)}", f"{word(1)}{digits(3)}", f"{word(2)}-{word(2)}.{word(1)}", f"{word(2).title()}.{word(2).title()}")
        return f"{user}@{pick(word(3), word(3) + digits(1), word(2) + '-' + word(2))}{pick('', '.example', '.' + word(2))}.{pick('com', 'org', 'net', word(2, 4))}"

    def ip() -> str:
        return ".".join(str(k) for k in rng.integers(0, 256, 4))

    def card() -> str:
        gap = pick("", "", " ", "-")
        return gap.join(digits(4) for _ in range(4)) if rng.random() < 0.8 else digits(rng.integers(16, 20))

    def phone() -> str:
        return pick(f"+{digits(rng.integers(1, 3))} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"+{digits(rng.integers(9, 13))}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}")

    def number() -> str:
        return pick(digits(rng.integers(1, 8)), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}%", f"{digits(3)},{digits(3)}", f"({digits(2)})", f"@{word(2)}", f"{digits(rng.integers(20, 30))}", "+", f"v{digits(1)}.{digits(1)}", f'{word(3)} = "' + "".join(pick(digits(1), pick(*"abcdef")) for _ in range(30)) + '"')

    parts, spans, at = [], [], 0
    makers = (email, ip, card, phone)
    for _ in range(rng.integers(6, 16)):
        roll = rng.random()
        if roll < 0.22:
            kind = int(rng.integers(4))
            own = makers[kind]()
            spans.append((kind, at, at + len(own)))
        elif roll < 0.36:
            own = number()
        else:
            own = " ".join(word() for _ in range(rng.integers(1, 5)))
            own = own.capitalize() if rng.random() < 0.2 else own
        gap = pick(" ", " ", " ", " ", ", ", ". ", "\n", " | ", "### ", "!! ", ".\n", ": ")
        parts.append(own + gap)
        at += len(own) + len(gap)
    return "".join(parts), spans


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@functools.lru_cache(maxsize=4)
def trained(steps: int = 800, size: int = 96, rate: float = 0.02, seed: int = 3) -> Tagger:
    """A tagger trained on made-up texts with labelled spans, alike for the same arguments."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(2500):
        text, spans = example(rng)
        cls = classes(coded(text))
        label = np.zeros(len(cls), np.uint8)
        for kind, a, b in spans:
            label[a:b] = 2 + 2 * kind
            label[a] = 1 + 2 * kind
        stay = reduced(cls)
        line = np.concatenate([np.full(STEP, PAD, np.uint8), cls[stay], np.full(WINDOW, PAD, np.uint8)])
        gold = np.concatenate([np.zeros(STEP, np.uint8), label[stay], np.zeros(WINDOW, np.uint8)])
        for start in range(int(rng.integers(0, 8)), len(line) - WINDOW, 11):
            xs.append(line[start : start + WINDOW])
            ys.append(gold[start : start + WINDOW])
    x, y = np.stack(xs), np.stack(ys)
    net = Tagger(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for turn in range(1, steps + 1):
        pick = rng.integers(0, len(x), size)
        _, g = net.step(x[pick], y[pick])
        lr = rate * min(1.0, 2 * (1 - turn / (steps + 1)))
        for k, v in g.items():
            m1, m2 = moments[k]
            m1 += 0.1 * (v - m1)
            m2 += 0.01 * (v * v - m2)
            net.p[k] -= (lr * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
        net.p["T"][~allowed()] = NEVER
    return net


def _holds(kind: str, text: str) -> bool:
    """Whether a span that the network found can be of its kind."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", text))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9][0-9().\x20-]*[0-9]", text)) and bool(re.search(r"[^0-9]", text))


def find_spans(net: Tagger, batch: list[str]) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the patterns' and the network's, by kind and start."""
    lengths = np.array([len(t) for t in batch], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    cls = classes(coded("\x00".join(batch)))
    cls[(starts[1:] - 1)] = PAD
    stay = reduced(cls)
    label = net.labels(cls[stay])
    kind = (label.astype(np.int64) + 1) // 2
    begins = (kind > 0) & ((np.concatenate([[0], kind[:-1]]) != kind) | (label % 2 == 1) & (np.concatenate([[0], label[:-1]]) != label))
    first = np.flatnonzero(begins)
    over = np.flatnonzero((kind != np.concatenate([kind[1:], [0]])) | np.concatenate([begins[1:], [True]])) if len(kind) else np.zeros(0, np.int64)
    last = over[np.searchsorted(over, first)] if len(first) else first
    docs = np.searchsorted(starts, stay[first], side="right") - 1
    has_digit = np.zeros(len(batch), bool)
    has_digit[np.unique(np.searchsorted(starts, np.flatnonzero(cls == DIGIT), side="right") - 1)] = True
    found = [base_spans(t, bool(d)) for t, d in zip(batch, has_digit, strict=True)]
    order = {k: i for i, k in enumerate((*KINDS, *NET_KINDS))}
    for d, a, b, k in zip(docs.tolist(), stay[first].tolist(), stay[last].tolist(), kind[first].tolist(), strict=True):
        a, b = a - int(starts[d]), b + 1 - int(starts[d])
        own = batch[d][a:b]
        trimmed = own.strip(" .,;:\n\t-|!\"'") if KINDS[k - 1] != "phone" else own.strip(" .,;:\n\t-|!\"'#")
        a += own.find(trimmed) if trimmed else 0
        b = a + len(trimmed)
        if trimmed and _holds(KINDS[k - 1], trimmed) and not any(x < b and a < y for _, x, y in found[d]):
            found[d].append((NET_KINDS[k - 1], a, b))
    return [sorted(f, key=lambda s: (order[s[0]], s[1])) for f in found]


def scan_pii(docs: DataFrame, net: Tagger | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end>> (code points, end exclusive; by kind, then start) of every row.

    A null or empty text has no spans; null ids stay; repeated rows give equal rows; an empty table gives no rows; other
    columns are left out, whatever their names. Texts may be of any length and hold runs of digits of any length.
    """
    net = net or trained()
    id_type = docs.schema[id_column].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for piece in slices(batches, text_column, SLICE):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in find_spans(net, texts(piece.column(1)).to_pylist())]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, kind)], [id_column, "spans"])

    kept = docs.select(id_column, docs[text_column].cast("string").alias(text_column))
    return kept.mapInArrow(run, f"`{id_column}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, net: Tagger | None = None, text_column: str = "text") -> DataFrame:
    """The rows, all columns, with each span of the text replaced by its kind in angle brackets.

    Null texts stay null and empty ones empty; repeated rows give equal rows; an empty table gives no rows.
    """
    net = net or trained()
    schema = docs.schema
    at = schema.fieldNames().index(text_column)

    def cover(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"<{kind.removeprefix('net_').upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            for piece in slices([batch], batch.schema.names[at], SLICE):
                own = piece.column(at).to_pylist()
                spans = find_spans(net, [t or "" for t in own])
                clean = [t if t is None else cover(t, s) for t, s in zip(own, spans, strict=True)]
                columns = list(piece.columns)
                columns[at] = pa.array(clean, piece.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return docs.mapInArrow(run, schema)
