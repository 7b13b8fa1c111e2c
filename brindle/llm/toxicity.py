"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is a line of words. Each word enters as the embedding of its hash (word input) joined with the pooled embeddings of
its character n-grams of two sizes (character input), so that new words on a known stem are seen. Embeddings are fitted
first and then held: how far a word or an n-gram occurs in more toxic training texts than chance says, in standard
deviations, and how common the word is. Windows of WINDOW words that overlap run through a GRU in both directions, attention
pools a window's states, and a document's score is that of its highest window, so every window counts. Training
knows only documents' labels: in each pass a document stands for its highest window, and each clean one for another
window drawn at random too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

WINDOW, STRIDE = 64, 48
WORD_BUCKETS = GRAM_BUCKETS = 1 << 16
GRAM_SIZES = (4, 7)
FOLDS = 5
INPUTS, HIDDEN, ATTEND = 2 + 2 * len(GRAM_SIZES), 6, 4
#: At most so many labelled rows are learnt from, those of the smallest hashes.
TRAIN_ROWS = 2000
#: Texts whose n-grams are counted at a time.
BLOCK = 100
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20


class Words:
    """The words of a column of texts: codes in reading order, each text's count, and hashes of the distinct ones."""

    def __init__(self, column: pa.Array):
        lists = pc.ascii_split_whitespace(texts(column))
        coded = lists.flatten().dictionary_encode()
        plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", "")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
        keep = (pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0)[codes]
        self.counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        self.codes = codes[keep]
        raw = np.frombuffer(pc.binary_join(pa.array([plain.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py() or b"", np.uint8)
        lengths = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = len(plain)
        self.word, self.grams = _hashes(raw, lengths)


def _hashes(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The bucket of each word, and for each size the buckets of its n-grams with each word's first one.

    A word stands between two marks; one that is shorter than n is one n-gram. Sums wrap at 64 bits.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in GRAM_SIZES]
    padded = lengths + 2
    start = np.cumsum(padded) - padded
    line = np.full(int(padded.sum()) + max(GRAM_SIZES), 1, np.uint64)
    owner = np.repeat(np.arange(n), padded)
    inside = np.arange(len(owner)) - start[owner]
    line[np.flatnonzero((inside > 0) & (inside <= lengths[owner]))] = raw

    def bucket(sums: np.ndarray, buckets: int) -> np.ndarray:
        mixed = (sums ^ sums >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(32)).astype(np.int64) % buckets

    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(padded.max()), 0x100000001B3, np.uint64))
        word = bucket(np.add.reduceat((line[: len(owner)] + np.uint64(11)) * powers[inside], start), WORD_BUCKETS)
        grams = []
        for size in GRAM_SIZES:
            first = np.flatnonzero(inside <= np.maximum(padded - size, 0)[owner])
            sums = np.zeros(len(first), np.uint64)
            left = padded[owner[first]] - inside[first]  # a short word's n-gram ends with the word
            for k in range(size):
                sums = sums * np.uint64(0x100000001B3) + np.where(k < left, line[first + k], np.uint64(0))
            count = np.maximum(padded - size, 0) + 1
            grams.append((bucket(sums, GRAM_BUCKETS), np.cumsum(count) - count))
    return word, grams


def windows(codes: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of every window, windows x WINDOW, with pad after a text's end; the text of each window)."""
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[owner] + nth * STRIDE
    at = first[:, None] + np.arange(WINDOW)
    inside = at < np.cumsum(counts)[owner][:, None]
    return np.where(inside, np.append(codes, pad)[np.where(inside, at, len(codes))], pad), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """The network. Arrays are time x batch x units; a state passes over padding unchanged."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return rng.normal(0, 0.4 / np.sqrt(shape[0] if len(shape) > 1 else 1), shape).astype(np.float32)

        self.word, self.grams = np.zeros((WORD_BUCKETS, 2), np.float32), [np.zeros(GRAM_BUCKETS, np.float32) for _ in GRAM_SIZES]
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p |= {f"W{side}": normal(INPUTS, 3 * HIDDEN), f"U{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(2 * HIDDEN, ATTEND), "v": normal(ATTEND, 1)[:, 0], "w": normal(2 * HIDDEN, 1)[:, 0], "o": np.array([-2.0], np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Word inputs, one row more for padding."""
        columns = [self.word[words.word]]
        for table, (gram, first) in zip(self.grams, words.grams, strict=True):
            z = table[gram]
            n = np.diff(first, append=len(gram))
            columns += [(np.maximum.reduceat(z, first) if len(z) else z)[:, None], (np.add.reduceat(z, first) / n if len(z) else z)[:, None]]
        both = np.concatenate(columns, axis=1).astype(np.float32)
        return np.concatenate([both, np.zeros((1, INPUTS), np.float32)])

    def run(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of the windows in index (windows x WINDOW, codes into x, the last one padding)."""
        p, h = self.p, HIDDEN
        steps, size = index.shape[1], len(index)
        valid = (index != len(x) - 1).T
        states = np.zeros((steps, size, 2 * h), np.float32)
        saved = {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            own = x @ p[f"W{side}"] + p[f"c{side}"]
            state = np.zeros((size, h), np.float32)
            u = p[f"U{side}"]
            kept = []
            for t in order:
                a = own[index[:, t]]
                g = state @ u
                zr = 1 / (1 + np.exp(-(a[:, : 2 * h] + g[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = 2 / (1 + np.exp(-2 * (a[:, 2 * h :] + r * g[:, 2 * h :]))) - 1
                m = valid[t][:, None]
                new = np.where(m, n + z * (state - n), state)
                if keep:
                    kept.append((t, state, z, r, n, g[:, 2 * h :], m))
                state = new
                states[t, :, slice(0, h) if side == "f" else slice(h, None)] = state
            saved[side] = kept
        e = np.tanh(states @ p["A"])
        s = np.where(valid, e @ p["v"], -1e9)
        weight = np.exp(s - s.max(axis=0)) * valid
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[..., None] * states).sum(axis=0)
        logits = pooled @ p["w"] + p["o"][0]
        return (logits, (x, index, states, e, weight, pooled, saved)) if keep else logits

    def gradients(self, cache, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x, index, states, e, weight, pooled, saved = cache
        g = {"w": pooled.T @ d_logit, "o": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["w"]
        d_states = weight[..., None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_s = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", d_s, e)
        d_e = d_s[..., None] * p["v"] * (1 - e * e)
        g["A"] = np.einsum("tbi,tbk->ik", states, d_e)
        d_states = d_states + d_e @ p["A"].T
        for side in "fb":
            u, cut = p[f"U{side}"], slice(0, h) if side == "f" else slice(h, None)
            d_own = np.zeros((len(x), 3 * h), np.float32)
            d_u = np.zeros_like(u)
            d_state = np.zeros((len(index), h), np.float32)
            for t, before, z, r, n, gn, m in reversed(saved[side]):
                d_state = d_state + d_states[t][:, cut]
                d_new = np.where(m, d_state, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (before - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                np.add.at(d_own, index[:, t], d_a)
                d_u += before.T @ d_g
                d_state = np.where(m, d_new * z, d_state) + d_g @ u.T
            g[f"U{side}"], g[f"c{side}"], g[f"W{side}"] = d_u, d_own.sum(axis=0), x.T @ d_own
        return g

    def scores(self, column: pa.Array, batch: int = 4096) -> np.ndarray:
        """The highest window's probability for each text."""
        words = Words(column)
        x = self.inputs(words)
        index, owner = windows(words.codes, words.counts, words.distinct)
        logits = np.concatenate([self.run(x, index[a : a + batch]) for a in range(0, len(index), batch)])
        best = np.full(len(words.counts), -np.inf)
        np.maximum.at(best, owner, logits)
        return _sigmoid(best)


def _compact(x: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs that the windows use, padding last, and the windows over those."""
    used = np.unique(np.append(index, len(x) - 1))
    place = np.zeros(len(x), np.int64)
    place[used] = np.arange(len(used))
    return x[used], place[index]


def _distinct(codes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of a bucket and a text once, in 32 bits."""
    n = int(text_of.max(initial=0)) + 1
    pairs = np.unique(codes.astype(np.int64) * n + text_of)
    return (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)


def _surprise(codes: np.ndarray, text_of: np.ndarray, labels: np.ndarray, buckets: int) -> np.ndarray:
    """(how many standard deviations more toxic texts hold the bucket than chance says, halved and clipped; log of its
    texts), for distinct pairs of a bucket and a text."""
    rate = labels.mean()
    n = np.bincount(codes, minlength=buckets)
    ones = np.bincount(codes, labels[text_of], buckets)
    z = (ones - n * rate) / np.sqrt(n * rate * (1 - rate) + 3)
    return np.stack([np.clip(z / 2, -1, 4), np.log1p(n) / np.log1p(len(labels)) - 0.5], axis=1).astype(np.float32)


def train(column: pa.Array, labels: np.ndarray, passes: int = 8, size: int = 192, least_steps: int = 260, rate: float = 0.03, seed: int = 7) -> BiGru:
    """Fits the network to labelled texts. Without two classes it keeps to the labels' mean."""
    net = BiGru(seed)
    labels = np.asarray(labels, np.float32)
    positive = float(labels.sum())
    if not len(labels) or positive in (0.0, float(len(labels))):
        net.p["w"][:] = 0
        net.p["o"][0] = -6.0 if not positive else 6.0
        return net
    rng = np.random.default_rng(seed)
    words = Words(column)
    text_of = np.repeat(np.arange(len(labels)), words.counts)
    # The pairs of a text and a word, and of a text and an n-gram, a block of texts at a time.
    word_pairs = _distinct(words.codes, text_of)
    parts: list[list] = [[] for _ in words.grams]
    cuts = np.searchsorted(word_pairs[1][by_text := np.argsort(word_pairs[1], kind="stable")], np.arange(0, len(labels) + BLOCK, BLOCK))
    for at, end in zip(cuts, cuts[1:], strict=False):
        code, text = word_pairs[0][by_text[at:end]], word_pairs[1][by_text[at:end]]
        for k, (gram, first) in enumerate(words.grams):
            n = np.diff(first, append=len(gram))[code]
            place = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            parts[k].append(_distinct(gram[place], np.repeat(text, n)))
    grams = [tuple(np.concatenate(c) for c in zip(*p, strict=True)) for p in parts]
    del parts, by_text
    word_pairs = _distinct(words.word[word_pairs[0]], word_pairs[1])

    def embed(known: np.ndarray) -> np.ndarray:
        """Fits the embeddings to the known texts; inputs of all words."""
        ok = known[word_pairs[1]]
        net.word = _surprise(word_pairs[0][ok], word_pairs[1][ok], labels, WORD_BUCKETS)
        net.grams = [_surprise(g[known[t]], t[known[t]], labels, GRAM_BUCKETS)[:, 0] for g, t in grams]
        return net.inputs(words)

    # The network learns from inputs that were fitted without the text at hand, as it will meet new texts.
    fold = rng.permutation(len(labels)) % FOLDS
    index, owner = windows(words.codes, words.counts, words.distinct)
    x = np.concatenate([*(embed(fold != f)[:-1] for f in range(FOLDS)), np.zeros((1, INPUTS), np.float32)])
    index = np.where(index == words.distinct, len(x) - 1, index + fold[owner][:, None] * words.distinct)
    embed(np.ones(len(labels), bool))
    # Deviations grow with the square root of the texts; the network learnt from all folds but one.
    net.word[:, 0] *= np.sqrt(1 - 1 / FOLDS)
    net.grams = [(g * np.sqrt(1 - 1 / FOLDS)).astype(np.float32) for g in net.grams]
    rate_of = positive / len(labels)
    net.p["o"][0] = np.log(rate_of / (1 - rate_of))
    first = np.searchsorted(owner, np.arange(len(labels)))
    count = np.bincount(owner, minlength=len(labels))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    clean = np.flatnonzero(labels == 0)
    passes = max(passes, -(-least_steps * size // (len(labels) + len(clean))))
    step = 0
    for turn in range(passes):
        logits = np.concatenate([net.run(*_compact(x, index[a : a + 2048])) for a in range(0, len(index), 2048)])
        highest = np.lexsort((logits, owner))[first + count - 1]
        drawn = first + (rng.random(len(labels)) * count).astype(np.int64)
        chosen = np.concatenate([highest, drawn[clean]])
        wanted = np.concatenate([labels, np.zeros(len(clean), np.float32)])
        shuffled = rng.permutation(len(chosen))
        for a in range(0, len(shuffled), size):
            step += 1
            pick = shuffled[a : a + size]
            out, cache = net.run(*_compact(x, index[chosen[pick]]), keep=True)
            slope = ((_sigmoid(out) - wanted[pick]) / len(pick)).astype(np.float32)
            for k, g in net.gradients(cache, slope).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (rate * (1 - turn / passes) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """True for rows that are never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> BiGru:
    """A network fitted to at most train_rows labelled documents that aren't held out, chosen by the hash of their ids.

    Rows with a null id or label are not learnt from; a null text counts as empty.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Ids may repeat, so the bound is held here too.
    rows = joined.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(train_rows).select("text", "toxic").toArrow()
    return train(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy())


def score(docs: DataFrame, net: BiGru, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row, by its text alone; null and empty texts get the score of no words.

    Repeated rows get equal scores; null ids stay; an empty table gives no rows; other columns are left out, whatever
    their names. Texts may be of any length: all their windows are scored.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for piece in slices(batches, text_column, SLICE):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(net.scores(piece.column(1)), pa.float64())], [id_column, "score"])

    return docs.select(id_column, docs[text_column].cast("string").alias(text_column)).mapInArrow(run, f"`{id_column}` {id_type}, score double")


def keep_clean(docs: DataFrame, net: BiGru, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows, all columns and as often as they came, whose text scores below the threshold; null texts count as empty."""
    schema = docs.schema
    at = schema.fieldNames().index(text_column)

    def run(batches):
        for batch in batches:
            for piece in slices([batch], batch.schema.names[at], SLICE):
                yield piece.filter(pa.array(net.scores(piece.column(at)) < threshold))

    return docs.mapInArrow(run, schema)
