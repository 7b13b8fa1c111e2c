"""Order-preserving packing by dynamic programming.

The documents of a partition, in its row order, are one line of tokens. Window cuts are chosen among the ends of
documents, the ends of sentences and, where sentences are far apart, places between; a window holds at most 2048
tokens. The cost of a window is its padding (none at a power of two from 256 on) and the penalty of its last cut (none at a
document's end). For a window from cut j to cut i, padding is 2048 - (b[i] - b[j]), so the best j is the one with the
smallest cost[j] + b[j] among those in reach: a queue of rising values gives it in constant time a cut. Lengths that are
powers of two cost less and are looked up besides.
"""

from __future__ import annotations

import itertools
import os
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import parts, slices, texts

WINDOW = 2048
SENTENCE_PENALTY, INNER_PENALTY = 4, 12
#: Where no sentence ends for this many tokens, cuts between are offered so far apart.
GAP, STEP = 96, 48
#: Windows of fewer than 2^8 tokens count as padded even at a power of two: such short sequences are not sought.
SHORTEST_POWER = 8
#: Words kept with their ids from slice to slice and task to task; only speed depends on it.
WORDS_KEPT = 400_000
#: Bytes of text that a slice holds, whose cuts are chosen at once, and that are encoded at a time.
SLICE, PART = 6 << 20, 1 << 20
END_ID = 1
#: Texts on which a tokenizer must keep what WordTokens asks of it, or it is refused.
PROBES = ["The cat, Sat. on THE  mat", "a B c\nDe\tfg, hi.", "Ünï çà ÉÉ word, other.", "Tokenization of unusualwords, Xyzzyplugh.", 'So*** é&& it\'s; (no) "Why?!" 50%% [x]: a,###\nB.$$$ c- d| à!']
#: Marks at a word's end that are cut off as a word of their own. The letter before them is one that stays a single letter when
#: normalized, lest it leave an accent that belongs to the marks.
MARKS = r"""([a-z0-9À-ÖØ-öø-ÿ])([.,!?;:*%&$#)\]"|-]+)(?:\s|$)"""
_tokenizers: dict[str, object] = {}
_encoders: dict[str, WordTokens] = {}


class WordTokens:
    """Ids of whole texts by a tokenizer that never joins what white space separates: each distinct word is encoded once.

    The tokenizer must lower-case and part letters from marks, so that small letters and a space before the MARKS that end a
    word change nothing.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer = _tokenizers[path]
        whole, parts = ([e.ids for e in self.tokenizer.encode_batch(texts_, add_special_tokens=False)] for texts_ in (PROBES, [w for p in PROBES for w in p.split()]))
        joined = iter(parts)
        if any(ids != list(itertools.chain.from_iterable(itertools.islice(joined, len(p.split())))) for ids, p in zip(whole, PROBES, strict=True)):
            raise ValueError(f"{path}: this tokenizer joins what white space separates; its words cannot be encoded one by one")
        if [e.ids for e in self.tokenizer.encode_batch([p.lower().replace(".", " .").replace(",", " ,") for p in PROBES[:-1]] + self.plainer(pa.array(PROBES)).to_pylist()[-1:], add_special_tokens=False)] != whole:
            raise ValueError(f"{path}: this tokenizer does not lower-case, or keeps marks and letters together")
        # The model alone, for words of a to z, in which there is nothing to normalize or to part.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        small = [" ".join(w for w in p.split() if w.isascii() and w.isalpha()).lower() for p in PROBES]
        if [e.ids for e in self.model.encode_batch(small, add_special_tokens=False)] != [e.ids for e in self.tokenizer.encode_batch(small, add_special_tokens=False)]:
            self.model = self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    @staticmethod
    def plainer(column: pa.Array) -> pa.Array:
        """The texts in fewer different words: small letters, MARKS apart."""
        return pc.replace_substring_regex(pc.ascii_lower(column), MARKS, r"\1 \2 ")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.ends, self.flat = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)

    def learn(self, fresh: list[str]) -> None:
        """Encodes the words and keeps them; plain words go as one line, a word for each stretch between spaces."""
        small = [w for w in fresh if w.isascii() and w.isalpha() and w.islower()]
        letters = [w for w in fresh if w.isalpha() and not (w.isascii() and w.islower())]
        plain, other = small + letters, [w for w in fresh if not w.isalpha()]
        flats, lengths = [self.flat], [self.lengths]

        def one_by_one(words: list[str]) -> None:
            for at in range(0, len(words), 2_000):
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + 2_000], add_special_tokens=False)]
                flats.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32))
                lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))

        for tokenizer, part in ((t, words[at : at + 5_000]) for t, words in ((self.model, small), (self.tokenizer, letters)) for at in range(0, len(words), 5_000)):
            line = tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(line.ids, np.uint32)
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == len(part):
                flats.append(ids)
                lengths.append(np.diff(last, prepend=-1))
            else:  # a word that the tokenizer cuts
                one_by_one(part)
        one_by_one(other)
        self.known.update(zip(plain + other, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        marks = np.fromiter((w.rstrip("\"')]*%&$#|")[-1:] in (".", "?", "!") for w in other), bool, len(other))
        self.flat, self.lengths, self.ends = np.concatenate(flats), np.concatenate(lengths), np.concatenate([self.ends, np.zeros(len(plain), bool), marks])

    def encode_slice(self, batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode() of all texts in the column, of which about PART bytes are in work at a time."""
        found, total = [], 0
        for piece in parts(batch, column, PART):
            ids, ends, sentence_ends = self.encode(texts(piece.column(column)))
            found.append((ids, ends + total, sentence_ends + total))
            total += len(ids)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts with END_ID after each, the texts' ends, the sentences' ends) as places in the line."""
        if not pc.any(pc.match_substring(column, "<|")).as_py():  # marks of special ids keep their case
            column = self.plainer(column)
        words = pc.ascii_split_whitespace(column)
        coded = words.flatten().dictionary_encode()
        distinct = _strings(coded.dictionary)
        if len(self.known) > WORDS_KEPT:
            self.forget()
        look = lambda words: np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        own = look(distinct)
        missing = [i for i in np.flatnonzero(own < 0).tolist() if distinct[i]]
        if missing:
            fresh = [distinct[i] for i in missing]
            self.learn(fresh)
            own[missing] = look(fresh)
        # The ids that are kept, then an empty word (-2) and the end mark (-1).
        lengths = np.concatenate([self.lengths, [0, 1]])
        first = np.cumsum(lengths) - lengths
        flat = np.concatenate([self.flat, np.array([END_ID], np.uint32)])
        ends_sentence = np.concatenate([self.ends, [False, False]])
        own[own < 0] = len(lengths) - 2

        counts = np.diff(words.offsets.to_numpy(zero_copy_only=False).astype(np.int64))
        total = int(counts.sum()) + len(counts)
        word = np.empty(total, np.int64)
        marks = np.cumsum(counts + 1) - 1
        is_end = np.zeros(total, bool)
        is_end[marks] = True
        word[marks] = len(lengths) - 1
        word[~is_end] = own[coded.indices.to_numpy(zero_copy_only=False)]

        n = lengths[word]
        after = np.cumsum(n)
        place = np.arange(int(after[-1]) if total else 0) - np.repeat(after - n - first[word], n)
        return flat[place], after[marks], after[ends_sentence[word] & (n > 0)]


def _strings(words: pa.Array) -> list[str]:
    """The words, none with a space in it, as a list; one by one they cost several times as much."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


def _encoder(path: str) -> WordTokens:
    """The encoder of this Python process; a later task finds its words known."""
    if path not in _encoders:
        _encoders[path] = WordTokens(path)
    return _encoders[path]


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rising union of two rising arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places with 0 first, and the penalty of a cut at each."""
    ends = _union(doc_ends, sentence_ends)
    ends = np.concatenate([[0], ends]) if not len(ends) or ends[0] else ends
    extra = np.maximum((np.diff(ends) - 1) // STEP, 0) * (np.diff(ends) > GAP)
    inner = np.repeat(ends[:-1], extra) + STEP * (1 + np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra))
    places = _union(ends, inner)
    penalty = np.full(len(places), INNER_PENALTY, np.int64)
    penalty[np.searchsorted(places, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.searchsorted(places, doc_ends)] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the cuts of least cost from places[0] to places[-1]; no two neighbours in places are further apart than a window."""
    exact: list[list[int]] = [[]] * len(places)
    for k in range(SHORTEST_POWER, window.bit_length() - 1):
        at = np.searchsorted(places, places - (1 << k))
        for i in np.flatnonzero(places[at] == places - (1 << k)).tolist():
            exact[i] = [*exact[i], int(at[i])]
    b, pen = places.tolist(), penalty.tolist()
    n = len(b)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(b[0], 0)])
    for i in range(1, n):
        here = b[i]
        while here - b[queue[0][1]] > window:
            queue.popleft()
        least, j = queue[0]
        least += window - here
        for m in exact[i]:
            if cost[m] < least:
                least, j = cost[m], m
        least += pen[i]
        cost[i], back[i] = least, j
        value = least + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return [0, *cuts[::-1]] if n > 1 else [0]


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a piece: id, start, length, ids, doc_tokens, sequence_id, offset, at_boundary.

    A piece is a stretch of one document's ids (with END_ID at their end; little-endian unsigned 32-bit numbers) in one
    sequence; a document's pieces follow each other, and a sequence's pieces lie gapless in it. Partitions are packed on their own, in slices of whole
    documents, with no shuffle: sequence_id is the partition's number times 2^40 and a running number. Only the last
    window of a slice may be cut short for the slice's sake. A null text counts as empty: one piece, END_ID alone.
    Repeated rows are packed as often as they come; an empty table gives no rows; other columns are left out.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        encoder = _encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        for piece in slices(batches, text_column, SLICE):
            ids, doc_ends, sentence_ends = encoder.encode_slice(piece, text_column)
            places, penalty = candidate_cuts(doc_ends, sentence_ends)
            cuts = places[best_cuts(places, penalty, window)]
            points = _union(cuts, np.concatenate([[0], doc_ends]))
            begin, end = points[:-1], points[1:]
            doc = np.searchsorted(doc_ends, begin, side="right")
            doc_start = np.concatenate([[0], doc_ends[:-1]])
            seq = np.searchsorted(cuts, begin, side="right") - 1
            kept = np.isin(end, sentence_ends) | np.isin(end, doc_ends)
            for part in range(0, len(begin), 1024):
                s = slice(part, part + 1024)
                lo, hi = begin[s], end[s]
                bounds = 4 * np.concatenate([[0], hi - lo[0]]).astype(np.int32)
                values = pa.BinaryArray.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(bounds), pa.py_buffer(ids[lo[0] : hi[-1]].astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(doc[s])), *(pa.array(x, pa.int64()) for x in (lo - doc_start[doc[s]], hi - lo)), values, *(pa.array(x, pa.int64()) for x in ((doc_ends - doc_start)[doc[s]], sequence + seq[s], lo - cuts[seq[s]])), pa.array(kept[s])],
                    [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "at_boundary"],
                )
            sequence += len(cuts) - 1

    kept = docs.select(id_column, docs[text_column].cast("string").alias(text_column))
    return kept.mapInArrow(run, f"`{id_column}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, at_boundary boolean")
