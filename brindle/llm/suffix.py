"""Removal of repeated substrings by suffix arrays, built by linear grouping.

A substring of LENGTH bytes that starts in several documents is removed from all but those with the smallest id. Every
such string holds one least hash of its K-grams at the same place, its anchor; so equal strings meet under equal
anchors. Stage by stage, all in one plan without a table in between:

1. anchors are dealt by hash, and those of two texts are marked;
2. marks go back to their texts, and around marked anchors the regions that their strings cover are cut out;
3. the different regions of a slice of texts go to the buckets of their anchors. There, strings of one anchor that have
   the bytes next to it in common are put into suffix arrays, whose neighbours are the equal strings;
4. the verdicts go back to the slices that sent the regions, which know where in its texts each region occurs.

Matches never cross documents, since regions don't. A bucket holds about BUCKET bytes whatever the size of the corpus;
an anchor that very many texts share comes once from each slice of SLICE bytes, never once from each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import give_back, slices, texts

LENGTH, K = 50, 20
WINDOW = LENGTH - K + 1
#: Bytes that a string of LENGTH bytes has besides its anchor.
REST = LENGTH - K
LAST = (1 << 63) - 1
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20
#: Bytes that one bucket should hold; buckets are as many as the corpus asks for, 2^MOST_BITS at most.
BUCKET = 8 << 20
MOST_BITS = 24
#: Lines of a group that goes into a suffix array as it is; of larger ones the starts are split first.
GROUP = 512
#: Symbols of the groups that share a suffix array.
SYMBOLS = 1 << 15
MIX = 0x9E3779B97F4A7C15
_P = 0x100000001B3
_INV = pow(_P, -1, 1 << 64)
_P2 = 0x9E3779B97F4A7C15
_INV2 = pow(_P2, -1, 1 << 64)

# The suffix array


def suffix_array(s: list[int]) -> list[int]:
    """The suffixes of s in order. Linear: no suffix is renamed or sorted again by what follows it.

    First, suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order; a suffix's
    previous-smaller pointer names the nearest suffix before it in a lower group, and the suffixes that the pointers of
    a group name, as often as they are named, form new groups right above the ones that they were in: their prefixes
    grow by the group's prefix. Then the array is filled from the front: the suffix before each placed one goes to the
    next place of its group, and after it those along its pointers.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    text = [c + 1 for c in s]
    text.append(0)  # below all, so that every other suffix has a smaller one after it
    n += 1
    # Groups form a list from low to high; a group's old members are dropped when its turn comes.
    names = {c: g for g, c in enumerate(sorted(set(text)))}
    group = [names[c] for c in text]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = [g - 1 for g in range(len(members))]
    above = [g + 1 for g in range(len(members))]
    passed = [False] * (n + 1)  # of groups whose turn has come; the last place answers for -1, before all suffixes
    before = [-1] * n
    falling: list[int] = []

    def rise(old: int, own: list[int], beneath: int) -> int:
        """Moves suffixes of group `old` to a new group right above `beneath`."""
        new = len(members)
        over = above[beneath]
        members.append(own)
        size.append(len(own))
        size[old] -= len(own)
        below.append(beneath)
        above.append(over)
        above[beneath] = new
        if over < new:
            below[over] = new
        for p in own:
            group[p] = new
        return new

    g = len(members) - 1
    while g >= 0:
        if size[g] == 1:
            falling.append(g)
            i = members[g][0]
            if group[i] != g:
                i = next(i for i in members[g] if group[i] == g)
            passed[i] = True
            p = i - 1
            while passed[p]:
                p = before[p]
            before[i] = p
            if p >= 0 and size[group[p]] > 1:  # alone in its group it need not move
                rise(group[p], [p], group[p])
        elif size[g]:
            falling.append(g)
            own = [i for i in members[g] if group[i] == g]
            own.sort()
            for i in own:
                passed[i] = True
            named: dict[int, int] = {}
            for i in own:
                p = i - 1
                while passed[p]:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    named[p] = named.get(p, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in named.items():
                moved.setdefault((group[p], times), []).append(p)
            beneath: dict[int, int] = {}
            for key in sorted(moved) if len(moved) > 1 else moved:
                old = key[0]
                if size[old] > len(moved[key]) or old in beneath:
                    beneath[old] = rise(old, moved[key], beneath.get(old, old))
        g = below[g]
    start = [0] * len(members)
    at = 0
    for g in reversed(falling):
        start[g] = at
        at += size[g]
    array = [0] * n
    array[0] = n - 1
    placed = [False] * n + [True]
    placed[n - 1] = True
    for i in range(n):
        j = array[i] - 1
        while not placed[j]:
            g = group[j]
            array[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = before[j]
    return array[1:]


# Anchors


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    best, size = h, 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    return best


def _spans(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): windows first..last have their least hash at the place, the first one of equals."""
    least = _least(h, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(first):
        place = first + (h[first[:, None] + np.arange(width)] == least[first][:, None]).argmax(axis=1)
        found.append((place, first, np.minimum(last, place)))
        more = last > place  # an equal hash further on takes over
        first, last = place[more] + 1, last[more]
    place, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(first, kind="stable")
    return place[order], first[order], last[order]


_power_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 .. modulo 2^64, n of them; kept from slice to slice."""
    if len(_power_tables.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _power_tables[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]))
    return _power_tables[base][:n]


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    """Sums of (byte + 1) x base^place before each place, modulo 2^64."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(MIX)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of each anchor of texts that lie in data one after the other.

    first and last are the strings of LENGTH bytes, by their starts, whose anchor it is; none crosses a text's end.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        sums = _prefix(data, _P)
        h = _mixed((sums[K:] - sums[:-K]) * _powers(_INV, len(data) - K + 1))
    del sums
    place, first, last = _spans(h, WINDOW)
    # A window may cross the end of a text: each stretch is cut at the ends, and only strings within one text stay.
    text = np.searchsorted(ends, place, side="right")
    begin = np.concatenate([[0], ends])[text]
    first, last = np.maximum(first, begin), np.minimum(last, ends[text] - LENGTH)
    good = first <= last
    place = place[good]
    with np.errstate(over="ignore"):
        key = h[place] * np.uint64(MIX)  # least hashes are small numbers; these are spread evenly
    return key, place, first[good], last[good]


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join(raw), np.uint8), ends, ends - lengths


def _planes(values: np.ndarray) -> bytes:
    """The values byte by byte, all first bytes first: what they share compresses."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _runs(keys: np.ndarray) -> list[np.ndarray]:
    """Places of each stretch of equal keys."""
    return np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else []


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


#: What is dealt: rows for a bucket, and rows for later that pass by, with buckets below 0.
BULK = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("at", pa.int64()), *((c, pa.binary()) for c in "abcdef")])
BULK_TYPE = "bucket bigint, slice bigint, at bigint, " + ", ".join(f"{c} binary" for c in "abcdef")


def _bulk(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*r, *(None,) * (len(BULK) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*full, strict=True), BULK, strict=True)], schema=BULK)


def _parts(batches, key: int, held_most: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
    """(key, its rows) of rows sorted by column `key`; a key's rows come in several parts if they exceed held_most bytes."""
    held: list[tuple] = []
    current, size = None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[key] != current or held_most is not None and size > held_most):
                yield current, held
                held, size = [], 0
            current = row[key]
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
    if held:
        yield current, held


def _several(key: np.ndarray, text: np.ndarray, done: np.ndarray) -> np.ndarray:
    """For rows sorted by key and text: whether a key has two texts, or was known to have."""
    start = np.flatnonzero(_fresh(key))
    span = np.diff(start, append=len(key))
    return np.repeat((text[start] != text[start + span - 1]) | np.logical_or.reduceat(done, start), span) if len(key) else np.zeros(0, bool)


# Marks


def _marks(text: np.ndarray, nth: np.ndarray, shards: int) -> list[tuple]:
    """Marked anchors by shard of the text: its keys, how many each has, and which of the text's anchors they are."""
    order = np.lexsort((nth, text, text % np.uint64(shards)))
    text, nth = text[order], nth[order]
    out = []
    for r in _runs(text % np.uint64(shards)):
        own = text[r]
        start = np.flatnonzero(_fresh(own))
        out.append((-1 - int(own[0] % np.uint64(shards)), None, None, own[start].tobytes(), np.diff(start, append=len(own)).astype(np.int32).tobytes(), _planes(nth[r])))
    return out


def _first_pass(bits: int):
    """(id, text, key) to anchors in bulk: the texts' keys, and of each anchor its text, 32 bits of its hash, its number in the text.

    Anchors that have an equal in another text of the slice are marked already, and of these only one is sent on.
    """

    def run(batches):
        for piece in slices(batches, "text", SLICE):
            keys = piece.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            data, ends, _ = _joined([t.encode() for t in texts(piece.column(1)).to_pylist()])
            h, place, _, _ = anchors(data, ends)
            if not len(h):
                continue
            row = np.searchsorted(ends, place, side="right")
            nth = (np.arange(len(h)) - np.searchsorted(row, row)).astype(np.int32)
            order = np.lexsort((keys[row], h))
            h, row, nth = h[order], row[order], nth[order]
            several = _several(h, keys[row], np.zeros(len(h), bool))
            out = _marks(keys[row[several]], nth[several], 1 << max(0, bits - 3))
            sent = np.flatnonzero(_fresh(h) | ~several)
            h, row, nth = h[sent], row[sent], nth[sent]
            for r in _runs(h >> np.uint64(64 - bits)):
                own, which = np.unique(row[r], return_inverse=True)
                short = (h[r] << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
                out.append((int(h[r[0]] >> np.uint64(64 - bits)), None, None, keys[own].tobytes(), _planes(which.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)), _planes(short), _planes(nth[r])))
            yield _bulk(out)

    return run


def _meet(bits: int):
    """Anchors sorted by bucket: marks of those that two texts have. Marks that were made before pass by."""

    def run(batches):
        known, current = None, None
        for bucket, rows in _parts(batches, 0, BUCKET):
            if bucket < 0:
                yield _bulk(rows)
                continue
            if bucket != current:
                known, current = None, bucket
            h, text, nth = [], [], []
            for _, _, _, keys, which, short, places, *_ in rows:
                own = np.frombuffer(keys, np.uint64)
                h.append(_values(short, np.uint32))
                text.append(own[_values(which, np.uint16 if len(own) < 1 << 16 else np.uint32)])
                nth.append(_values(places, np.int32))
            new = sum(map(len, h))
            if known is not None:  # one of each hash so far, which may have two texts already
                h.append(known[0])
                text.append(known[1])
                nth.append(known[2])
            done = np.concatenate([np.zeros(new, bool), known[3]]) if known is not None else np.zeros(new, bool)
            h, text, nth = (np.concatenate(x) for x in (h, text, nth))
            order = np.lexsort((text, h))
            h, text, nth, done = h[order], text[order], nth[order], done[order]
            several = _several(h, text, done)
            told = several & ~done
            if told.any():
                yield _bulk(_marks(text[told], nth[told], 1 << max(0, bits - 3)))
            first = _fresh(h)
            known = h[first], text[first], nth[first], several[first]

    return run


def _gather(batches):
    """Marks sorted by shard: (key, its marked anchors) of each text once."""
    for _, rows in _parts(batches, 0):
        keys = [np.frombuffer(r[3], np.uint64) for r in rows]
        text = np.concatenate([np.repeat(k, np.frombuffer(r[4], np.int32)) for k, r in zip(keys, rows, strict=True)])
        nth = np.concatenate([_values(r[5], np.int32) for r in rows])
        order = np.lexsort((nth, text))
        text, nth = text[order], nth[order]
        parts = _runs(text)
        yield pa.RecordBatch.from_arrays([pa.array(text[[p[0] for p in parts]].view(np.int64)), pa.array([nth[p].tobytes() for p in parts], pa.binary())], ["of", "marks"])


# Regions


def _region_hashes(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) x base^place before each byte of regions that lie one after the other, place counted in the
    region; and the inverse powers, to hash any part of a region."""
    most = int(sizes.max(initial=0)) + 1
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(begin, sizes)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P2, most)[inside], out=sums[1:])
    return sums, _powers(_INV2, most)


def _cut(bits: int):
    """(id, text, key, of, marks) to the regions around marked anchors: the different ones of a slice by bucket, and where in its
    texts each lies, to pass by. Of rows with one key only the first is looked at."""

    def run(batches):
        coder = zstandard.ZstdCompressor(level=3)
        before = None
        for piece in slices(batches, "text", SLICE):
            keys = piece.column(2).to_numpy(zero_copy_only=False)
            again = np.concatenate([keys[:1] == before, keys[1:] == keys[:-1]])
            before = keys[-1]
            if again.any():
                piece = piece.filter(pa.array(~again))
                keys = keys[~again]
            if not len(keys):
                continue
            ids = piece.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            data, ends, begins = _joined([t.encode() for t in texts(piece.column(1)).to_pylist()])
            h, place, first, last = anchors(data, ends)
            if not len(h):
                continue
            row = np.searchsorted(ends, place, side="right")
            at = np.searchsorted(row, np.arange(len(keys)))
            marked = np.zeros(len(h), bool)
            for base, own in zip(at.tolist(), piece.column(4).to_pylist(), strict=True):
                marked[base + np.frombuffer(own, np.int32)] = True
            hit = np.flatnonzero(marked)
            h, row, a, off, size = h[hit], row[hit], first[hit], (place - first)[hit], (last - first)[hit] + LENGTH
            with np.errstate(over="ignore"):
                sums = _prefix(data, _P2)
                r = _mixed((sums[a + size] - sums[a]) * _powers(_INV2, len(data) + 1)[a] + (off * 131 + size).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
                del sums
            order = np.lexsort((ids[row], r, h))
            h, r, row, a, off, size = (x[order] for x in (h, r, row, a, off, size))
            fresh = _fresh(h, r)
            name = xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)
            start = (a - begins[row]).astype(np.int32)
            out = [(-1 - (name & 0xFFFF), name, -1, keys.tobytes(), ids.tobytes(), np.packbits(fresh).tobytes(), _planes(row.astype(np.int32)), _planes(start))]
            h, row, a, off, size = (x[fresh] for x in (h, row, a, off, size))
            for x in _runs(h >> np.uint64(64 - bits)):
                spread = np.repeat(a[x] - (np.cumsum(size[x]) - size[x]), size[x]) + np.arange(int(size[x].sum()))
                out.append((int(h[x[0]] >> np.uint64(64 - bits)), name, int(x[0]), _planes(ids[row[x]]), off[x].astype(np.uint8).tobytes(), size[x].astype(np.uint8).tobytes(), coder.compress(data[spread].tobytes())))
            yield _bulk(out)

    return run


# Verdicts


def least_starts(data: np.ndarray, begin: np.ndarray, off: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, group: int = GROUP, told: dict | None = None) -> np.ndarray:
    """regions x (REST + 1): the least document that has the string starting `a` bytes before the anchor, for each a; LAST where none does.

    key names a region's anchor; regions are alike in it or have another key. Strings that start lo..hi bytes before the
    anchor share with it the lo bytes before and REST - hi bytes after it, so regions that don't are kept apart; what is
    left of them are lines of a few bytes on either side of one symbol. Equal lines are one; groups of several lines are
    put into suffix arrays, and those of more than `group` lines are split into the lower and the upper starts first.
    """
    least = np.full((len(off), REST + 1), LAST, np.int64)
    sums, inverse = _region_hashes(data, size)
    right = size - off - K

    def part(k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hashes of the regions' bytes x..y, counted from the anchor's place."""
        i, j = begin[k] + off[k] + x, begin[k] + off[k] + y
        return _mixed((sums[j] - sums[i]) * inverse[off[k] + x])

    k = np.arange(len(off))
    levels = [(k, 0, REST // 2), (k, REST // 2 + 1, REST)]
    waiting: list[tuple] = []
    symbols = 0
    with np.errstate(over="ignore"):
        while levels:
            k, lo, hi = levels.pop()
            low, high = np.maximum(lo, REST - right[k]), np.minimum(hi, off[k])
            some = low <= high
            k, low, high = k[some], low[some], high[some]
            if not len(k):
                continue
            core = part(k, np.full(len(k), -lo), np.full(len(k), K + REST - hi)) ^ key[k] * np.uint64(_P)
            line = part(k, -high, K + REST - low) ^ (high * 64 + low).astype(np.uint64) * np.uint64(_P2)
            order = np.lexsort((doc[k], line, core))
            k, low, high, core, line = (x[order] for x in (k, low, high, core, line))
            fresh = _fresh(core, line)
            which = np.cumsum(fresh) - 1
            head = np.flatnonzero(fresh)  # of each different line the one with the least document
            first = np.flatnonzero(_fresh(core[head]))
            count = np.diff(first, append=len(head))
            held = np.full((len(head), hi - lo + 1), LAST, np.int64)
            starts = np.arange(lo, hi + 1)
            inside = (starts >= low[head][:, None]) & (starts <= high[head][:, None])
            held[inside] = np.repeat(doc[k[head]], inside.sum(axis=1))
            many = np.repeat(count > group, count)[which]
            if many.any():
                middle = (lo + hi) // 2
                levels += [(k[many], lo, middle), (k[many], middle + 1, hi)]
            few = np.flatnonzero((count > 1) & (count <= group))
            for f in few.tolist():
                own = head[first[f] : first[f] + count[f]]
                waiting.append((held, first[f], k[own], low[own], high[own]))
                symbols += int((high[own] - lo + hi - low[own] + 2).sum())
                if symbols > SYMBOLS:
                    _array(waiting, data, begin, off, doc, lo, hi)
                    waiting, symbols = [], 0
            if waiting:
                _array(waiting, data, begin, off, doc, lo, hi)
                waiting, symbols = [], 0
            if told is not None:  # strings that a suffix array decides
                told["starts"] = told.get("starts", 0) + int(inside[np.repeat((count > 1) & (count <= group), count)].sum())
            kept = ~many
            least[k[kept][:, None], starts[None, :]] = held[which[kept]]
    return least


def _array(waiting: list[tuple], data: np.ndarray, begin: np.ndarray, off: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> None:
    """Puts the lines of the waiting groups into one suffix array; equal strings get their least document.

    A group's shared bytes, its anchor among them, are one symbol of its own, so strings of two groups never are equal.
    """
    width = hi - lo + 1
    k, low, high = (np.concatenate([w[i] for w in waiting]) for i in (2, 3, 4))
    own = np.repeat(np.arange(len(waiting)), [len(w[2]) for w in waiting])
    left, after = high - lo, hi - low
    sizes = left + after + 2
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(k)), sizes)
    inside = np.arange(len(row)) - start[row]
    anchor = begin[k] + off[k]
    place = np.where(inside < left[row], anchor[row] - high[row] + inside, anchor[row] + K + REST - hi + inside - left[row] - 1)
    line = data[np.minimum(place, len(data) - 1)].astype(np.int64)
    line[start + left] = 257 + own
    line[start + sizes - 1] = 256
    # The strings are those that start at or before the symbol and end before the line does.
    is_start = (inside <= left[row]) & (inside + width < sizes[row])
    order = np.array(suffix_array(line.tolist()), np.int64)
    order = order[is_start[order]]
    strings = np.concatenate([line, np.zeros(width, np.int64)])[order[:, None] + np.arange(width)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (strings[1:] != strings[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    low_doc = np.minimum.reduceat(doc[k[row[order]]], first)[np.cumsum(fresh) - 1]
    found = np.full((len(k), width), LAST, np.int64)
    found[row[order], high[row[order]] - inside[order] - lo] = low_doc
    at = 0
    for held, i, members, _, _ in waiting:
        held[i : i + len(members)] = found[at : at + len(members)]
        at += len(members)


def judge(data: np.ndarray, off: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, told: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(region, a, b, least): the strings that start at a..b of a region start in document `least` too, and in none
    with a smaller id. Regions lie in data one after the other; key names their anchors."""
    begin = np.cumsum(size) - size
    sums, inverse = _region_hashes(data, size)
    with np.errstate(over="ignore"):
        whole = _mixed((sums[begin + size] - sums[begin]) * inverse[0] + (off * 131 + size).astype(np.uint64) * np.uint64(_P))
    del sums
    order = np.lexsort((doc, whole, key))
    fresh = _fresh(key[order], whole[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    first = np.flatnonzero(_fresh(key[head]))
    count = np.diff(first, append=len(head))
    several = np.repeat(count > 1, count)
    n_starts = size[head] - LENGTH + 1
    base = np.cumsum(n_starts) - n_starts
    values = np.repeat(doc[head], n_starts)
    if several.any():
        own = np.flatnonzero(several)
        k = head[own]
        sub_begin = np.cumsum(size[k]) - size[k]
        spread = np.repeat(begin[k] - sub_begin, size[k]) + np.arange(int(size[k].sum()))
        least = least_starts(data[spread], sub_begin, off[k], size[k], doc[k], key[k], told=told)
        n = n_starts[own]
        row = np.repeat(np.arange(len(own)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        values[base[own][row] + start] = least[row, off[k][row] - start]
    region = np.repeat(np.arange(len(head)), n_starts)
    begins = np.flatnonzero(_fresh(region, values))
    run_region = region[begins]
    a = begins - base[run_region]
    b = np.append(begins[1:], len(values)) - 1 - base[run_region]
    # Each region, copies too, gets the runs of its head.
    runs = np.bincount(run_region, minlength=len(head))
    at = np.cumsum(runs) - runs
    n = runs[which]
    pick = np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(which)), n), a[pick], b[pick], values[begins][pick]


def _judge_all(batches):
    """Regions sorted by bucket: to each slice that sent some, the runs of starts of each of its regions with the least documents."""
    coder = zstandard.ZstdDecompressor()
    for bucket, rows in _parts(batches, 0):
        if bucket < 0:
            for r in rows:
                yield _bulk([r])
            continue
        counts = np.array([len(r[5]) for r in rows])
        doc = np.concatenate([_values(r[3], np.int64) for r in rows])
        off, size = (np.concatenate([np.frombuffer(r[i], np.uint8) for r in rows]).astype(np.int64) for i in (4, 5))
        data = np.frombuffer(b"".join(coder.decompress(r[6]) for r in rows), np.uint8)
        anchor = np.cumsum(size) - size + off
        grams = np.lib.stride_tricks.sliding_window_view(data, K)
        key = np.zeros(len(off), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(off), 1 << 16):
                words = np.ascontiguousarray(grams[anchor[at : at + (1 << 16)]]).astype(np.uint64) + np.uint64(1)
                key[at : at + (1 << 16)] = _mixed((words * _powers(_P, K)).sum(axis=1, dtype=np.uint64))
        region, a, b, least = judge(data, off, size, doc, key)
        cuts = np.searchsorted(region, np.concatenate([[0], np.cumsum(counts)]))
        out = []
        for r, n, x, y, base in zip(rows, counts.tolist(), cuts, cuts[1:], np.cumsum(counts) - counts, strict=False):
            per = np.bincount(region[x:y] - base, minlength=n).astype(np.uint8)
            out.append((None, r[1], r[2], per.tobytes(), a[x:y].astype(np.uint8).tobytes(), b[x:y].astype(np.uint8).tobytes(), _planes(least[x:y])))
        yield _bulk(out)
    give_back()


RANGES = pa.schema([("of", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _merge(batches):
    """What a slice sent and its verdicts, sorted by slice and place: (key, starts, ends), the maximal runs of each text that has some."""
    for _, rows in _parts(batches, 1):
        sent = rows[0]  # `at` is -1; a slice of the very same rows elsewhere has the same verdicts
        if sent[2] != -1:
            continue
        verdicts, seen = [], -1
        for r in rows:
            if r[2] > seen:
                verdicts.append(r)
                seen = r[2]
        if not verdicts:
            continue
        keys, ids = np.frombuffer(sent[3], np.int64), np.frombuffer(sent[4], np.int64)
        row, start = _values(sent[6], np.int32), _values(sent[7], np.int32).astype(np.int64)
        region = np.cumsum(np.unpackbits(np.frombuffer(sent[5], np.uint8), count=len(row))) - 1
        per = np.concatenate([np.frombuffer(v[3], np.uint8) for v in verdicts]).astype(np.int64)
        a, b = (np.concatenate([np.frombuffer(v[i], np.uint8) for v in verdicts]).astype(np.int64) for i in (4, 5))
        least = np.concatenate([_values(v[6], np.int64) for v in verdicts])
        first = np.cumsum(per) - per
        n = per[region]
        of = np.repeat(np.arange(len(row)), n)
        pick = np.repeat(first[region] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        gone = least[pick] < ids[row[of]]
        of, pick = of[gone], pick[gone]
        if not len(of):
            continue
        text, begin, end = row[of].astype(np.int64), start[of] + a[pick], start[of] + b[pick] + LENGTH
        order = np.lexsort((begin, text))
        text, begin, end = text[order], begin[order], end[order]
        span = int(end.max()) + 1  # texts one after the other, with a gap, so that runs never meet
        begin, end = begin + text * span, np.maximum.accumulate(end + text * span)
        opens = np.concatenate([[True], begin[1:] > end[:-1]])
        closes = np.concatenate([opens[1:], [True]])
        begin, end, text = begin[opens], end[closes], text[opens]
        heads = np.flatnonzero(_fresh(text))
        offsets = pa.array(np.append(heads, len(text)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, pa.array((x - text * span).astype(np.int32))) for x in (begin, end))
        yield pa.RecordBatch.from_arrays([pa.array(keys[text[heads]]), *lists], schema=RANGES)


# The operator


def _bits(rows: DataFrame) -> int:
    """How many bits of a hash name a bucket: so many that a bucket holds about BUCKET bytes."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(7, int(total // BUCKET).bit_length()))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    if not isinstance(docs.schema[id_column].dataType, IntegralType):
        raise TypeError(f"ids are compared as whole numbers; {id_column} is {docs.schema[id_column].dataType.simpleString()}")
    rows = docs.select(F.col(id_column).alias("__id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64(F.coalesce(F.col("__id").cast("bigint"), F.lit(LAST)), "text"))


def repeated_ranges(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keyed: DataFrame | None = None) -> DataFrame:
    """(of, starts, ends): the maximal runs of bytes covered by strings of LENGTH bytes that start in a document with
    a smaller id; a row for each text that has some, once for repeated rows.

    `of` is the xxhash64 of id and text. A null id counts as the largest, a null text as empty; ids of another kind than whole
    numbers are a TypeError. An empty table gives no rows.
    """
    rows = keyed if keyed is not None else _keyed(docs, id_column, text_column)
    bits = _bits(rows)
    dealt = rows.mapInArrow(_first_pass(bits), BULK_TYPE).repartition("bucket").sortWithinPartitions("bucket")
    marks = dealt.mapInArrow(_meet(bits), BULK_TYPE).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "of bigint, marks binary")
    marked = rows.join(marks, F.col("key") == F.col("of")).sortWithinPartitions("key")
    regions = marked.select("__id", "text", "key", "of", "marks").mapInArrow(_cut(bits), BULK_TYPE)
    ruled = regions.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge_all, BULK_TYPE)
    merged = ruled.repartition("slice").sortWithinPartitions("slice", "at").mapInArrow(_merge, "of bigint, starts array<int>, ends array<int>")
    return merged


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, removed array<struct<start, end>> (maximal runs of bytes), kept binary (the other bytes) of every row.

    Strings are judged on the input, not on what is left. Rows with one id never remove each other's strings; repeated
    rows give equal rows. A null id stays null and counts as the largest, a null text as empty; other columns are left
    out, whatever their names. Texts may be of any length: a slice is one long text at most.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    keyed = _keyed(docs, id_column, text_column)
    ranges = repeated_ranges(docs, id_column, text_column, keyed)
    joined = keyed.join(ranges, F.col("key") == F.col("of"), "left").select("__id", "text", "key", "starts", "ends")
    out = pa.schema([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for piece in slices(batches, "text"):
            values = []
            for text, starts, ends in zip(texts(piece.column(1)).to_pylist(), piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True):
                raw = text.encode()
                runs = list(zip(starts or (), ends or (), strict=True))
                kept = [raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True)]
                values.append((len(raw), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*values, strict=True), out, strict=True))], [id_column, *out.names])

    return joined.mapInArrow(run, f"`{id_column}` {id_type}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
