"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

The decoder takes any GIF87a or GIF89a. All frames of a batch are decoded together in numpy: within a run of codes
between two clear codes the code widths follow from the codes' places alone, an entry's string lies in the output just
where the code before it was written, and so every output byte is a pointer to an earlier one; doubling the pointers
resolves them all.

The encoder stores bytes as colours of a fixed palette, one canvas of SIDE x SIDE bytes after the other. Its frames use
dictionary codes, three kinds of disposal in turn (kept, put back to what was before, cleared), and a transparent colour
where a canvas shows what lies under it anyway, if there is a colour that the canvas doesn't use.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

SIDE = 24
FRAME = SIDE * SIDE
#: The colour of a byte: three bits of red, three of green, two of blue, at levels that keep them apart.
PALETTE = np.array([(b >> 5 << 5, (b >> 2 & 7) << 5, (b & 3) << 6) for b in range(256)], np.uint8)
#: Disposal of the frames in turn, and which earlier frame's canvas each is drawn over (0: none, the canvas is clear).
DISPOSALS, UNDER = (1, 3, 2, 1), (1, 1, 2, 0)
#: Pixels that a canvas or a frame may have; more is taken for damage.
PIXELS_MOST = 1 << 24


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    disposal: int
    transparent: int
    delay_cs: int
    min_code: int
    data: bytes
    pixels: np.ndarray | None = field(default=None, repr=False)


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray
    frames: list[Frame]
    loops: int


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from `at` joined, and the place after their end mark."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def parse(data: bytes) -> Gif:
    """The blocks of a GIF file; pixels are still compressed. ValueError if it is none, or if it is damaged: a canvas or
    frames of more than PIXELS_MOST pixels, a code size out of range, a block that is cut off."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > PIXELS_MOST:
        raise ValueError("the canvas is too large")
    at = 13

    def table(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 3 * (2 << (flags & 7))
        if at + n > len(data):
            raise ValueError("a palette is cut off")
        return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n

    palette = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        palette, at = table(flags, at)
    frames: list[Frame] = []
    disposal, transparent, delay, loops = 0, -1, 0, 1
    while at < len(data):
        mark = data[at]
        if mark == 0x21:
            if at + 1 >= len(data):
                raise ValueError("a block is cut off")
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else -1
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loops = struct.unpack("<H", body[12:14])[0]
        elif mark == 0x2C:
            if at + 10 > len(data):
                raise ValueError("a block is cut off")
            left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > PIXELS_MOST:
                raise ValueError("a frame is too large")
            at += 10
            colours = palette
            if own & 0x80:
                colours, at = table(own, at)
            if at >= len(data) or not 2 <= data[at] <= 11:
                raise ValueError("no code size")
            min_code = data[at]
            body, at = _blocks(data, at + 1)
            frames.append(Frame(left, top, w, h, colours, bool(own & 0x40), disposal, transparent, delay, min_code, body))
            disposal, transparent, delay = 0, -1, 0
        else:
            break  # the trailer, or rubbish after it
    return Gif(width, height, background, palette, frames, loops)


def lzw_decode(streams: list[bytes], min_codes: list[int], sizes: list[int]) -> list[np.ndarray]:
    """The pixels of every stream, `sizes` of them each; what a damaged stream lacks is 0."""
    out = [np.zeros(n, np.uint8) for n in sizes]
    for min_code in set(min_codes):
        mine = [i for i, m in enumerate(min_codes) if m == min_code]
        ragged = _decode_alike([streams[i] for i in mine], min_code, [sizes[i] for i in mine])
        for i, pixels in zip(mine, ragged, strict=True):
            n = min(len(pixels), sizes[i])
            out[i][:n] = pixels[:n]
    return out


def _widths(min_code: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit widths of n codes after a clear code, and the bits before each; a full dictionary stays at 12 bits."""
    known = (1 << min_code) + 2 + np.maximum(np.arange(n) - 1, 0)  # entries known before code t is read
    width = np.clip(np.ceil(np.log2(known + 1)).astype(np.int64), min_code + 1, 12)
    return width, np.concatenate([[0], np.cumsum(width)])


def _decode_alike(streams: list[bytes], min_code: int, sizes: list[int]) -> list[np.ndarray]:
    clear, end = 1 << min_code, (1 << min_code) + 1
    width, before = _widths(min_code, max(sizes, default=0) + 2)
    longest = len(width)
    bits = np.array([8 * len(s) for s in streams], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    buffer = np.frombuffer(b"".join(streams) + b"\0" * 8, np.uint8)
    bit, got = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    active = np.flatnonzero(bits >= min_code + 1)
    sizes_ = np.array(sizes, np.int64)
    while len(active):
        # The codes of one run, as many as its stream still has bits for and its frame still has pixels for.
        left = bits[active] - bit[active]
        most = np.minimum(np.searchsorted(before, left, side="right") - 1, sizes_[active] - got[active] + 2)
        most = np.minimum(most, longest)
        n = max(int(most.max()), 1)
        at = bit[active][:, None] + before[None, :n] + 8 * starts[active][:, None]
        ok = np.arange(n)[None, :] < most[:, None]
        byte = np.where(ok, at >> 3, 0)
        code = buffer[byte].astype(np.int32) | buffer[byte + 1].astype(np.int32) << 8 | buffer[byte + 2].astype(np.int32) << 16
        code = code >> (at & 7).astype(np.int32) & ((1 << width[:n]) - 1).astype(np.int32)[None, :]
        stop = (code == clear) | (code == end) | ~ok
        stop = np.concatenate([stop, np.ones((len(active), 1), bool)], axis=1)
        used = stop.argmax(axis=1)
        ended = np.where(used < n, np.where(used < most, code[np.arange(len(active)), np.minimum(used, n - 1)], -1), -2)
        for piece, row in zip(_strings(code, used, clear), active, strict=True):
            parts[row].append(piece)
            got[row] += len(piece)
        bit[active] += before[np.minimum(used + 1, longest)]
        active = active[(ended == clear) & (got[active] < sizes_[active])]
    return [np.concatenate(p) if p else np.zeros(0, np.uint8) for p in parts]


def _strings(code: np.ndarray, used: np.ndarray, clear: int) -> list[np.ndarray]:
    """The output of each row's first `used` codes.

    Entry clear+2+j is the string of code j and one byte more, and it lies in the output where code j begins. All rows'
    codes lie in one line, and so do their outputs.
    """
    rows, n = code.shape
    valid = np.arange(n)[None, :] < used[:, None]
    codes = code[valid].astype(np.int64)
    first = np.cumsum(used) - used
    base = np.repeat(first, used)
    place = np.arange(len(codes))
    literal = codes < clear
    entry = np.where(literal, place, codes - clear - 2 + base)  # the code that an entry's string begins with
    if bool((~literal & ((codes < clear + 2) | (entry >= place))).any()):
        raise ValueError("a code that isn't known yet")
    if bool(literal.all()):
        return np.split(codes.astype(np.uint8), first[1:])
    # Lengths: the steps to a literal, by doubling.
    length, jump = np.where(literal, 0, 1), entry
    while True:
        further = jump[jump]
        if bool((further == jump).all()):
            break
        length = length + length[jump]
        jump = further
    length = length + 1
    begin = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(place, length)
    at = np.arange(total)
    source = np.where(literal[owner], at, begin[entry[owner]] + at - begin[owner])
    while True:
        further = source[source]
        if bool((further == source).all()):
            break
        source = further
    values = np.zeros(total, np.uint8)
    values[begin[literal]] = codes[literal]
    out = values[source]
    ends = np.concatenate([begin, [total]])[first[1:]] if rows > 1 else []
    return np.split(out, ends)


def decode(files: list[bytes]) -> list[Gif]:
    """The files with the palette indices of every frame in frame.pixels (height x width), rows in order."""
    gifs = [parse(f) for f in files]
    frames = [f for g in gifs for f in g.frames]
    pixels = lzw_decode([f.data for f in frames], [f.min_code for f in frames], [f.width * f.height for f in frames])
    for f, p in zip(frames, pixels, strict=True):
        image = p.reshape(f.height, f.width)
        if f.interlaced:
            order = [y for first, gap in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, f.height, gap)]
            straight = np.empty_like(image)
            straight[order] = image
            image = straight
        f.pixels = image
    return gifs


def _colours(palette: np.ndarray) -> np.ndarray:
    """The 256 opaque colours of a palette; black beyond its end."""
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette), :3] = palette
    table[:, 3] = 255
    return table


def composed(gif: Gif):
    """(start in hundredths of a second, delay, RGBA canvas) of each frame, by disposal and transparency."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    clock = 0
    tables: dict[int, np.ndarray] = {}
    for f in gif.frames:
        if id(f.palette) not in tables:
            tables[id(f.palette)] = _colours(f.palette)
        saved = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        index = f.pixels[:h, :w]
        if f.transparent < 0:
            area[...] = tables[id(f.palette)][index]
        else:
            np.copyto(area, tables[id(f.palette)][index], where=(index != f.transparent)[..., None])
        yield clock, f.delay_cs, canvas.copy()
        clock += f.delay_cs
        if f.disposal == 2:
            area[...] = 0
        elif saved is not None:
            canvas = saved


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of the opaque pixels by red, green and blue, `bins` levels each; the last cell counts clear pixels."""
    level = canvas[..., :3].astype(np.int64) * bins >> 8
    cell = (level[..., 0] * bins + level[..., 1]) * bins + level[..., 2]
    cell = np.where(canvas[..., 3] > 0, cell, bins**3)
    return np.bincount(cell.ravel(), minlength=bins**3 + 1)


def lzw_encode(rows: np.ndarray) -> list[bytes]:
    """The code stream of each row of bytes (frames x pixels, fewer than 3,800 pixels), all frames a pixel at a time.

    A frame's dictionary is a hash table from a string's code and the byte after it to the longer string's code.
    """
    n, size = rows.shape
    slots = 1 << max(4, int(2 * size - 1).bit_length())
    known = np.full(n * slots, -1, np.int32)  # what is in a slot: code * 256 + byte
    names = np.zeros(n * slots, np.int16)
    codes = np.zeros((n, size + 1), np.int16)
    count = np.zeros(n, np.int64)
    frames = np.arange(n)
    columns = np.ascontiguousarray(rows.T).astype(np.int32)
    string = columns[0].copy()
    for t in range(1, size):
        byte = columns[t]
        wanted = string << 8 | byte
        slot = (wanted * 40503 >> 4 & slots - 1) + frames * slots
        held = known[slot]
        open_ = np.flatnonzero((held != wanted) & (held >= 0))
        while len(open_):  # another string is in the slot: the next one is tried
            s = slot[open_]
            s = np.where((s + 1) % slots == 0, s + 1 - slots, s + 1)
            slot[open_] = s
            held[open_] = h = known[s]
            open_ = open_[(h != wanted[open_]) & (h >= 0)]
        new = held < 0
        fresh = np.flatnonzero(new)
        codes[fresh, count[fresh]] = string[fresh]
        count[fresh] += 1
        known[slot[fresh]] = wanted[fresh]
        names[slot[fresh]] = 257 + count[fresh]
        string = np.where(new, byte, names[slot])
    codes[frames, count] = string
    count += 1
    # A clear code, the codes, and the end mark, at the widths that follow from their places.
    width, _ = _widths(8, size + 2)
    widths = np.concatenate([[9], width])
    line = np.full((n, size + 2), 257, np.int32)
    line[:, 0] = 256
    inside = np.arange(size + 1) < count[:, None]
    line[:, 1:][inside] = codes[inside]
    used = np.arange(size + 2) < count[:, None] + 2
    per_code = np.broadcast_to(widths[: size + 2], used.shape)[used]
    bits = np.add.reduceat(per_code, np.concatenate([[0], np.cumsum(count + 2)[:-1]]))
    flat = np.repeat(line[used], per_code)
    shift = np.arange(len(flat)) - np.repeat(np.cumsum(per_code) - per_code, per_code)
    # Each frame's bits begin at a byte.
    padded = -(-bits // 8) * 8
    start = np.cumsum(padded) - padded
    stream = np.zeros(int(padded.sum()), np.uint8)
    stream[np.arange(len(flat)) + np.repeat(start - (np.cumsum(bits) - bits), bits)] = flat >> shift & 1
    packed = np.packbits(stream, bitorder="little").tobytes()
    return [packed[a : a + b] for a, b in zip((start // 8).tolist(), (padded // 8).tolist(), strict=True)]


def encode(payloads: list[bytes], delay_cs: int = 10) -> list[bytes]:
    """A GIF for each payload (a multiple of FRAME bytes, not empty), one frame for each FRAME bytes.

    All payloads are encoded together; a payload's file depends on nothing but the payload.
    """
    images = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    counts = np.array([len(p) // FRAME for p in payloads], np.int64)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    nth = np.arange(len(images)) - first
    under = np.array(UNDER)[nth % len(UNDER)]
    over = (under > 0) & (nth >= under)
    present = np.zeros((len(images), 256), bool)
    present[np.arange(len(images))[:, None], images] = True
    unused = present.argmin(axis=1)
    see_through = over & ~present[np.arange(len(images)), unused]
    pixels = images.copy()
    rows = np.flatnonzero(see_through)
    same = images[rows] == images[rows - under[rows]]
    pixels[rows] = np.where(same, unused[rows][:, None].astype(np.uint8), pixels[rows])
    streams = lzw_encode(pixels)
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + PALETTE.tobytes()
    place = b"\0\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    delay = struct.pack("<H", delay_cs)
    marks = [[b"\x21\xf9\x04" + bytes([d << 2 | t]) + delay for t in (0, 1)] for d in DISPOSALS]
    out, at = [], 0
    for n in counts.tolist():
        parts = [head]
        for i in range(at, at + n):
            clear, body = bool(see_through[i]), streams[i]
            parts += [marks[(i - at) % len(DISPOSALS)][clear], bytes([unused[i] if clear else 0]), place]
            for a in range(0, len(body), 255):
                piece = body[a : a + 255]
                parts += [bytes([len(piece)]), piece]
            parts.append(b"\0")
        at += n
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def gif_columns(media: DataFrame, id_column: str = "doc_id", gif_column: str = "gif") -> DataFrame:
    """A row a frame of each GIF: id, frame, start_cs, delay_cs, width, height, rgba binary, histogram array<long>.

    A null, empty or damaged file gives one row with a null frame, and so does one whose canvas or a frame has more than
    PIXELS_MOST pixels; a file without frames gives none. Files are decoded one by one, and frames leave as they are
    composed; copies give equal rows, null ids stay, an empty table gives no rows, other columns are left out.
    """
    id_type = media.schema[id_column].dataType.simpleString()

    def rows(batches):
        schema = None

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for piece in slices(batches, gif_column):
            schema = pa.schema([(id_column, piece.schema.field(0).type), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))])
            out, held = [], 0
            for key, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                try:
                    gif = decode([data or b""])[0]
                except ValueError:
                    out.append((key, None, None, None, None, None, None, None))
                    continue
                for i, (t, d, c) in enumerate(composed(gif)):
                    out.append((key, i, t, d, gif.width, gif.height, c.tobytes(), histogram(c).tolist()))
                    held += c.size
                    if held > 16 << 20:
                        yield sent(out)
                        out, held = [], 0
            if out:
                yield sent(out)

    return media.select(id_column, gif_column).mapInArrow(rows, f"`{id_column}` {id_type}, frame int, start_cs bigint, delay_cs int, width int, height int, rgba binary, histogram array<bigint>")


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text stored as a GIF of timed frames, read back through the decoder and composed frame by frame.

    Returns id, n_bytes, gif binary, payload binary (the bytes of the composed canvases' colours), frames int, duration_cs
    bigint, disposals (how many frames of each kind 0..3), see_through (frames with a transparent colour), and histogram
    array<bigint>: counts of the composed canvases' pixels by colour. A null text counts as empty: one frame of 576 bytes
    255. Equal texts give equal columns; null ids stay; an empty table gives no rows; other columns are left out. A text's
    canvases are held at a time, four bytes a byte of text.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def store(batches):
        for piece in slices(batches, text_column, 1 << 20):
            raw = [t.encode() for t in texts(piece.column(1)).to_pylist()]
            files = encode([t + b"\xff" * (-len(t) % FRAME if t else FRAME) for t in raw])
            rows = []
            for t, f, gif in zip(raw, files, decode(files), strict=True):
                shown = np.stack([c for _, _, c in composed(gif)])
                payload = shown[..., 0] | shown[..., 1] >> 3 | shown[..., 2] >> 6
                disposals = np.bincount([x.disposal for x in gif.frames], minlength=4).tolist()
                clear = sum(x.transparent >= 0 for x in gif.frames)
                rows.append((len(t), f, payload.tobytes(), len(gif.frames), sum(x.delay_cs for x in gif.frames), disposals, clear, histogram(shown).tolist()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
            names = ("n_bytes", "gif", "payload", "frames", "duration_cs", "disposals", "see_through", "histogram")
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [id_column, *names])

    kept = docs.select(id_column, docs[text_column].cast("string").alias(text_column))
    return kept.mapInArrow(store, f"`{id_column}` {id_type}, n_bytes bigint, gif binary, payload binary, frames int, duration_cs bigint, disposals array<bigint>, see_through int, histogram array<bigint>")


def payload_digests(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Sizes and checksums of text_media()'s payloads and files, and the frame statistics as one feature string."""
    id_type = media.schema[id_column].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            rows = []
            for n, gif, payload, frames, duration, disposals, clear, counts in zip(*(batch.column(i).to_pylist() for i in range(1, 9)), strict=True):
                feature = f"{frames}x{SIDE}x{SIDE}@{duration}cs;disposal {'/'.join(map(str, disposals))};transparent {clear};colours {'/'.join(map(str, counts))}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [id_column, *names])

    return media.mapInArrow(digest, f"`{id_column}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
