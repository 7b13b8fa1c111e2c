import random
import struct

import numpy as np
import pytest

from brindle.llm import gif


def compress(values, min_code, clear_every=None):
    """A plain LZW coder, for the tests."""
    bits, n_bits, out = 0, 0, bytearray()
    clear, end = 1 << min_code, (1 << min_code) + 1

    def put(code, width):
        nonlocal bits, n_bits
        bits |= code << n_bits
        n_bits += width
        while n_bits >= 8:
            out.append(bits & 255)
            bits >>= 8
            n_bits -= 8

    def fresh():
        return {(i,): i for i in range(clear)}, min_code + 1, end + 1

    table, width, nxt = fresh()
    put(clear, width)
    seen = ()
    for k, v in enumerate(values):
        if seen + (v,) in table:
            seen += (v,)
            continue
        put(table[seen], width)
        if nxt < 4096:
            table[seen + (v,)] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        if clear_every and k % clear_every == 0:
            put(clear, width)
            table, width, nxt = fresh()
        seen = (v,)
    put(table[seen], width)
    if nxt == 1 << width and width < 12:
        width += 1
    put(end, width)
    if n_bits:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("min_code,size,clear_every", [(2, 50, None), (8, 576, None), (8, 20000, None), (4, 3000, 100), (8, 9000, 700)])
def test_lzw_against_a_plain_coder(min_code, size, clear_every):
    rng = random.Random(size)
    values = [rng.choice([0, 0, 0, 1, rng.randrange(1 << min_code)]) for _ in range(size)]
    other = [1] * size
    got = gif.lzw_decode([compress(values, min_code, clear_every), compress(other, min_code)], [min_code] * 2, [size] * 2)
    assert got[0].tolist() == values
    assert got[1].tolist() == other


def make(frames, size=(4, 3), palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for left, top, w, h, disposal, transparent, delay, pixels in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent >= 0)]) + struct.pack("<H", delay) + bytes([max(transparent, 0), 0])
        body = compress(pixels, 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02" + bytes([len(body)]) + body + b"\0"
    return out + b"\x3b"


def test_disposal_transparency_and_time():
    data = make([
        (0, 0, 4, 3, 1, -1, 5, [1] * 12),
        (1, 1, 2, 1, 2, 0, 7, [2, 0]),
        (0, 0, 1, 1, 3, -1, 9, [3]),
        (3, 2, 1, 1, 0, -1, 2, [2]),
    ])
    shots = list(gif.composed(gif.decode([data])[0]))
    assert [(t, d) for t, d, _ in shots] == [(0, 5), (5, 7), (12, 9), (21, 2)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shots[0][2].reshape(-1, 4).tolist() == [red] * 12
    assert shots[1][2][1].tolist() == [red, green, red, red]
    assert shots[2][2][1].tolist() == [red, [0] * 4, [0] * 4, red]
    assert shots[2][2][0, 0].tolist() == blue
    assert shots[3][2][0, 0].tolist() == red and shots[3][2][2, 3].tolist() == green
    assert gif.histogram(shots[2][2])[-1] == 2


def plain_frames(data):
    """(disposal, transparent, RGBA canvas) of each frame of a GIF, by an independent decoder that goes code by code."""

    def unpack(stream, min_code):
        clear, end = 1 << min_code, (1 << min_code) + 1
        bits = int.from_bytes(stream, "little")
        at, width, table, out, before = 0, min_code + 1, {}, [], None
        while at + width <= 8 * len(stream):
            code = bits >> at & (1 << width) - 1
            at += width
            if code == clear:
                table, width, before = {i: bytes([i]) for i in range(clear)}, min_code + 1, None
                nxt = end + 1
                continue
            if code == end:
                break
            own = table[code] if code in table else before + before[:1]
            if before is not None and nxt < 4096:
                table[nxt] = before + own[:1]
                nxt += 1
            before = own
            out.append(own)
            if nxt == 1 << width and width < 12:
                width += 1
        return b"".join(out)

    width, height, flags = struct.unpack("<HHB", data[6:11])
    n = 3 * (2 << (flags & 7))
    palette = [tuple(data[13 + i : 16 + i]) for i in range(0, n, 3)]
    at, shots = 13 + n, []
    canvas = [(0, 0, 0, 0)] * (width * height)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, clear = data[at + 3] >> 2 & 7, data[at + 6] if data[at + 3] & 1 else -1
            at += 8
        left, top, w, h, _, min_code = struct.unpack("<HHHHBB", data[at + 1 : at + 11])
        at += 11
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        saved = list(canvas)
        for i, p in enumerate(unpack(body, min_code)):
            if p != clear:
                canvas[(top + i // w) * width + left + i % w] = (*palette[p], 255)
        shots.append((kind, clear, list(canvas)))
        if kind == 2:
            canvas = [(0, 0, 0, 0)] * (width * height)
        elif kind == 3:
            canvas = saved
    return shots


def payloads():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, 576 * 5, np.uint8).tobytes()
    prose = ("the cat sat on the mat and looked at the moon, " * 90).encode()
    return [noise, prose[: 576 * 7], b"\xff" * 576, b"ab" * 288 * 9, bytes(range(256)) * 9]


def test_encoder_against_an_independent_decoder():
    files = gif.encode(payloads())
    codes = 0
    for data, payload in zip(files, payloads(), strict=True):
        shots = plain_frames(data)
        assert len(shots) == len(payload) // 576
        shown = b"".join(bytes(r | g >> 3 | b >> 6 for r, g, b, _ in c) for _, _, c in shots)
        assert shown == payload and all(p[3] == 255 for _, _, c in shots for p in c)
        assert [k for k, _, _ in shots] == [gif.DISPOSALS[i % 4] for i in range(len(shots))]
        codes += sum(c >= 0 for _, c, _ in shots)
        mine = list(gif.composed(gif.decode([data])[0]))
        assert all(np.array(c, np.uint8).reshape(24, 24, 4).tolist() == m.tolist() for (_, _, c), (_, _, m) in zip(shots, mine, strict=True))
        assert gif.encode([payload]) == [data]  # whatever is encoded beside it
    assert codes > 10 and len(files[3]) < len(files[0]) / 2 * 9 / 5


def test_lzw_encode_is_what_a_plain_coder_writes():
    rng = random.Random(5)
    rows = [[rng.choice([7, 7, 9, rng.randrange(256)]) for _ in range(300)], [1] * 300, [k % 256 for k in range(300)]]
    assert gif.lzw_encode(np.array(rows, np.uint8)) == [compress(r, 8) for r in rows]


def test_damaged_files(spark):
    good = gif.encode([b"x" * 576])[0]
    at = good.index(b"\x2c" + struct.pack("<HHHHB", 0, 0, 24, 24, 0)) + 10
    bad = {
        1: good[:at] + bytes([200]) + good[at + 1 :],  # a code size that isn't one
        2: good[: at - 5] + struct.pack("<HH", 65535, 65535) + good[at - 1 :],  # a frame of 32 GB
        3: b"GIF89a" + struct.pack("<HH", 65535, 65535) + good[10:],
        4: good[: at - 3], 5: good[:14], 6: b"", 7: None, 8: good[:at] + bytes([0]) + good[at + 1 :],
        9: good[: at + 1] + bytes([3, 0, 255, 255, 0, 0x3B]),  # codes that aren't known
        10: good[:781] + b"\x21",
    }
    rows = [(k, None if v is None else bytearray(v), "x") for k, v in bad.items()] + [(None, bytearray(good), "y")]
    got = gif.gif_columns(spark.createDataFrame(rows, "doc_id long, gif binary, frame string")).collect()
    assert sorted(r.doc_id for r in got if r.frame is None) == sorted(bad)
    assert [(r.frame, sum(r.histogram)) for r in got if r.doc_id is None] == [(0, 576)]
    rng = random.Random(8)
    for _ in range(400):  # damage of any kind is a ValueError or some picture
        data = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            list(gif.composed(gif.decode([bytes(data[: rng.randrange(700, len(data) + 1)])])[0]))
        except ValueError:
            pass


def test_query_by_an_independent_decoder(spark, tmp_path):
    import hashlib
    import zlib

    from brindle.llm import queries

    rows = [(1, "abc", 1), (1, "abc", 1), (2, None, 2), (None, "", 3), (3, "the moon and the é sea " * 900, 4), (4, "x" * 576, 5), (5, "".join(map(chr, range(32, 1500))), 6)]
    spark.createDataFrame(rows, "doc_id long, text string, feature int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_bytes): r for r in queries.op9_gif(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for doc, text, _ in rows:
        raw = (text or "").encode()
        r = got[doc, len(raw)]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        data = gif.encode([payload])[0]
        shots = plain_frames(data)
        shown = b"".join(bytes(x | y >> 3 | z >> 6 for x, y, z, _ in c) for _, _, c in shots)
        assert shown == payload
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        counts = [0] * 65
        for _, _, c in shots:
            for x, y, z, _ in c:
                counts[(x >> 6) * 16 + (y >> 6) * 4 + (z >> 6)] += 1
        kinds = [sum(k == i for k, _, _ in shots) for i in range(4)]
        assert r.feature == f"{len(shots)}x24x24@{10 * len(shots)}cs;disposal {'/'.join(map(str, kinds))};transparent {sum(t >= 0 for _, t, _ in shots)};colours {'/'.join(map(str, counts))}"


def test_text_media_edge_cases(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, "y"), (None, "", "z"), (3, "é" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gif string")
    got = {(r.doc_id, r.n_bytes): r for r in gif.text_media(df).collect()}
    assert len(got) == 4
    for key, text in (((1, 3), "abc"), ((2, 0), ""), ((None, 0), ""), ((3, 200_000), "é" * 100_000)):
        raw = text.encode()
        assert got[key].payload == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    frames = gif.gif_columns(gif.text_media(df)).where("doc_id = 1").collect()
    assert len(frames) == 2 and sum(frames[0].histogram) == 576
    assert gif.text_media(df.limit(0)).count() == 0
    assert gif.gif_columns(spark.createDataFrame([(1, b"rubbish"), (2, None)], "doc_id long, gif binary")).where("frame is null").count() == 2
