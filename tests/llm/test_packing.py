import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from brindle.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(places, penalty, window):
    n = len(places)
    cost = [0] + [None] * (n - 1)
    for i in range(1, n):
        options = []
        for j in range(i):
            size = places[i] - places[j]
            if size <= window:
                options.append(cost[j] + (0 if size & (size - 1) == 0 and size >= 256 else window - size) + penalty[i])
        cost[i] = min(options)
    return cost[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(200):
        gaps = [rng.choice([1, 64, 128, 192, 300, 900, 2048]) for _ in range(rng.randint(1, 60))]
        places = np.concatenate([[0], np.cumsum(gaps)])
        penalty = np.array([rng.choice([0, 4, 12]) for _ in places])
        cuts = packing.best_cuts(places, penalty)
        total = 0
        for a, b in zip(cuts, cuts[1:]):
            size = places[b] - places[a]
            assert size <= 2048
            total += (0 if size & (size - 1) == 0 and size >= 256 else 2048 - size) + penalty[b]
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1 and total == brute(places, penalty, 2048)


def test_ids_equal_the_tokenizers():
    texts = ["Hello, world! It's 3.5 kg.\n\nÉa  ñ", "", "  a<|endoftext|>b ", "don't!!! ＡＢ é ΑΣ  x y", "x" * 5000, "A.B. c.. D, e,f, 3. 4.5, g.\u0301 x", "Straße. ÀÉ, naïve. ñ.", "\x1c\x1dq \x0b z"]
    ids, ends, _ = packing.WordTokens(PATH).encode(pa.array(texts))
    start = 0
    for text, end in zip(texts, ends):
        assert ids[start:end].tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
        start = end


def test_pieces(spark):
    rng = random.Random(1)
    words = ["the", "Erinther", "12", "end."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 50, 3000]))), "x") for i in range(60)]
    rows += [(7, "same", "x"), (7, "same", "x"), (None, None, None), (99, "y" * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    pieces = packing.pack(df.repartition(3), PATH).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    tokenizer = Tokenizer.from_file(PATH)
    for doc_id, text, _ in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in by_doc[doc_id] if doc_id != 7 or p.doc_tokens == len(want)), key=lambda p: p.start)
        times = 2 if (doc_id, text) == (7, "same") else 1
        got = [x for p in own[::times] for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert got == want and all(p.doc_tokens == len(want) for p in own)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    used = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        used += at if at & (at - 1) == 0 else 2048
    assert used <= 1.02 * sum(p.length for p in pieces) + 2048 * 3
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    import pytest

    with pytest.raises(ValueError):
        packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_by_the_tokenizer_itself(spark, tmp_path):
    import zlib

    from brindle.llm import queries

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Sea", "12,5", "end.", "éÀ"]) for _ in range(rng.choice([0, 3, 700, 5000]))), i) for i in range(30)] + [(None, None, 1), (50, "", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    seen, sequences = {d: [] for d in ids}, {}
    for r in queries.op5_packing(spark, str(tmp_path)).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(s) == list(range(len(ids[d]))) for d, s in seen.items())
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_a_slice_is_encoded_in_parts_with_the_same_result():
    import tracemalloc

    rng = random.Random(5)
    words = ["river", "Stone", "cloud.", "12.5", "(green)", "quiet,", "over?"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4000))) for _ in range(250)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": range(len(rows)), "text": pa.array(rows)})
    encoder = packing.WordTokens(PATH)
    want = encoder.encode(pc.fill_null(batch.column("text"), ""))
    encoder.encode_slice(batch.slice(0, 3), "text")
    tracemalloc.start()
    got = encoder.encode_slice(batch, "text")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want, strict=True))
    assert most < 7 * batch.column("text").nbytes  # encoding the slice at once takes 12 times its bytes


def test_marks_at_a_words_end_make_no_new_words():
    letters = ["river", "Stone", "É", "naïve", "x9", "don't", "á", "İ", "क़", "ΑΣ", "'s", ""]
    marks = ["", ".", ",", "***", "&&&", ".)", "?!", '"', ":;", "%%", "...$", "|", "-]", "'", ".'", "!́", "<", "·"]
    rows = [f"{w}{m}{after}{w}{m}" for w in letters for m in marks for after in (" ", "\n", "  ", "\t", "\x1c")] + ["", " ", "..", "q."]
    encoder = packing.WordTokens(PATH)
    ids, ends, sentence_ends = encoder.encode(pa.array(rows))
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for row, end in zip(rows, ends, strict=True):
        assert ids[start:end].tolist() == [*tokenizer.encode(row, add_special_tokens=False).ids, 1], row
        start = end
    assert encoder.model is not encoder.tokenizer
    encoder = packing.WordTokens(PATH)
    many = [w + m for w in ("river", "stone", "é") for m in (".", ",", "***", "&&&", ".)", "?!", "%%")]
    ids, ends, sentence_ends = encoder.encode(pa.array([" ".join(many) + " " + "\n".join(many)]))
    assert set(encoder.known) == {"river", "stone", "é", ".", ",", "***", "&&&", ".)", "?!", "%%"}
    assert len(sentence_ends) == 2 * 3 * 3
