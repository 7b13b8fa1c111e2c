import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.embed import CachedEmbedder, HashEmbedder
from brindle.errors import InvalidRequest
from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import chunking, fusion, knn, lexical, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_metrics(spark):
    v = V.vector
    assert value(spark, V.cosine_distance(v([1, 2]), v([2, 4]))) == pytest.approx(0)
    assert value(spark, V.cosine_distance(v([1, 0]), v([0, 1]))) == 1 == value(spark, V.cosine_distance(v([0, 0]), v([0, 1])))
    assert value(spark, V.l2sq(v([1, 2, 3]), v([4, 0, -1]))) == 29
    assert value(spark, V.neg_dot(v([1, 2]), v([3, 4]))) == -11


def test_quantize(spark):
    for numbers in ([0.5, -1, 0.25, 0, 0.9, -0.33], [0.0, 0.0], [0.1, -2, 0.5]):
        q = value(spark, V.quantize_int8(V.vector(numbers)))
        assert q.scale == pytest.approx(max(map(abs, numbers)) / 127)
        assert all(abs(c * q.scale - x) <= q.scale / 2 + 1e-12 for c, x in zip(q.codes, numbers))
    assert q.codes[1] == -127


def test_knn_and_ivf_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 32)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    for metric in V.METRICS:
        got = {}
        for r in knn.batch_topk(rows, queries, 10, metric).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        d = knn._distances(x[::100].astype(np.float64), x.astype(np.float64), metric)
        for q in range(20):
            assert [v for _, v in sorted(got[q * 100])] == np.lexsort((np.arange(2000), d[q]))[:10].tolist()
    one = knn.topk(rows, x[5].tolist(), 10, tie=("vec_id",)).select("vec_id").collect()
    assert one[0].vec_id == 5
    index = knn.IvfIndex.fit(rows, 16)
    assigned = index.assign(rows).cache()
    assert assigned.count() == 2000
    hit = total = 0
    for q in range(0, 2000, 200):
        want = {r.vec_id for r in knn.topk(rows, x[q].tolist(), 10, tie=("vec_id",)).collect()}
        hit += len(want & {r.vec_id for r in index.search(assigned, x[q].tolist(), 10, probes=12).collect()})
        total += 10
    assert hit / total >= 0.9


def test_empty_inputs(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.batch_topk(rows, rows.withColumnRenamed("vec_id", "query_id"), 3).count() == 0
    assert knn.IvfIndex.fit(rows).assign(rows).count() == 0
    docs = spark.createDataFrame([], "bucket string, external_id string, text string")
    assert lexical.bm25(docs, "x").count() == 0 and stats.bucket_stats(docs.withColumns({"metadata": F.lit("{}"), "parent_doc_id": F.lit("p")})).count() == 0


def test_top_k_bounds():
    for k in (0, -1, 101):
        with pytest.raises(InvalidRequest):
            knn.check_top_k(k)
    assert knn.check_top_k(500, None) == 500


def bm25_plain(docs, query):
    tokens = {d: ["".join(c if c.isalnum() else " " for c in t).lower().split() for t in [t]][0] for d, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    out = {}
    for term in lexical.terms_of(query):
        df = sum(term in t for t in tokens.values())
        for d, t in tokens.items():
            f = t.count(term)
            if f:
                out[d] = out.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    docs = [("1", "cat"), ("2", "cat with many other unrelated filler words here today"), ("3", "dogs are loyal pets"), ("4", ""), ("5", "Cat, CAT; dog_cat")]
    df = spark.createDataFrame([("a" if i != "3" else "b", i, t) for i, t in docs], "bucket string, external_id string, text string")
    got = [(r.external_id, r.score) for r in lexical.bm25(df, "cat Cat dogs!").collect()]
    want = bm25_plain(docs, "cat Cat dogs!")
    assert [d for d, _ in got] == [d for d, _ in want] and all(a[1] == pytest.approx(b[1]) for a, b in zip(got, want))
    assert [r.external_id for r in lexical.bm25(df, "dogs", bucket="b").collect()] == ["3"] and lexical.bm25(df, "dogs", bucket="a").count() == 0
    assert lexical.bm25(df, "...").count() == 0
    assert {(r.external_id, r.term, r.tf) for r in lexical.postings(df, ("external_id",)).collect()} >= {("1", "cat", 1), ("5", "cat", 3)}


def test_min_max(spark):
    norm = lambda xs: [r.v for r in fusion.min_max(spark.createDataFrame([(float(x),) for x in xs], "s double"), "s", "v").orderBy("s").collect()]
    assert norm([]) == [] and norm([5]) == [1] and norm([3, 3, 3]) == [1, 1, 1] and norm([0, 5, 10]) == [0, 0.5, 1]


def test_fuse_merge_and_rerank(spark):
    hits = lambda rows: spark.createDataFrame([("b", i, i, s) for i, s in rows], "bucket string, external_id string, text string, score double")
    out = fusion.fuse(hits([("x", 0.0), ("y", 1.0)]), hits([("y", 3.0), ("z", 1.0)]), 10, (0.4, 0.6)).collect()
    assert [(r.external_id, round(r.score, 6)) for r in out] == [("y", 0.6), ("x", 0.4), ("z", 0.0)]
    low = fusion.merge_variants([hits([("x", 0.3), ("y", 0.2)]), hits([("x", 0.1)])], False).collect()
    assert [(r.external_id, r.score) for r in low] == [("x", 0.1), ("y", 0.2)]
    same = fusion.rerank(hits([("x", 0.3), ("y", 0.2), ("z", 0.9)]), "q", 2).collect()
    assert [(r.external_id, r.score) for r in same] == [("y", 3.0), ("x", 2.0)]
    other = fusion.rerank(hits([("x", 0.3), ("y", 0.2), ("z", 0.9)]), "q", 2, lambda q, texts: [1.0 if t == "z" else 0.5 for t in texts]).collect()
    assert [(r.external_id, r.score) for r in other] == [("z", 1.0), ("y", 0.5)]


def test_expand():
    assert fusion.expand_query("set up VPN?") == ["set up VPN?", "set up virtual private network", "set up remote access"]
    assert fusion.expand_query("nothing") == ["nothing"] and len(fusion.expand_query("vpn tls vpn tls vpn dns db k8s")) == 8


def test_text_functions(spark):
    t = lambda f, *a: value(spark, f(*(F.lit(x) for x in a)))
    assert t(T.strip_html, "<p>a<b>é</b>&amp;</p><SCRIPT x>if (1<2)</script ><style>p{}</style>\n c") == "a é &amp; c"
    assert [t(T.doc_type_for, p) for p in ("/x/a.MD", "b.htm", "c.rs", "d.jsonl", "e.txt", "f", "/g.d/h")] == ["markdown", "html", "code", "structured", "text", "text", "text"]
    assert [t(T.doc_id_for, p) for p in ("/x/a.b.md", "b", ".hidden")] == ["a.b", "b", ".hidden"]
    assert value(spark, T.summarize(F.lit("a  b\nc"))) == "a b c"
    long = value(spark, T.summarize(F.lit("word " * 100)))
    assert long.endswith("word…") and len(long) <= 281 and value(spark, T.summarize(F.lit("x" * 300))) == "x" * 280 + "…"
    assert value(spark, T.keywords(F.lit("kubernetes kubernetes cluster the the the and pod"), 8)) == ["kubernetes", "cluster", "pod"]
    a = [value(spark, T.attribution(F.lit(x))) for x in ("doc#3", "a#b#07", "plain", "x#y")]
    assert [(x.doc, x.chunk) for x in a] == [("doc", 3), ("a#b", 7), ("plain", None), ("x", None)]
    assert T.version_lt("1.2.3", "1.3.0-rc1") and not T.version_lt("1.2", "1.3.0") and not T.version_lt("2.0.0", "1.9.9")


def test_chunk_fixtures():
    code = "use std::io;\n\nfn alpha() {\n    fn inner() {}\n}\n\nfn beta() {}\n"
    assert [t for _, t in chunking.code_parts(code, 500, 50)] == ["use std::io;\n\n", "fn alpha() {\n    fn inner() {}\n}\n\n", "fn beta() {}\n"]
    md = "intro\n# One\ntext\n  ## Two\nmore\n#no heading\n\n"
    assert [t for _, t in chunking.heading_parts(md, 500, 50)] == ["intro\n", "# One\ntext\n", "  ## Two\nmore\n#no heading\n\n"]
    assert chunking.sentence_parts("Aa. Bb. Cc.", 8, 2) == [(0, "Aa. Bb."), (5, "b. Cc.")] and chunking.sentence_parts("", 8, 2) == []
    with pytest.raises(InvalidRequest):
        chunking.check_sizes(10, 10)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n#é", max_size=120), st.integers(3, 30), st.integers(0, 10), st.sampled_from(sorted(chunking.STRATEGIES)))
def test_chunk_properties(text, size, overlap, how):
    overlap = min(overlap, size - 1)
    parts = chunking.STRATEGIES[how](text, size, overlap)
    assert all(0 < len(t) <= size and text[s : s + len(t)] == t for s, t in parts)
    if how in ("fixed", "sentence"):
        covered = set()
        for s, t in parts:
            covered |= set(range(s, s + len(t)))
        assert covered == set(range(len(text)))


def test_fixed_in_sql_equals_plain(spark):
    rng = random.Random(1)
    texts = ["é" * rng.randint(0, 90) for _ in range(60)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((10, 3), (30, 0), (7, 6)):
        for row in df.select("t", chunking.fixed_chunks(F.col("t"), size, overlap).alias("c")).collect():
            assert [(c.char_start, c.text) for c in row.c] == chunking.fixed_parts(row.t or "", size, overlap)


def test_hash_embedder():
    e = HashEmbedder(16)
    v = e.embed(["a", "b", "a", ""])
    assert v.shape == (4, 16) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5) and (v[0] == v[2]).all() and not (v[0] == v[1]).all()
    c = CachedEmbedder(e, 2)
    assert (c.embed(["a", "b", "a", ""]) == v).all() and c.evictions == 1 and (c.embed(["b"])[0] == v[1]).all() and c.hits == 1


def test_hash_embedding_query_rounds_as_its_sql(spark, tmp_path):
    import duckdb

    from brindle.queries import ORACLES, QUERIES

    path = str(tmp_path / "benchmark.parquet")  # numbers near a half, which single precision rounds the other way
    spark.createDataFrame([(i, f"text {n}") for i, n in enumerate((18, 313, 455, 578, 722, 1053))] + [(6, "")], "item_id bigint, text string").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view benchmark as from read_parquet('{path}/*.parquet')")
    want = db.execute(ORACLES["sca_19_hash_embedding"]).fetchall()
    assert sorted(map(tuple, QUERIES["sca_19_hash_embedding"](spark, str(tmp_path)).collect())) == sorted(want)
    assert HashEmbedder(8).embed(["a"]).dtype == np.float32  # the engine's vectors stay single


def test_stats(spark):
    rows = [("a", "1", None, '{"x": 1, "y": 2}'), ("a", "d#0", "d", '{"x": 1}'), ("a", "d#1", "d", None), ("b", "1", None, "{}")]
    df = spark.createDataFrame(rows, "bucket string, external_id string, parent_doc_id string, metadata string")
    got = {r.bucket: r for r in stats.bucket_stats(df, 1).collect()}
    assert (got["a"].docs, got["a"].parent_docs, [(k.key, k["count"]) for k in got["a"]["keys"]]) == (3, 1, [("x", 2)]) and got["b"]["keys"] == []
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, row_id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (2, 99), (2, 98)], "query_id int, row_id int")
    assert tuple(stats.retrieval_quality(ranked, relevant).first()) == (2, 0.5, 0.25)


def test_word_index_against_a_scan(spark, tmp_path):
    import random

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [("ab"[i % 2], str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    schema = "bucket string, external_id string, text string"
    index = lexical.WordIndex(spark, str(tmp_path / "words"), parts=4)
    index.add(spark.createDataFrame(rows[:80], schema))
    index.add(spark.createDataFrame(rows[80:], schema))
    changed = [(b, k, "alpha alpha only") for b, k, _ in rows[10:20]]
    index.add(spark.createDataFrame(changed, schema))
    index.remove(spark.createDataFrame([(b, k) for b, k, _ in rows[15:30]] + [("a", "unknown")], "bucket string, external_id string"))
    index.add(spark.createDataFrame([("a", "28", "back again with zeta"), ("b", "none", None)], schema))
    live = {(b, k): t for b, k, t in [*rows, *changed]}
    for b, k, _ in rows[15:30]:
        live.pop((b, k))
    live["a", "28"], live["b", "none"] = "back again with zeta", ""
    docs = spark.createDataFrame([(b, k, t) for (b, k), t in live.items()], schema)
    for at in (index, index.compact(str(tmp_path / "one"))):
        assert at.counts() == (len(live), sum(len(t.split()) for t in live.values()))
        for query, bucket in (("alpha zeta", None), ("Delta, beta!", "b"), ("nowhere", None), ("", None)):
            want = [(r.bucket, r.external_id, round(r.score, 9)) for r in lexical.bm25(docs, query, 15, bucket=bucket).collect()]
            got = [(r.bucket, r.external_id, round(r.score, 9)) for r in at.search(query, 15, None if bucket is None else F.col("bucket") == bucket).collect()]
            assert got == want
    plan = index.compact(str(tmp_path / "two")).search("alpha", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(term,alpha)" in plan


def test_engine_with_indexes_and_stored_cells(spark, tmp_path):
    import numpy as np

    from brindle.embed import HashEmbedder
    from brindle.engine import Engine

    texts = [f"text number {i} about {'vpn' if i % 3 else 'dns'}" for i in range(300)]
    vectors = HashEmbedder(16).embed(texts)
    rows = [("ab"[i % 2], str(i), t, "{}", None, None, v.tolist()) for i, (t, v) in enumerate(zip(texts, vectors))]
    corpus = spark.createDataFrame(rows, "bucket string, external_id string, text string, metadata string, parent_doc_id string, chunk_index int, embedding array<float>")
    index = knn.IvfIndex.fit(corpus, 8, row_id="external_id")
    words = lexical.WordIndex(spark, str(tmp_path / "words"), parts=4)
    words.add(corpus)
    plain = Engine(corpus, dim=16)
    for quantized in (False, True):
        index.store(corpus, str(tmp_path / f"cells-{quantized}"), quantized)
        e = Engine(corpus, dim=16, words=words, near=str(tmp_path / f"cells-{quantized}"), probes=8)
        near = [(r.bucket, r.id) for r in e.vector_search(vectors[7].tolist(), 5).collect()]
        want = [(r.bucket, r.id) for r in plain.vector_search(vectors[7].tolist(), 5).collect()]
        assert near[0] == want[0] and (quantized or near == want)
        assert [r.id for r in e.bm25("dns 42", 5, "a").collect()] == [r.id for r in plain.bm25("dns 42", 5, "a").collect()]
        if not quantized:
            assert [r.id for r in e.search("vpn 42", 5, hybrid=True).collect()] == [r.id for r in plain.search("vpn 42", 5, hybrid=True).collect()]
    some = Engine(corpus, dim=16, near=str(tmp_path / "cells-False"), probes=1).vector_search(vectors[7].tolist(), 3)
    assert some.count() == 3 and "PartitionFilters: [isnotnull(cell" in some._jdf.queryExecution().toString()
    assert np.isclose(plain.vector_search(vectors[7].tolist(), 1).first().score, 0.0)


def test_distances_to_a_constant(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), (None,), ([1.0],), ([1.0, None],), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    for metric, want in (("cosine", [0.0, 1.0]), ("l2sq", [0.0, 5.0]), ("neg_dot", [-5.0, 0.0])):
        got = [r[0] for r in df.select(V.distance_to(metric, F.col("v"), [1.0, 2.0])).collect()]
        assert [round(x, 9) for x in got[:2]] == want and got[2:] == [None] * 4
    codes = df.where("v is not null and size(v) = 2").select(V.quantize_int8(F.col("v")).alias("q")).select(V.distance_to_codes("l2sq", F.col("q.codes"), F.col("q.scale"), [1.0, 2.0])).collect()
    assert codes[0][0] < 0.01 and codes[1][0] == 5.0
