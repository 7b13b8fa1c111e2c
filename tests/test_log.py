import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.embed import HashEmbedder
from brindle.engine import Engine
from brindle.errors import InvalidPlan, InvalidRequest, NotFound, TypeMismatch, Unsupported
from brindle.model import CHANGELOG
from brindle.sources import changelog, corpus, files
from brindle.streaming import cdc
from brindle.streaming.scheduler import SnapshotScheduler


def plain_fold(log):
    """One record after the other."""
    rows, parents = {}, {}
    for seq, op, bucket, key, text, _, chunks, *_ in sorted(log):
        if op == "insert":
            rows[bucket, key] = (text, None)
        elif op == "insert_document":
            for k in [k for k, v in rows.items() if k[0] == bucket and v[1] == key]:
                del rows[k]
            for c in chunks:
                rows[bucket, f"{key}#{c[0]}"] = (c[2], key)
        elif op == "delete":
            rows.pop((bucket, key), None)
        elif op == "delete_document":
            for k in [k for k, v in rows.items() if k[0] == bucket and v[1] == key]:
                del rows[k]
        else:
            for k in [k for k in rows if k[0] == bucket]:
                del rows[k]
    return {(b, k, t, p) for (b, k), (t, p) in rows.items()}


def random_log(rng, n):
    out = []
    for seq in range(n):
        op = rng.choices(("insert", "insert_document", "delete", "delete_document", "empty_bucket"), (5, 4, 2, 2, 0.3))[0]
        bucket = rng.choice("ab")
        key = rng.choice(["p1", "p2"] if op == "insert" else ["d1", "d2"] if "document" in op else ["p1", "p2", "d1#0", "d1#1"])
        chunks = [(i, 0, f"t{seq}.{i}", None) for i in range(rng.randint(0, 3))] if op == "insert_document" else None
        out.append((seq, op, bucket, None if op == "empty_bucket" else key, f"t{seq}", None, chunks, "{}", 0))
    return out


def test_fold_against_one_by_one(spark):
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 200):
        for _ in range(3):
            log = random_log(rng, n)
            got = {(r.bucket, r.external_id, r.text, r.parent_doc_id) for r in changelog.fold(spark.createDataFrame(log, CHANGELOG).repartition(3)).collect()}
            assert got == plain_fold(log)


def test_log_snapshot_compaction_backup(spark, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), "m", 2)
    log.upsert("b", "1", "one", [1.0, 0.0], {"k": 1})
    log.upsert_document("b", "d", [{"index": i, "char_start": 0, "text": f"c{i}", "vector": [0.0, 1.0]} for i in range(3)], {"k": 2})
    said = log.bulk("b", [{"id": "2", "text": "two"}, {"id": "", "text": "bad"}, {"id": "3", "embedding": [1.0]}])
    assert [s["ok"] for s in said] == [True, False, False]
    with pytest.raises(InvalidRequest):
        log.bulk("b", [{"id": "x"}] * 1001)
    with pytest.raises(InvalidRequest):
        log.upsert("", "1", "x")
    assert log.delete_document("b", "d") == 3 and log.snapshot() == log.head()
    with pytest.raises(NotFound):
        log.delete_document("b", "d")
    with pytest.raises(NotFound):
        log.delete("b", "none")
    log.delete("b", "1")
    log.upsert("c", "9", "nine")
    state = lambda x: {(r.bucket, r.external_id, r.text) for r in x.corpus().collect()}
    assert state(log) == {("b", "2", "two"), ("c", "9", "nine")}
    assert log.compact([0]) == 1 and log.compact() == 3 and state(log) == {("b", "2", "two"), ("c", "9", "nine")}
    log.backup(str(tmp_path / "kept"))
    with pytest.raises(InvalidPlan):
        log.backup(str(tmp_path / "kept"))
    other = changelog.ChangeLog(spark, str(tmp_path / "other"), "m", 2)
    other.restore(str(tmp_path / "kept"))
    assert state(other) == state(log) and other.head() == log.head()
    with pytest.raises(InvalidPlan):
        changelog.ChangeLog(spark, str(tmp_path / "third"), "another", 2).restore(str(tmp_path / "kept"))
    with pytest.raises(InvalidPlan):
        other.restore(str(tmp_path / "kept"))
    with pytest.raises(NotFound):
        changelog.ChangeLog(spark, str(tmp_path / "fourth"), "m", 2).restore(str(tmp_path))
    assert log.empty_bucket("b") == 1 and state(log) == {("c", "9", "nine")}


def test_a_batch_without_its_commit_does_not_count(spark, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    log.upsert("b", "1", "one")
    log.upsert("b", "2", "two")
    (tmp_path / "log/log/batch=00000000000000000001-00000000000000000001/_SUCCESS").unlink()
    assert [r.external_id for r in log.corpus().collect()] == ["1"] and log.head() == 0
    log.upsert("b", "3", "three")  # takes the place of what was left
    assert sorted(r.external_id for r in log.corpus().collect()) == ["1", "3"] and log.head() == 1


def test_import_keeps_documents_together(spark, tmp_path):
    rows = [("b", "1", "one", "{}", None, None, [1.0, 0.0]), ("b", "d#0", "x", '{"k": 1}', "d", 0, [0.0, 1.0]), ("b", "d#1", "y", '{"k": 1}', "d", 1, [0.0, 1.0])]
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), "m", 2)
    frame = spark.createDataFrame(rows, "bucket string, external_id string, text string, metadata string, parent_doc_id string, chunk_index int, embedding array<float>")
    assert log.import_rows(frame.repartition(3)) == 3 and log.head() == 1
    assert {(r.external_id, r.text, r.parent_doc_id, r.chunk_index) for r in log.corpus().collect()} == {(r[1], r[2], r[4], r[5]) for r in rows}
    assert log.delete_document("b", "d") == 2
    with pytest.raises(TypeMismatch):
        log.import_rows(frame.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")))
    assert log.head() == 2 and log.import_rows(frame.limit(0)) == 0


def test_scheduler(spark, tmp_path):
    now = [0.0]
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    s = SnapshotScheduler(log, every=10, growth=1 << 30, clock=lambda: now[0])
    log.upsert("b", "1", "one")
    assert s.tick() is None
    now[0] = 11
    assert s.tick() == 0 and s.tick() is None
    grown = SnapshotScheduler(log, every=1e9, growth=1)
    log.upsert("b", "2", "two")
    assert grown.tick() == 1
    assert not SnapshotScheduler(log, "follower", every=0).due()


def test_events_filters_and_regions(spark):
    log = [(0, "insert", "b", "1", "t", [1.0], None, '{"a": 1}', 1), (1, "insert", "b", "2", "t", None, None, "no json", 2), (2, "insert_document", "c", "d", None, None, [(0, 0, "x", [1.0])], None, 3), (3, "delete", "b", "1", None, None, None, None, 1), (4, "empty_bucket", "c", None, None, None, None, None, 5)]
    df = spark.createDataFrame(log, CHANGELOG)
    e = cdc.to_events(df)
    rows = {r.cursor: r for r in e.collect()}
    assert rows[0].body.text == "t" and rows[1].body.metadata is None and rows[3].body is None and rows[4].key.id is None and rows[2].body.chunks[0].text == "x"
    cursors = lambda **k: sorted(r.cursor for r in cdc.filter_events(e, **k).collect())
    assert cursors(bucket="b") == [0, 1, 3] and cursors(ops=["delete", "insert"]) == [0, 1, 3] and cursors(ops=[]) == [] and cursors(vectors_only=True) == [0, 2]
    owned, epochs = spark.createDataFrame([("c",)], "bucket string"), spark.createDataFrame([("b", 2)], "bucket string, epoch long")
    assert [r.seq for r in cdc.skip_home(df, owned, epochs).collect()] == [1]


def test_streams_resume(spark, tmp_path):
    log = random_log(random.Random(3), 60)
    path, out, cursor = (str(tmp_path / n) for n in ("log", "out", "cursor"))
    write = lambda part: spark.createDataFrame(part, CHANGELOG).coalesce(1).write.mode("append").parquet(path)
    write(log[:30])
    run = lambda: cdc.to_files(cdc.to_events(cdc.tail(spark, path, 1)), out, cursor).awaitTermination()
    run()
    assert spark.read.json(out).count() == 30
    write(log[30:])
    run(), run()
    assert sorted(r.cursor for r in spark.read.json(out).select("cursor").collect()) == list(range(60))
    seen, failed = [], []

    def sink(events):
        if events[0]["cursor"] == 0:
            raise RuntimeError("no")
        seen.extend(e["cursor"] for e in events)

    cdc.to_callable(cdc.to_events(cdc.tail(spark, path, 1)), sink, str(tmp_path / "c2"), failed.append).awaitTermination()
    assert seen == list(range(30, 60)) and len(failed) == 1
    copy = str(tmp_path / "copy")
    for _ in range(2):
        cdc.follow(cdc.tail(spark, path, 1), copy, str(tmp_path / "c3")).awaitTermination()
    got = {(r.bucket, r.external_id, r.text, r.parent_doc_id) for r in cdc.follower_state(spark, copy).collect()}
    assert got == plain_fold(log)


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, content in {"a.md": "# A\ntext\n# B\nmore", "sub/b.html": "<p>hi <b>you</b></p>", "c.json": '{"a":1}', "d.json": "{bad", "e.pdf": "%PDF", "f.py": "import x\n\ndef f():\n    pass\n", "g.csv": "a,b\n"}.items():
        (tmp_path / "in" / name).write_text(content)
    docs = {r.doc_id: r for r in files.extract(files.read_files(spark, str(tmp_path / "in"))).collect()}
    assert docs["b"].text == "hi you" and docs["c"].text == '{\n  "a": 1\n}' and docs["d"].text == "{bad" and docs["e"].text is None and docs["f"].doc_type == "code"
    assert json.loads(docs["b"].metadata)["doc_type"] == "html" and json.loads(docs["b"].metadata)["char_count"] == 6
    with pytest.raises(Unsupported):
        files.extract(files.read_files(spark, str(tmp_path / "in")), strict=True)
    with pytest.raises(Unsupported):
        files.ingest(spark, str(tmp_path / "in"), "kb")
    rows = {(r.external_id, r.text) for r in files.ingest(spark, str(tmp_path / "in"), "kb", strict=False).collect()}
    assert {("a#0", "# A\ntext\n"), ("a#1", "# B\nmore"), ("f#1", "def f():\n    pass\n")} <= rows and not any(i.startswith("e#") for i, _ in rows)


def test_corpus_table(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "x", None, None, None, [1.0, 0.0]), ("b", "1", "y", None, None, None, [0.0, 1.0])], corpus.CORPUS)
    corpus.write(df, str(tmp_path / "c"))
    back = corpus.read(spark, str(tmp_path / "c"))
    assert corpus.point_get(back, "b", "1")["text"] == "y"
    with pytest.raises(NotFound):
        corpus.point_get(back, "b", "2")
    plan = corpus.export_bucket(back, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert corpus.check_import(corpus.export_bucket(back, "a"), 2).count() == 1
    with pytest.raises(TypeMismatch):
        corpus.check_import(df, 3)
    with pytest.raises(InvalidRequest):
        corpus.check_import(df.withColumn("external_id", F.lit("")), 2)


def test_search_and_answers(spark):
    texts = ["alpha beta", "alpha filler", "unrelated words", "errcode_8842 filler"]
    v = HashEmbedder(16).embed(texts)
    df = spark.createDataFrame([("docs", f"d#{i}", t, "{}", "d", i, x.tolist()) for i, (t, x) in enumerate(zip(texts, v))], corpus.CORPUS)
    e = Engine(df, HashEmbedder(16), dim=16)
    assert e.search("alpha beta", 1).first().id == "d#0" == e.vector_search(v[0].tolist(), 1).first().id
    scores = [r.score for r in e.search("alpha beta", 3, hybrid=True).collect()]
    assert scores == sorted(scores, reverse=True)
    assert e.bm25("8842").first().id == "d#3"
    for k in (0, 101):
        with pytest.raises(InvalidRequest):
            e.search("x", k)
    a = e.rag_answer("alpha beta", 2, hybrid=True, expand=True, rerank=True)
    assert a["answer"].startswith("Answer: Context:\n[0] alpha beta") and a["sources"][0] == {"doc": "d", "chunk": 0, "score": 4.0}
    events = list(e.rag_stream("alpha beta", 2))
    assert [x["event"] for x in events[:2]] == ["context"] * 2 and events[-1] == {"event": "done"} and "".join(x["delta"] for x in events if x["event"] == "answer_delta").startswith("Answer: ")


class Answers:
    """An HTTP server on this machine that notes what is posted and answers as told."""

    def __init__(self, answer):
        import http.server
        import threading

        seen = self.seen = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                seen.append(body)
                status, said = answer(body, len(seen))
                self.send_response(status)
                self.end_headers()
                self.wfile.write(b"" if said is None else json.dumps(said).encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_webhook_posts_each_event_once(spark, tmp_path):
    from brindle import remote

    log = [(i, "insert", "b", str(i), f"t{i}", None, None, None, 0) for i in range(5)]
    spark.createDataFrame(log, CHANGELOG).write.parquet(str(tmp_path / "log"))
    server = Answers(lambda body, n: (500 if body["cursor"] == 3 else 200, None))
    failed = []
    cdc.to_callable(cdc.to_events(cdc.tail(spark, str(tmp_path / "log"))), remote.webhook(server.url), str(tmp_path / "cursor"), failed.append).awaitTermination()
    assert [e["cursor"] for e in server.seen] == [0, 1, 2, 3] and len(failed) == 1  # what a sink fails on is dropped, the log goes on
    assert server.seen[0]["key"] == {"bucket": "b", "id": "0"} and server.seen[0]["body"]["text"] == "t0"


def test_http_reranker(spark):
    from brindle import remote
    from brindle.operators import fusion

    hits = spark.createDataFrame([("b", str(i), f"text {i}", "{}", i / 10) for i in range(4)], "bucket string, id string, text string, metadata string, score double")
    scores = Answers(lambda body, n: (200, {"scores": [len(d) * 0 + float(d[-1] == "2") for d in body["documents"]]}))
    got = fusion.rerank(hits, "q", 2, remote.HttpReranker(scores.url), key=("bucket", "id")).collect()
    assert [r.id for r in got] == ["2", "0"] and scores.seen == [{"query": "q", "documents": [f"text {i}" for i in range(4)]}]
    some = Answers(lambda body, n: (200, {"results": [{"index": 3, "score": 0.9}, {"index": 1, "score": 0.5}]}))
    assert [r.id for r in fusion.rerank(hits, "q", 3, remote.HttpReranker(some.url), key=("bucket", "id")).collect()] == ["3", "1", "0"]
    for bad in ({"scores": [1.0]}, {"results": [{"index": 9, "score": 1}]}, {"other": 1}):
        with pytest.raises(InvalidRequest):
            remote.HttpReranker(Answers(lambda body, n, bad=bad: (200, bad)).url)("q", ["a", "b"])
    assert remote.HttpReranker("http://127.0.0.1:9/")("q", []) == []


def test_slow_log_and_audit(spark, tmp_path):
    from brindle.operators.journal import AuditRing, SlowLog

    slow = SlowLog(2, 10)
    for sql, took in (("a", 5), ("b", 20), ("c", 30), ("d", 20), ("e", 25)):
        slow.note(sql, took, 1)
    assert [(e.sql, e.seq) for e in slow.entries()] == [("c", 3), ("e", 5)] and slow.table(spark).count() == 2
    log = changelog.ChangeLog(spark, str(tmp_path / "log"))
    log.audit = AuditRing(3, lambda: 1.0)
    log.upsert("b", "1", "one")
    log.bulk("b", [{"id": "2"}, {"id": ""}])
    log.delete("b", "1")
    log.empty_bucket("b")
    assert [(r.seq, r.op, r.id) for r in log.audit.table(spark).collect()] == [(4, "empty_bucket", None), (3, "delete", "1"), (2, "insert", "2")]
    e = Engine(log.corpus().withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")), HashEmbedder(2))
    e.slow.least_ms = 0
    assert e.query("SELECT id FROM b WHERE semantic_match(t, 'x')") == [] and e.slow.entries()[0].rows == 0
