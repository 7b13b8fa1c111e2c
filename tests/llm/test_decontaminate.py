import random

from pyspark.sql import functions as F

from brindle.llm import decontaminate as D
from brindle.llm import queries


def words_of(spark, text):
    return spark.range(1).select(D.template_words(F.lit(text)).alias("w")).first().w


def test_template(spark):
    assert words_of(spark, "Tom gave Ann Lee 3 kg of rice for $4.50, then 7km. Ran!") == ["tom", "gave", "‹name›", "‹name›", "‹num›", "‹unit›", "of", "rice", "for", "‹num›", "then", "‹num›‹unit›", "ran"]
    assert words_of(spark, " a | b\n - C ") == ["a", "b", "c"]
    assert words_of(spark, "") == []


QUESTION = "The shop where Anna works sold 12 kg of apples and 30 kg of pears on the first day. How many kg did Anna sell on that first day in the shop?"
OTHER = "The shop where Bert works sold 19 kg of apples and 45 kg of pears on the first day. How many kg did Bert sell on that first day in the shop?"
WRONG = "The shop where Bert works sold 19 kg of apples and 19 kg of pears on the first day. How many kg did Carl sell on that first day in the shop?"


def leaks(spark, docs, bench, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    ids = {r[0]: r[1] for r in d.select(D._row("doc_id", "text"), "doc_id").collect()}
    return {(ids[r.doc], r.item) for r in D.contaminated(d, b, **options).collect()}


def test_reparameterised_questions(spark):
    docs = [(1, "Some words first, then. " + QUESTION, "x"), (2, "lead in\n" + OTHER + " and more", "x"), (3, WRONG, "x"), (4, "The shop where Anna works is closed on the first day of May and all the others too.", "x")]
    assert leaks(spark, docs, [(7, QUESTION)]) == {(1, 7), (2, 7)}


def test_edges(spark):
    docs = [(1, None, "x"), (2, "", "x"), (None, QUESTION, "x"), (3, "one two", "x"), (3, QUESTION, "y"), (4, "filler " * 20_000 + QUESTION, "z"), (5, (QUESTION + " ") * 30, "z")]
    bench = [(7, QUESTION), (7, QUESTION), (8, None), (None, QUESTION), (9, ""), (10, "one two")]
    assert leaks(spark, docs, bench) == {(None, 7), (3, 7), (3, 10), (4, 7), (5, 7)}
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    kept = D.decontaminate(d, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    assert leaks(spark, [], bench) == set() and leaks(spark, docs, []) == set()


def test_large_benchmark_is_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_MOST", 0)
    assert leaks(spark, [(1, QUESTION, "x"), (2, OTHER, "x")], [(7, QUESTION)]) == {(1, 7), (2, 7)}


def test_against_plain_windows(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(20)]
    docs = []
    for i in range(80):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.5:
            passage = rng.choice(bench)[1].split()
            a = rng.randint(0, len(passage) // 2)
            own += " " + " ".join(passage[a:]) + " " + own
        docs.append((i, own, "x"))

    def windows(text):
        w = text.split()
        return [tuple(w[k : k + 8]) for k in range(len(w) - 7)] or [tuple(w)]

    want = set()
    for d, text, _ in docs:
        own = set(windows(text))
        for i, t in bench:
            all_ = set(windows(t))
            n = len(all_ & own)
            if n >= 0.3 * len(all_) and (n >= 8 or n == len(all_)) and len(t.split()) >= 8:
                want.add((d, i))
    got = leaks(spark, docs, bench)
    assert {(d, i) for d, i in got if len(dict(bench)[i].split()) >= 8} == want


def test_query_covers_every_row(spark):
    got = queries.op3_decontaminate(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.where("contaminated").count() > 0


def test_a_repeated_line_covers_its_window_once(spark):
    line = "the shop where many people work sold old bread"
    item = "the shop where many people work sold new bread and cake to nobody else but them"
    assert leaks(spark, [(1, (line + "\n") * 9, "x"), (2, "so " + item, "x")], [(7, item)]) == {(2, 7)}
    shared = " ".join(item.split()[:8])
    assert leaks(spark, [(1, "\n".join(f"{shared} w{k}" for k in range(9)), "x")], [(7, item)]) == set()


def test_names_that_open_sentences(spark):
    bench = [(1, "Betty is saving 100 dollars for a wallet. Betty has half of it. Betty gets 15 dollars from Anna. How much more does Betty need?"), (2, "Mark has 24 pens and gives 6 to each friend. How many friends get pens?")]
    docs = [(1, "Carla is saving 70 dollars for a wallet. Carla has half of it. Carla gets 20 dollars from Dora. How much more does Carla need?", "x"), (2, 'a line\n"Paul has 36 pens and gives 4 to each friend. How many friends get pens?"', "x"), (3, bench[1][1], "x")]
    wrong = [(4, "Carla is saving 70 dollars for a wallet. Emma has half of it. Fay gets 20 dollars from Dora. How much more does Gina need?", "x")]
    assert leaks(spark, docs + wrong, bench) == {(1, 1), (2, 2), (3, 2)}
    assert leaks(spark, docs + wrong, bench, capitals=False) == {(3, 2)}


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    clean = "Nobody would take these words about the weather in the mountains for a question of any benchmark at all, would they?"
    docs = [(5, QUESTION, "leak"), (5, clean, "clean"), (5, clean, "clean"), (None, "So. " + OTHER, "leak"), (None, clean, "clean"), (6, None, "clean"), (None, None, "clean")]
    d = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    b = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    kept = D.decontaminate(d, b).collect()
    assert [r.kind for r in kept] == ["clean"] * 5
    told = D.report(d, b).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in told) == [(0, False), (0, False), (0, True), (5, False), (5, False), (5, True), (6, False)]


def test_both_templates_from_one_pass(spark):
    texts = ["Tom gave Ann Lee 3 kg of rice for $4.50, then 7km. Ran!", "", " ", "A4 paper\x01Bob \x02, Bob's (Eve) McDonald 5 Km 6 km\x01 x", "\x01", "ÉTÉ à la Mer; Bob 1,000 €5.20 °C 30 °C", "‹name› Bob ‹num›", "a. B. c\nDe \tFg"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain, capital = D._both_words(F.col("m"))
    got = rows.select("text", D._marked(F.col("text")).alias("m")).select(plain.alias("p"), capital.alias("c"), D.template_words(F.col("text")).alias("wp"), D.template_words(F.col("text"), True).alias("wc")).collect()
    for r in got:
        assert r.p == r.wp and r.c == r.wc


def test_only_the_leaks_are_stored_and_nothing_stays_kept(spark, monkeypatch):
    from brindle.llm import common

    labels, plain = [], common.stored
    for module in (common, D):
        monkeypatch.setattr(module, "stored", lambda df, label, *rest, **options: labels.append(label) or plain(df, label, *rest, **options))
    item = "the quick brown fox jumps over the lazy dog and then it runs far away from here"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "something else"), (3, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert sorted((r.doc_id, r.contaminated, r.n_items) for r in D.report(docs, benchmark).collect()) == [(1, True, 1), (2, False, 0), (3, False, 0)]
    assert [r.doc_id for r in D.decontaminate(docs, benchmark).orderBy("doc_id").collect()] == [2, 3]
    assert labels == ["leaks", "leaks"] and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_windows_are_made_in_one_pass_of_generated_code(spark):
    texts = [(0, None), (1, ""), (2, "One"), (3, "a b c"), (4, "a b c d e f g h"), (5, "So Bob met Eve at 5 km. Then Ann gave 3 kg to Max Lee, and he ran 7 miles. Who Won?"), (6, "a b c " * 5)]
    rows = spark.createDataFrame(texts, "k int, text string")

    def windows(words):
        return [words[i : i + 8] for i in range(max(len(words) - 7, min(len(words), 1)))]

    for capitals in (True, False):
        kinds = {1: False, 2: True} if capitals else {1: False}
        own = D._windows(rows, "k", "j", capitals)
        got, hashes = {}, {}
        for r in own.collect():
            for t in kinds:
                if r.templates & t:
                    assert (r.k, t, r.j) not in got
                    got[r.k, t, r.j] = r.hash
        want = {}
        for t, c in kinds.items():
            for r in rows.select("k", D.template_words(D.F.col("text"), c).alias("w")).collect():
                want |= {(r.k, t, j): tuple(w) for j, w in enumerate(windows(r.w or []))}
        assert got.keys() == want.keys()
        for at, words in want.items():
            assert hashes.setdefault(words, got[at]) == got[at]
        assert len(set(hashes.values())) == len(hashes)
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == len(kinds) and "slice(" not in plan  # texts are cut once a template, windows not copied
