import corpus_pipeline
from brindle.llm import decontaminate, neardup, packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, s in scores.items() if s < 0.5)
    once = corpus_pipeline.drop_near_duplicates(spark, clean, SF).cache()
    kept = {r.doc_id for r in once.collect()}
    assert kept == {r.id for r in neardup.groups(clean).where("id = component").collect()}
    rest = corpus_pipeline.drop_leaks(spark, once, SF).cache()
    names = {r[0]: r[1] for r in once.select(decontaminate._row("doc_id", "text"), "doc_id").collect()}
    leaks = {names[r.doc] for r in decontaminate.contaminated(once, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in rest.collect()} == kept - leaks
    safe = corpus_pipeline.redact_personal_data(spark, rest, SF)
    assert safe.columns == docs.columns and safe.schema == docs.schema
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    pieces = corpus_pipeline.pack_sequences(spark, safe, SF).collect()
    assert {p.doc_id for p in pieces} == kept - leaks


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(0 < p.length <= packing.WINDOW for p in got)


def test_each_stage_takes_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", None), (1, "", "en", "s", 0), (3, "x " * 9000, "en", "s", 18000)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()
