import json

import pytest

from brindle.embed import HashEmbedder
from brindle.engine import Engine, ResultCache
from brindle.errors import InvalidPlan, InvalidRequest, ParseError, TypeMismatch, Unsupported
from brindle.plans.plan import plan
from brindle.plans.parser import parse
from brindle.sources.corpus import CORPUS


def corpus(spark, rows):
    """rows: (bucket, id, text, metadata)."""
    vectors = HashEmbedder(8).embed([r[2] for r in rows])
    return spark.createDataFrame([(b, i, t, None if m is None else json.dumps(m), None, None, v.tolist()) for (b, i, t, m), v in zip(rows, vectors)], CORPUS)


def engine(spark, rows, **options):
    return Engine(corpus(spark, rows), HashEmbedder(8), dim=8, **options)


REGIONS = [("docs", "1", "zero trust", {"region": "eu"}), ("docs", "2", "zero trust", {"region": "us"}), ("docs", "3", "zero trust", {"region": "ap"})]


def test_star_gives_text(spark):
    rows = engine(spark, REGIONS).sql("SELECT * FROM docs WHERE semantic_match(content, 'zero trust') LIMIT 5").collect()
    assert len(rows) == 3 and {r.bucket for r in rows} == {"docs"} and {r.text for r in rows} == {"zero trust"} and all(abs(r.score) < 1e-6 for r in rows)


@pytest.mark.parametrize("where,ids", [("region = 'eu'", ["1"]), ("'eu' = region", ["1"]), ("region IN ('eu', 'us')", ["1", "2"]), ("(region = 'eu' AND region = 'eu')", ["1"]), ("region = 'none'", []), ("missing = NULL", ["1", "2", "3"]), ("missing IN ('x', NULL)", ["1", "2", "3"]), ("region = NULL", [])])
def test_filters(spark, where, ids):
    rows = engine(spark, REGIONS).sql(f"SELECT id FROM docs WHERE semantic_match(content, 'zero trust') AND {where}").collect()
    assert [r.id for r in rows] == ids


def test_keys_are_strict_about_types(spark):
    e = engine(spark, [("d", str(i), "t", {"v": v}) for i, v in enumerate([1, 1.0, "1", True, None, 10.5])])
    ask = lambda lit: [r.id for r in e.sql(f"SELECT id FROM d WHERE semantic_match(t, 't') AND v = {lit}").collect()]
    assert ask("1") == ["0"] and ask("1.0") == ["1"] and ask("'1'") == ["2"] and ask("TRUE") == ["3"] and ask("NULL") == ["4"] and ask("10.5") == ["5"]


def test_nested_path_and_limit(spark):
    e = engine(spark, [("docs", "a", "x", {"region": "eu", "nested": {"k": 7}})])
    row = e.sql("SELECT id, score, text, nested.k FROM docs WHERE semantic_match(c, 'x')").first()
    assert (row["id"], row["text"], row["nested.k"]) == ("a", "x", "7")
    many = engine(spark, [("docs", f"{i:02d}", "same", {"region": "eu"}) for i in range(20)])
    assert many.sql("SELECT id FROM docs WHERE semantic_match(c, 'same') AND region = 'eu' LIMIT 3").count() == 3
    assert many.sql("SELECT id FROM docs WHERE semantic_match(c, 'same') LIMIT 0").count() == 0
    assert many.sql("SELECT id FROM docs WHERE semantic_match(c, 'same')").count() == 10


def test_order_by(spark):
    e = engine(spark, [("d", "1", "t", {"r": "c", "n": 2}), ("d", "2", "t", {"r": "a", "n": 10}), ("d", "3", "t", {"r": "b"})])
    ids = lambda order: [r.id for r in e.sql(f"SELECT id FROM d WHERE semantic_match(t, 't') ORDER BY {order}").collect()]
    assert ids("r ASC") == ["2", "3", "1"] and ids("n DESC") == ["2", "1", "3"] and ids("n") == ["1", "2", "3"] and ids("score DESC") == ["1", "2", "3"]


SALES = [("docs", "1", "t", {"region": "eu", "v": 10, "name": "beta"}), ("docs", "2", "t", {"region": "eu", "v": 20, "name": "alpha"}), ("docs", "3", "t", {"region": "us", "v": 5, "name": "gamma"})]


def test_aggregates(spark):
    e = engine(spark, [*SALES, ("docs", "4", "t", {"v": "12"})])
    got = e.sql("SELECT region, COUNT(*) AS n, COUNT(v), SUM(v), AVG(v), MIN(v), MAX(v) AS top, MIN(name) AS first, MAX(name) AS last FROM docs WHERE semantic_match(t, 't') GROUP BY region ORDER BY n DESC").collect()
    assert [tuple(r) for r in got] == [("eu", 2, 2, 30.0, 15.0, "10.0", "20.0", "alpha", "beta"), ("us", 1, 1, 5.0, 5.0, "5.0", "5.0", "gamma", "gamma"), (None, 1, 1, 0.0, None, "12", "12", None, None)]


def test_aggregates_see_the_hits_only(spark):
    e = engine(spark, [("d", f"{i:03d}", "t", {"g": "x"}) for i in range(60)])
    sql = "SELECT g, COUNT(*) AS n FROM d WHERE semantic_match(t, 't') GROUP BY g"
    assert e.sql(sql).first().n == 10
    assert e.sql(sql.replace("GROUP", "AND g = 'x' GROUP")).first().n == 40
    e.candidates = None
    e.cache.clear()
    assert e.sql(sql).first().n == 60


BOTH = [("users", "u1", "t", {"region": "eu"}), ("users", "u2", "t", {"region": "us"}), ("users", "u3", "t", {"region": "eu"}), ("orders", "o1", "t", {"region": "eu", "total": 10}), ("orders", "o2", "t", {"region": "us", "total": 7}), ("orders", "o3", "t", {"region": "eu", "total": 20}), ("orders", "o4", "t", {}), ("users", "o4", "t", {})]
JOIN = "SELECT u.id, o.id, u.region, o.total FROM users u JOIN orders AS o ON u.region = o.region WHERE semantic_match(u.t, 't') AND semantic_match(o.t, 't')"


def test_join(spark):
    e = engine(spark, BOTH)
    rows = e.sql(f"{JOIN} ORDER BY o.total").collect()
    assert [r["o.total"] for r in rows] == ["7", "10", "10", "20", "20"] and rows[0]["id"] == "u2:o2" and rows[0]["bucket"] == "u⋈o"
    assert len(e.sql(f"{JOIN} AND u.region = 'eu'").collect()) == 4 == len(e.sql(f"{JOIN} AND 'eu' = u.region").collect())
    assert len(e.sql(f"{JOIN} LIMIT 2").collect()) == 2
    assert len(e.sql(JOIN.replace("u.region = o.region WHERE", "o.region = u.region WHERE")).collect()) == 5


REJECTED = [
    ("SELECT * FROM d WHERE semantic_match(t, 'x') OR r = 'eu'", Unsupported),
    ("SELECT * FROM d WHERE r = 'eu'", InvalidPlan),
    ("SELECT * FROM d", InvalidPlan),
    ("SELECT * FROM d WHERE semantic_match(a, 'x') AND vector_distance(b, '[1]')", InvalidPlan),
    ("SELECT * FROM d WHERE vector_distance(b, '[1, ')", TypeMismatch),
    ("SELECT * FROM d WHERE vector_distance(b, '[\"a\"]')", TypeMismatch),
    ("SELECT * FROM d WHERE semantic_match(a, 3)", TypeMismatch),
    ("SELECT a AS b FROM d WHERE semantic_match(t, 'x')", Unsupported),
    ("SELECT lower(a) FROM d WHERE semantic_match(t, 'x')", Unsupported),
    ("SELECT a + 1 FROM d WHERE semantic_match(t, 'x')", Unsupported),
    ("SELECT DISTINCT a FROM d WHERE semantic_match(t, 'x')", Unsupported),
    *((f"SELECT a FROM d WHERE semantic_match(t, 'x') AND {p}", Unsupported) for p in ("a < 1", "a <> 1", "a LIKE 'x'", "a BETWEEN 1 AND 2", "a IS NULL", "NOT a = 1", "a = -1", "a NOT IN (1)", "a = b", "a IN (SELECT 1)", "f(a) = 1")),
    ("SELECT COUNT(*) FROM d WHERE semantic_match(t, 'x')", Unsupported),
    *((f"SELECT r, COUNT(*) FROM d WHERE semantic_match(t, 'x') GROUP BY r {p}", Unsupported) for p in ("HAVING COUNT(*) > 1", "LIMIT 3 OFFSET 2", "ORDER BY r NULLS FIRST", "ORDER BY r, n")),
    ("SELECT *, COUNT(*) FROM d WHERE semantic_match(t, 'x') GROUP BY r", InvalidPlan),
    ("SELECT other, COUNT(*) FROM d WHERE semantic_match(t, 'x') GROUP BY r", InvalidPlan),
    ("SELECT r, COUNT(DISTINCT a) FROM d WHERE semantic_match(t, 'x') GROUP BY r", Unsupported),
    ("SELECT r, COUNT(*) OVER () FROM d WHERE semantic_match(t, 'x') GROUP BY r", Unsupported),
    ("SELECT r, COUNT(*) FROM d WHERE semantic_match(t, 'x') GROUP BY ROLLUP(r)", Unsupported),
    ("SELECT r, COUNT(*) AS n FROM d WHERE semantic_match(t, 'x') GROUP BY r ORDER BY z", InvalidPlan),
    *((f"SELECT u.id FROM users u {j} orders o ON u.r = o.r WHERE semantic_match(u.t, 'x') AND semantic_match(o.t, 'x')", Unsupported) for j in ("LEFT JOIN", "RIGHT JOIN", "FULL OUTER JOIN", "NATURAL JOIN")),
    ("SELECT u.id FROM users u CROSS JOIN orders o WHERE semantic_match(u.t, 'x')", Unsupported),
    ("SELECT u.id FROM users u JOIN orders o USING (r) WHERE semantic_match(u.t, 'x')", Unsupported),
    ("SELECT u.id FROM users u JOIN orders o ON u.r = o.r JOIN x ON x.r = u.r WHERE semantic_match(u.t, 'x')", Unsupported),
    ("SELECT u.id FROM users u JOIN orders o ON u.r > o.r WHERE semantic_match(u.t, 'x')", Unsupported),
    ("SELECT u.id FROM users u JOIN orders o ON r = o.r WHERE semantic_match(u.t, 'x')", Unsupported),
    ("SELECT u.id FROM users u JOIN orders u ON u.r = u.r WHERE semantic_match(u.t, 'x')", InvalidPlan),
    ("SELECT u.id FROM users u JOIN orders o ON u.r = o.r WHERE semantic_match(u.t, 'x') AND semantic_match(o.t, 'x') AND r = 1", InvalidPlan),
    ("SELECT u.id FROM users u JOIN orders o ON u.r = o.r WHERE semantic_match(u.t, 'x')", InvalidPlan),
    ("SELECT a FROM d WHERE semantic_match(t, 'x') UNION SELECT a FROM d", Unsupported),
    ("WITH x AS (SELECT 1) SELECT a FROM x", Unsupported),
    ("SELECT a FROM (SELECT 1) x", Unsupported),
    ("SELECT a FROM d, e WHERE semantic_match(t, 'x')", Unsupported),
    ("SELECT a FROM d WHERE semantic_match(t, 'x') LIMIT a", Unsupported),
    ("INSERT INTO d VALUES (1)", Unsupported),
    ("SELEC a", ParseError), ("SELECT a FROM d WHERE", ParseError), ("SELECT a FROM d WHERE semantic_match(t, 'x') garbage !", ParseError),
    ("SELECT ai_answer('q') FROM d", Unsupported), ("SELECT ai_answer(3)", TypeMismatch), ("SELECT ai_answer('q', 'b', 0)", TypeMismatch), ("SELECT ai_answer('q', 'b', 'c')", TypeMismatch), ("SELECT ai_answer()", TypeMismatch), ("SELECT ai_answer('q', 'b', 3, 4)", TypeMismatch),
]


@pytest.mark.parametrize("sql,error", REJECTED)
def test_rejections(sql, error):
    with pytest.raises(error) as e:
        plan(sql)
    assert type(e.value) is error and e.value.sqlstate in ("42601", "42804")


def test_plan_and_explain(spark):
    p = plan("SELECT id, score FROM docs WHERE semantic_match(content, 'it''s') AND region = 'eu-west' LIMIT 10")
    assert (p.bucket, p.limit, p.top_k, p.semantic.query, len(p.filters)) == ("docs", 10, 40, "it's", 1)
    assert plan("SELECT * FROM d WHERE vector_distance(e, '[0.1, 0.2, 3]') LIMIT 3").semantic.vector == (0.1, 0.2, 3.0)
    shown = json.loads(engine(spark, REGIONS).explain("SELECT r, COUNT(*) FROM d WHERE semantic_match(t, 'x') GROUP BY r"))
    assert shown["node"] == "aggregate" and shown["input"]["node"] == "scan" and shown["aggs"][0]["alias"] == "count"
    assert parse('SELECT "a b" FROM `my docs`').table.name == "my docs"


def test_answer_row(spark):
    e = engine(spark, [("docs", "d#0", "alpha", {}), ("docs", "d#1", "beta", {})])
    row = e.sql("SELECT ai_answer('alpha', 'docs', 1)").first()
    assert row.id == "ai_answer" and row.answer.startswith("Answer: Context:\n[0] alpha\n") and (row.sources[0].doc, row.sources[0].chunk) == ("d", 0)


def test_dimension_and_empty_statement(spark):
    e = engine(spark, REGIONS)
    with pytest.raises(TypeMismatch):
        e.sql("SELECT id FROM docs WHERE vector_distance(e, '[1, 2]')")
    for call in (e.sql, e.explain):
        with pytest.raises(InvalidRequest):
            call("  ")


def test_result_cache(spark):
    now = [0.0]
    cache = ResultCache(2, 30.0, lambda: now[0])
    e = engine(spark, REGIONS, cache=cache)
    sql = "SELECT id FROM docs WHERE semantic_match(c, 'zero trust') LIMIT {}"
    first = e.sql(sql.format(1))
    assert e.sql(sql.format(1)) is first and cache.hits == 1
    now[0] = 31
    assert e.sql(sql.format(1)) is not first
    e.sql(sql.format(2)), e.sql(sql.format(3))
    assert len(cache.entries) == 2
    e.replace_corpus(e.corpus)
    assert not cache.entries
