"""The engine's operators as registered queries over the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rag
from .embed import HashEmbedder, embed_column, embed_with_table
from .engine import Engine
from .errors import NotFound
from .functions import metadata as M
from .functions import text as T
from .functions import vectors as V
from .operators import chunking, fusion, knn, lexical, stats
from .sources import changelog, corpus
from .sources.files import ingest, pretty_json
from .streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64
#: The first so many vectors go round the rows of other tables.
ROUND = 500


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir; only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the corpus of bucket docs; vectors go round the embeddings."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < ROUND).select("vec_id", "embedding")
    rows = table(spark, sf_dir, "documents").join(F.broadcast(e), F.pmod("doc_id", F.lit(ROUND)) == F.col("vec_id"))  # ROUND rows
    return corpus.as_corpus(rows, F.lit("docs"), F.col("doc_id"), F.col("text"), F.to_json(F.struct("lang", "source", "n_chars")), F.col("embedding"))


def customers_and_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and orders as buckets users and orders; vectors go round the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    c = table(spark, sf_dir, "customer").withColumn("vec_id", F.col("c_custkey") % 500)
    o = table(spark, sf_dir, "orders").withColumn("vec_id", F.col("o_orderkey") % 500)
    users = corpus.as_corpus(c.join(e, "vec_id"), F.lit("users"), F.col("c_custkey"), F.col("c_name"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))), F.col("embedding"))
    orders = corpus.as_corpus(o.join(e, "vec_id"), F.lit("orders"), F.col("o_orderkey"), F.col("o_orderpriority"), F.to_json(F.struct((F.col("o_custkey") % 25).alias("nation"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))), F.col("embedding"))
    return users.unionByName(orders)


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return corpus.as_corpus(rows, F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")), F.concat_ws("#", "conv_id", "turn"), F.col("text"), F.to_json(F.struct("role", "turn")), None, F.col("conv_id"), F.col("turn"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


def sql_vector(text: str) -> str:
    return "[" + ",".join(repr(float(x)) for x in HashEmbedder(DIM).embed([text])[0]) + "]::DOUBLE[]"


def of(vec_id: int) -> str:
    return f"(select embedding::DOUBLE[] from embeddings where vec_id = {vec_id})"


DOCS = "docs as (select 'docs' bucket, d.doc_id::varchar external_id, d.text, d.lang, d.source, d.n_chars, e.embedding::DOUBLE[] v from documents d join embeddings e on d.doc_id % 500 = e.vec_id)"
HITS = "hits as (select *, list_cosine_distance(v, {q}) score from docs order by score, external_id limit {k})"
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def docs_hits(q: str, k: int) -> str:
    return f"with {DOCS}, {HITS.format(q=q, k=k)}"


_built: dict[tuple, str] = {}


def built(spark: SparkSession, sf_dir: str, what: str, names: tuple[str, ...], make: Callable[[str], None]) -> str:
    """The folder of an index over some tables: made once in a session, and again when a table's files have changed."""
    stamp = []
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
        f = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        stamp.append((s.getLength(), s.getFileCount(), f.getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, what, *stamp)
    if key not in _built:
        path = scratch(spark, what)
        make(path)
        _built[key] = path
    return _built[key]


def word_index(spark: SparkSession, sf_dir: str) -> lexical.WordIndex:
    """Stored postings of documents by doc_id."""
    path = built(spark, sf_dir, "words", ("documents",), lambda p: lexical.WordIndex(spark, p, ("doc_id",)).add(table(spark, sf_dir, "documents")))
    return lexical.WordIndex(spark, path, ("doc_id",))


def corpus_index(spark: SparkSession, sf_dir: str) -> lexical.WordIndex:
    """Stored postings of the corpus of documents()."""
    path = built(spark, sf_dir, "corpus-words", ("documents", "embeddings"), lambda p: lexical.WordIndex(spark, p).add(documents(spark, sf_dir)))
    return lexical.WordIndex(spark, path)


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of documents() as it is kept, by bucket."""
    path = built(spark, sf_dir, "corpus", ("documents", "embeddings"), lambda p: corpus.write(documents(spark, sf_dir), p))
    return corpus.read(spark, path)


def engine(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> Engine:
    return Engine(documents(spark, sf_dir) if rows is None else rows, dim=DIM)


def literal(v: list[float]) -> str:
    return "[" + ",".join(map(repr, v)) + "]"


# Scans and sources


@query(docs_hits(sql_vector("zero trust"), 10) + " select external_id id, round(score, 6) score from hits")
def src_01_semantic_scan(spark, sf_dir):
    return rounded(engine(spark, sf_dir).sql("SELECT id, score FROM docs WHERE semantic_match(content, 'zero trust') LIMIT 10"))


@query(docs_hits(of(7), 5) + " select external_id id, bucket, round(score, 6) score, text from hits")
def src_02_vector_scan(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 7))
    return rounded(engine(spark, sf_dir).sql(f"SELECT id, bucket, score, text FROM docs WHERE vector_distance(embedding, '{v}') LIMIT 5"))


@query("select 'docs' bucket, doc_id::varchar external_id, text from documents where doc_id = 42")
def src_04_point_get(spark, sf_dir):
    return corpus.get(documents(spark, sf_dir), "docs", "42").select("bucket", "external_id", "text")


@query(f"with {DOCS} select external_id, text, round(list_sum(v), 4) total from docs")
def src_05_export(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return corpus.export_bucket(documents(spark, sf_dir), "docs").select("external_id", "text", F.round(total, 4).alias("total"))


@query(f"with {DOCS} select external_id, text, n_chars::varchar n_chars, round(list_sum(v), 4) total from docs")
def src_06_import(spark, sf_dir):
    log = changelog.ChangeLog(spark, scratch(spark, "log"), "hash", DIM)
    log.import_rows(documents(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return log.corpus().select("external_id", "text", M.json_text(F.col("metadata"), "n_chars").alias("n_chars"), F.round(total, 4).alias("total"))


STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select page_id, {STRIPPED} as text from pages")
def src_09_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("select event_id, '{' || chr(10) || '  \"k\": ' || (props->'$.k')::varchar || chr(10) || '}' as text from events")
def src_10_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", pretty_json(F.col("props")).alias("text"))


#: events as a change log: what a mutation does follows from its type and number.
LOG = """log as (select event_id seq, case when event_type = 'error' and event_id % 40 = 0 then 'empty_bucket' when event_type = 'error' then 'delete_document'
 when event_type = 'click' then 'delete' when event_type = 'purchase' then 'insert_document' else 'insert' end op, 'b' || (user_id % 5) bucket,
 case when event_type in ('purchase', 'error') then 'd' else 'p' end || (user_id % 40) id, event_type || ' ' || event_id as text from events)"""
FOLD = f"""with {LOG}, put as (select seq, bucket, id external_id, null parent, text from log where op = 'insert'
 union all select seq, bucket, id || '#' || i, id, text || ' ' || i from log, (values (0), (1)) c(i) where op = 'insert_document'),
 latest as (select * from put qualify row_number() over (partition by bucket, external_id order by seq desc) = 1),
 live as (select l.* from latest l where not exists (select 1 from log g where g.bucket = l.bucket and g.seq > l.seq and
 (g.op = 'empty_bucket' or (g.op = 'delete' and g.id = l.external_id) or (g.op in ('delete_document', 'insert_document') and g.id = l.parent))))"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when((kind == "error") & (F.col("event_id") % 40 == 0), "empty_bucket").when(kind == "error", "delete_document").when(kind == "click", "delete").when(kind == "purchase", "insert_document").otherwise("insert")
    text = F.concat_ws(" ", "event_type", "event_id")
    parts = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(0).alias("char_start"), F.concat(text, F.lit(f" {i}")).alias("text"), F.lit(None).cast("array<float>").alias("vector")) for i in (0, 1)))
    return e.select(
        F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("bucket"),
        F.concat(F.when(kind.isin("purchase", "error"), "d").otherwise("p"), (F.col("user_id") % 40).cast("string")).alias("id"),
        F.when(op == "insert", text).alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.when(op == "insert_document", parts).alias("chunks"), F.col("props").alias("metadata"), (F.col("event_id") % 7).alias("home_epoch"),
    )


def appended(spark, sf_dir, parts: int) -> changelog.ChangeLog:
    """events as a stored change log of so many batches."""
    log = changelog.ChangeLog(spark, scratch(spark, "log"))
    records = event_log(spark, sf_dir)
    least, last = records.agg(F.min("seq"), F.max("seq")).first()
    size = (last - least) // parts + 1
    for start in range(least, last + 1, size):
        batch = records.where((F.col("seq") >= start) & (F.col("seq") < start + size))
        log.append(batch.withColumn("nth", F.col("seq") - F.lit(start)).drop("seq"))
    return log


@query(f"with {LOG}, s as (select *, seq - min(seq) over () n, (max(seq) over () - min(seq) over ()) // 4 + 1 size from log), kept as (select *, n as place from s where n < 3 * size) select op, bucket, count(*) n, max(place) last_seq from kept group by all")
def src_12_log_replay(spark, sf_dir):
    log = appended(spark, sf_dir, 4)
    fs, p = log._fs(f"{log.path}/log/{log._batches()[-1][2]}/_SUCCESS")
    fs.delete(p, False)  # the writer of the last batch did not come to its end: replay stops before it
    return log.log().groupBy("op", "bucket").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query(f"{FOLD} select bucket, external_id, text from live")
def snk_01_snapshot(spark, sf_dir):
    log = event_log(spark, sf_dir)
    half = log.agg(F.max("seq")).first()[0] // 2
    path = scratch(spark, "snapshot")
    changelog.fold(log.where(F.col("seq") <= half)).write.parquet(path)
    base = spark.read.schema(corpus.CORPUS).parquet(path)
    return changelog.fold(log, base, half).select("bucket", "external_id", "text")


@query(f"with {LOG} select seq - min(seq) over () seq, op, bucket, id, (select max(seq) - min(seq) from log) head from log")
def snk_02_log_append(spark, sf_dir):
    log = appended(spark, sf_dir, 3)
    return log.log().select("seq", "op", "bucket", "id", F.lit(log.head()).cast("bigint").alias("head"))


@query(f"{FOLD} select bucket, external_id, text from live")
def snk_05_backup(spark, sf_dir):
    path, kept, back = scratch(spark, "log"), scratch(spark, "backup"), scratch(spark, "restored")
    one = changelog.ChangeLog(spark, path, "hash", DIM)
    one.append(event_log(spark, sf_dir).withColumn("nth", F.col("seq")))
    one.backup(kept)
    other = changelog.ChangeLog(spark, back, "hash", DIM)
    other.restore(kept)
    return other.corpus().select("bucket", "external_id", "text")


# SQL: projection, filters, order


@query(docs_hits(of(3), 10) + " select external_id id, lang, source, n_chars::varchar n_chars, null::varchar missing from hits")
def sql_01_projection(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 3))
    return engine(spark, sf_dir).sql(f"SELECT id, lang, source, n_chars, missing FROM docs WHERE vector_distance(embedding, '{v}')")


@query(docs_hits(of(3), 6) + " select external_id id, bucket, round(score, 6) score, text from hits")
def sql_02_star(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 3))
    return rounded(engine(spark, sf_dir).sql(f"SELECT * FROM docs WHERE vector_distance(embedding, '{v}') LIMIT 6")).drop("metadata")


@query(docs_hits(of(11), 32) + " select external_id id, lang, round(score, 6) score from hits where lang = 'en' order by hits.score, id limit 5")
def sql_03_equality(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 11))
    return rounded(engine(spark, sf_dir).sql(f"SELECT id, lang, score FROM docs WHERE vector_distance(embedding, '{v}') AND lang = 'en' LIMIT 5"))


@query(docs_hits(of(11), 40) + " select external_id id, lang from hits where lang in ('de', 'fr') order by score, id limit 10")
def sql_04_in(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 11))
    return engine(spark, sf_dir).sql(f"SELECT id, lang FROM docs WHERE vector_distance(embedding, '{v}') AND lang IN ('de', 'fr') LIMIT 10")


@query(docs_hits(of(5), 400) + " select external_id id, source from hits where lang = 'en' and source in ('src0', 'src1', 'src2') order by score, id limit 100")
def sql_05_conjunction(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 5))
    return engine(spark, sf_dir).sql(f"SELECT id, source FROM docs WHERE (lang = 'en' AND vector_distance(embedding, '{v}')) AND source IN ('src0', 'src1', 'src2') LIMIT 100")


@query("select o_orderkey::varchar id, round(list_cosine_distance(e.embedding::DOUBLE[], " + of(9) + "), 6) score from orders o join embeddings e on o.o_orderkey % 500 = e.vec_id order by list_cosine_distance(e.embedding::DOUBLE[], " + of(9) + "), id limit 10")
def sql_08_bucket(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 9))
    return rounded(engine(spark, sf_dir, customers_and_orders(spark, sf_dir)).sql(f"SELECT id, score FROM orders WHERE vector_distance(embedding, '{v}') LIMIT 10"))


@query(docs_hits(of(2), 20) + " select external_id id, round(score, 6) score from hits order by hits.score desc limit 20")
def top_02_by_score(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 2))
    return rounded(engine(spark, sf_dir).sql(f"SELECT id, score FROM docs WHERE vector_distance(embedding, '{v}') ORDER BY score DESC LIMIT 20"))


@query(docs_hits(of(2), 40) + " select external_id id, n_chars::varchar n_chars from hits where lang = 'en' order by hits.n_chars desc, id limit 10")
def top_03_by_metadata(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 2))
    return engine(spark, sf_dir).sql(f"SELECT id, n_chars FROM docs WHERE vector_distance(embedding, '{v}') AND lang = 'en' ORDER BY n_chars DESC LIMIT 10")


@query(docs_hits(of(2), 3) + " select external_id id from hits")
def top_04_limit(spark, sf_dir):
    v = literal(vector_of(spark, sf_dir, 2))
    return engine(spark, sf_dir).sql(f"SELECT id FROM docs WHERE vector_distance(embedding, '{v}') LIMIT 3")


@query("select event_id seq, round(value, 4) took_ms from events where value >= 10 order by value desc, event_id limit 32")
def top_07_slow_queries(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("took_ms"))
    return rounded(stats.slow_queries(log), "took_ms").withColumn("took_ms", F.round("took_ms", 4))


@query("select event_id seq, event_type from events order by event_id desc limit 1024")
def top_08_audit_ring(spark, sf_dir):
    return stats.audit_ring(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"))


# SQL: joins

SIDES = """u as (select c_custkey::varchar id, c_name as text, c_nationkey nation, c_mktsegment segment, list_cosine_distance(e.embedding::DOUBLE[], {q}) score
 from customer join embeddings e on c_custkey % 500 = e.vec_id order by score, id limit {ku}),
 o as (select o_orderkey::varchar id, o_custkey % 25 nation, o_totalprice total, o_orderstatus status, list_cosine_distance(e.embedding::DOUBLE[], {q}) score
 from orders join embeddings e on o_orderkey % 500 = e.vec_id order by score, id limit {ko})"""


def joined(spark, sf_dir, sql: str) -> DataFrame:
    return engine(spark, sf_dir, customers_and_orders(spark, sf_dir)).sql(sql.replace("VEC", literal(vector_of(spark, sf_dir, 4))))


@query(f"with {SIDES.format(q=of(4), ku=10, ko=10)} select u.id || ':' || o.id id, 'u⋈o' bucket, round((u.score + o.score) / 2, 6) score, u.id \"u.id\", o.id \"o.id\", u.nation::varchar \"u.nation\" from u join o on u.nation = o.nation")
def join_01_inner(spark, sf_dir):
    return rounded(joined(spark, sf_dir, "SELECT u.id, o.id, u.nation FROM users u JOIN orders AS o ON u.nation = o.nation WHERE vector_distance(u.embedding, 'VEC') AND vector_distance(o.embedding, 'VEC')"))


@query(f"with {SIDES.format(q=of(4), ku=40, ko=40)} select u.id || ':' || o.id id, 'u⋈o' bucket, u.segment \"u.segment\", o.status \"o.status\" from u join o on u.nation = o.nation where u.segment in ('BUILDING', 'MACHINERY') and o.status = 'O'")
def join_03_per_side(spark, sf_dir):
    return joined(spark, sf_dir, "SELECT u.segment, o.status FROM users u JOIN orders o ON o.nation = u.nation WHERE vector_distance(u.embedding, 'VEC') AND vector_distance(o.embedding, 'VEC') AND u.segment IN ('BUILDING', 'MACHINERY') AND o.status = 'O'").drop("score")


@query(f"with {SIDES.format(q=of(4), ku=40, ko=10)} select u.id || ':' || o.id id, 'u⋈o' bucket, round(o.total, 2)::double total from u join o on u.nation = o.nation where u.segment = 'BUILDING' order by o.total desc, u.id, o.id limit 3")
def join_07_order_limit(spark, sf_dir):
    found = joined(spark, sf_dir, "SELECT o.total FROM users u JOIN orders o ON u.nation = o.nation WHERE vector_distance(u.embedding, 'VEC') AND vector_distance(o.embedding, 'VEC') AND u.segment = 'BUILDING' ORDER BY o.total DESC LIMIT 3")
    return found.select("id", "bucket", F.round(F.col("`o.total`").cast("double"), 2).alias("total"))


# SQL: aggregates


def grouped(spark, sf_dir, sql: str, candidates: object = None) -> DataFrame:
    rows = customers_and_orders(spark, sf_dir)
    return Engine(rows, dim=DIM, candidates=candidates).sql(sql.replace("VEC", literal(vector_of(spark, sf_dir, 4))))


USERS = "users as (select c_custkey::varchar id, c_name as text, c_mktsegment segment, c_nationkey nation, c_acctbal balance, list_cosine_distance(e.embedding::DOUBLE[], " + of(4) + ") score from customer join embeddings e on c_custkey % 500 = e.vec_id)"


@query(f"with {USERS}, h as (select * from users order by score, id limit 10) select segment, count(*) n from h group by segment")
def agg_01_group_by(spark, sf_dir):
    return engine(spark, sf_dir, customers_and_orders(spark, sf_dir)).sql(f"SELECT segment, COUNT(*) AS n FROM users WHERE vector_distance(embedding, '{literal(vector_of(spark, sf_dir, 4))}') GROUP BY segment")


@query(f"with {USERS} select segment, nation::varchar nation, count(*) \"count\" from users group by all")
def agg_02_count_star(spark, sf_dir):
    return grouped(spark, sf_dir, "SELECT segment, nation, COUNT(*) FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY segment, nation")


@query(f"with {USERS} select segment, count(balance) count_balance, 0::bigint count_nothing from users group by segment")
def agg_03_count_column(spark, sf_dir):
    return grouped(spark, sf_dir, "SELECT segment, COUNT(balance), COUNT(nothing) FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY segment")


@query(f"with {USERS} select segment, round(sum(balance), 2) total, 0.0::double sum_segment from users group by segment")
def agg_04_sum(spark, sf_dir):
    found = grouped(spark, sf_dir, "SELECT segment, SUM(balance) AS total, SUM(segment) FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY segment")
    return found.withColumn("total", F.round("total", 2))


@query(f"with {USERS} select segment, round(avg(balance), 4) avg_balance, null::double avg_segment from users group by segment")
def agg_05_avg(spark, sf_dir):
    found = grouped(spark, sf_dir, "SELECT segment, AVG(balance), AVG(segment) FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY segment")
    return found.withColumn("avg_balance", F.round("avg_balance", 4))


@query(f"with {USERS} select segment, round(min(balance), 2) low, round(max(balance), 2) high from users group by segment")
def agg_06_min_max_number(spark, sf_dir):
    found = grouped(spark, sf_dir, "SELECT segment, MIN(balance) AS low, MAX(balance) AS high FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY segment")
    return found.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("low", "high")})


@query(f"with {USERS} select nation::varchar nation, min(segment) min_segment, max(text) max_text from users group by nation")
def agg_07_min_max_string(spark, sf_dir):
    return grouped(spark, sf_dir, "SELECT nation, MIN(segment), MAX(text) FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY nation")


@query(f"with {USERS} select nation::varchar nation, count(*) n from users group by nation order by n desc, nation limit 5")
def agg_10_order(spark, sf_dir):
    return grouped(spark, sf_dir, "SELECT nation, COUNT(*) AS n FROM users WHERE vector_distance(embedding, 'VEC') GROUP BY nation ORDER BY n DESC LIMIT 5")


@query("select 'c' || (conv_id % 3) bucket, count(*) docs, count(distinct conv_id) parent_docs, 'role=' || count(*) || ',turn=' || count(*) as keys from conversations group by 1")
def agg_15_bucket_stats(spark, sf_dir):
    found = stats.bucket_stats(conversation_chunks(spark, sf_dir))
    return found.withColumn("keys", F.array_join(F.transform("keys", lambda k: F.concat_ws("=", k["key"], k["count"])), ","))


RANKED = """asked as (select vec_id query_id, embedding::DOUBLE[] q, label from embeddings where vec_id % 100 = 0),
 ranked as (select query_id, a.label wanted, e.vec_id row_id, e.label got, row_number() over (partition by query_id order by list_cosine_distance(e.embedding::DOUBLE[], q), e.vec_id) rank
 from asked a, embeddings e where e.vec_id <> a.query_id)"""


@query(f"with {RANKED}, f as (select query_id, min(rank) filter (where rank <= 10 and wanted = got) first from ranked group by query_id) select count(*) queries, round(avg((first is not null)::int::double), 6) recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) mrr from f")
def agg_16_retrieval_quality(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    ranked = knn.batch_topk(e, asked, 11).where("query_id != vec_id")
    order = F.row_number().over(stats.Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = ranked.withColumn("rank", order).select("query_id", F.col("vec_id").alias("row_id"), "rank")
    labels = e.select(F.col("vec_id").alias("row_id"), "label")
    relevant = asked.select("query_id", "label").join(labels, "label").where("query_id != row_id")
    return rounded(stats.retrieval_quality(ranked, relevant), "recall_at_k", "mrr")


@query("select count(*) chunks from conversations where conv_id = 3")
def agg_17_count_chunks(spark, sf_dir):
    return stats.count_chunks(conversation_chunks(spark, sf_dir), "c0", "3")


# Scalar functions

PAIRS = "with p as (select a.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query(f"{PAIRS} select vec_id, round(list_cosine_distance(x, y), 6) d from p")
def sca_01_cosine_distance(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(V.cosine_distance(F.col("x"), F.col("y")), 6).alias("d"))


@query(f"{PAIRS} select vec_id, round(list_distance(x, y) ** 2, 6) d from p")
def sca_02_l2sq(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(V.l2sq(F.col("x"), F.col("y")), 6).alias("d"))


@query(f"{PAIRS} select vec_id, round(-list_dot_product(x, y), 6) d from p")
def sca_03_neg_dot(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(V.neg_dot(F.col("x"), F.col("y")), 6).alias("d"))


CODES = "q as (select vec_id, embedding::DOUBLE[] v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 s from embeddings), c as (select *, list_transform(v, lambda x: greatest(-127, least(127, round(x / s)))::int) codes from q)"


@query(f"with {CODES} select vec_id, array_to_string(codes, ',') codes, round(s, 8) scale from c")
def sca_04_quantize(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.array_join(F.transform("q.codes", lambda c: c.cast("string")), ",").alias("codes"), F.round("q.scale", 8).alias("scale"))


@query(f"with {CODES} select vec_id, round(list_sum(list_transform(codes, lambda k: k * s)), 6) total, round(list_max(list_transform(list_zip(v, codes), lambda z: abs(z[1] - z[2] * s))) / s, 3) <= 0.5 is_close from c")
def sca_05_dequantize(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.quantize_int8(F.col("embedding")).alias("q"))
    back = q.select("vec_id", "embedding", "q.scale", V.dequantize(F.col("q.codes"), F.col("q.scale")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    error = F.array_max(F.zip_with("embedding", "v", lambda a, b: F.abs(a.cast("double") - b)))
    return back.select("vec_id", F.round(total, 6).alias("total"), (F.round(error / F.col("scale"), 3) <= 0.5).alias("is_close"))


@query(f"with {CODES} select vec_id, round(list_cosine_distance({of(1)}, list_transform(codes, lambda k: k * s)), 6) d from c order by list_cosine_distance({of(1)}, list_transform(codes, lambda k: k * s)), vec_id limit 20")
def sca_06_asymmetric(spark, sf_dir):
    asked = V.vector(vector_of(spark, sf_dir, 1))
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.quantize_int8(F.col("embedding")).alias("q"))
    d = V.asymmetric_distance("cosine", asked, F.col("q.codes"), F.col("q.scale"))
    return q.select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(20).withColumn("d", F.round("d", 6))


@query(f"select doc_id, array_to_string({TOKENS.format('text')}, ' ') tokens from documents")
def sca_07_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


@query("with p as (select page_id, url || case page_id % 5 when 0 then '.md' when 1 then '/x.HTML' when 2 then '/a.py' when 3 then '/b.csv' else '' end path from pages), e as (select page_id, path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) x from p) select page_id, case when x in ('md', 'markdown') then 'markdown' when x in ('html', 'htm') then 'html' when x in ('rs','py','js','ts','go','java','c','h','cpp','hpp','rb','php','cs','swift','kt','scala','sh') then 'code' when x in ('csv','tsv','jsonl','ndjson') then 'structured' else 'text' end doc_type, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') doc_id from e")
def sca_09_doc_type(spark, sf_dir):
    n = F.col("page_id") % 5
    path = F.concat("url", F.when(n == 0, ".md").when(n == 1, "/x.HTML").when(n == 2, "/a.py").when(n == 3, "/b.csv").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", T.doc_type_for(path).alias("doc_type"), T.doc_id_for(path).alias("doc_id"))


@query(r"with c as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents) select doc_id, case when length(t) <= 280 then t when instr(t[:280], ' ') > 0 then regexp_replace(t[:280], ' [^ ]*$', '') || '…' else t[:280] || '…' end summary from c")
def sca_10_summarize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.summarize(F.col("text")).alias("summary"))


@query(f"with w as (select doc_id, unnest({TOKENS.format('text')}) w from documents), c as (select doc_id, w, count(*) n from w where length(w) >= 3 and w not in ({','.join(repr(s) for s in T.STOPWORDS)}) group by all), k as (select *, row_number() over (partition by doc_id order by n desc, w) r from c) select d.doc_id, coalesce(string_agg(w, ',' order by r) filter (where r <= 5), '') keywords from documents d left join k using (doc_id) group by d.doc_id")
def sca_11_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(F.col("text"), 5), ",").alias("keywords"))


@query("select doc_id, length(text) char_count from documents")
def sca_12_char_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.char_count(F.col("text")).cast("bigint").alias("char_count"))


SUMMARY = r"case when length(t) <= 280 then t when instr(t[:280], ' ') > 0 then regexp_replace(t[:280], ' [^ ]*$', '') || '…' else t[:280] || '…' end"
KEYWORDS = f"w as (select doc_id, unnest({TOKENS.format('text')}) w from documents), c as (select doc_id, w, count(*) n from w where length(w) >= 3 and w not in ({','.join(repr(s) for s in T.STOPWORDS)}) group by all), k as (select *, row_number() over (partition by doc_id order by n desc, w) r from c)"


@query(rf"with {KEYWORDS}, m as (select doc_id, string_agg(w, ',' order by r) filter (where r <= 8) kw from k group by doc_id), f as (select doc_id, length(text) char_count, source, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents) select doc_id, char_count, 'text' doc_type, source, {SUMMARY} summary, coalesce(kw, '') keywords from f left join m using (doc_id)")
def sca_13_metadata(spark, sf_dir):
    built_ = table(spark, sf_dir, "documents").select("doc_id", T.build_metadata(F.col("text"), F.lit("text"), F.col("source")).alias("m"))
    fields = F.from_json("m", "char_count bigint, doc_type string, source string, summary string, keywords array<string>")
    return built_.select("doc_id", fields.alias("f")).select("doc_id", "f.char_count", "f.doc_type", "f.source", "f.summary", F.array_join("f.keywords", ",").alias("keywords"))


@query("select conv_id || '#' || turn chunk_id, conv_id::varchar doc, turn::int chunk from conversations")
def sca_15_attribution(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("chunk_id"))
    return ids.select("chunk_id", T.attribution(F.col("chunk_id")).alias("a")).select("chunk_id", "a.doc", "a.chunk")


@query("select event_id, props->>'$.k' k, null::varchar missing from events")
def sca_16_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.json_text(F.col("props"), "k").alias("k"), M.json_text(F.col("props"), "a.b").alias("missing"))


@query("with b as (select min(value) low, max(value) high from events) select event_id, round(case when high - low <= 1.1920929e-7 then 1 else (value - low) / (high - low) end, 6) v from events, b")
def sca_17_min_max(spark, sf_dir):
    return fusion.min_max(table(spark, sf_dir, "events").select("event_id", "value"), "value", "v").select("event_id", F.round("v", 6).alias("v"))


@query(f"{PAIRS} select vec_id, round(1 / (1 + list_cosine_distance(x, y)), 6) s from p")
def sca_18_similarity(spark, sf_dir):
    return vector_pairs(spark, sf_dir).select("vec_id", F.round(fusion.similarity(V.cosine_distance(F.col("x"), F.col("y"))), 6).alias("s"))


#: The hash embedder in whole numbers of 128 bits: FNV-1a over the bytes, then DIM steps of xorshift64, cut to 64 bits each time.
EMBEDDED = f"""b as (select item_id, hex(encode(text)) x from benchmark), f as (select item_id, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::uhugeint)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616::uhugeint) h from b),
 x as (select item_id, list_reduce(list_prepend([case when h = 0 then {{zero}}::uhugeint else h end], list_transform(range({DIM}), lambda i: [i::uhugeint])), lambda s, i: s || [xor(xor(xor(s[-1], (s[-1] * 8192) % 18446744073709551616::uhugeint), xor(s[-1], (s[-1] * 8192) % 18446744073709551616::uhugeint) // 128), (xor(xor(s[-1], (s[-1] * 8192) % 18446744073709551616::uhugeint), xor(s[-1], (s[-1] * 8192) % 18446744073709551616::uhugeint) // 128) * 131072) % 18446744073709551616::uhugeint)]) s from f),
 v as (select item_id, list_transform(s[2:], lambda k: (k // 1099511627776)::double / 16777216 * 2 - 1) v from x)"""


@query(f"with {EMBEDDED.format(zero=1)} select item_id, len(v) dim, list_transform(v, lambda k: round(10000 * k / sqrt(list_sum(list_transform(v, lambda y: y * y))))::bigint)::varchar as shown from v")
def sca_19_hash_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select("item_id", embed_column(HashEmbedder(DIM, dtype=np.float64), F.col("text")).alias("v"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: F.round(x * 10000).cast("bigint").cast("string")), ", "), F.lit("]"))
    return e.select("item_id", F.size("v").alias("dim"), shown.alias("shown"))


@query("select item_id, sha256('hash' || chr(0) || text) as key from benchmark")
def sca_20_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.cache_key(F.lit("hash"), F.col("text")).alias("key"))


@query("select event_id, coalesce(value::int::varchar, '') shown from events")
def sca_21_to_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.to_text(F.rint("value").cast("int")).alias("shown"))


@query("with s as (select conv_id, string_agg('[' || turn || '] ' || text || chr(10), '' order by turn) c from conversations group by conv_id) select conv_id, 'Context:' || chr(10) || c || chr(10) || 'Question: who?' || chr(10) || 'Answer concisely using only the context above.' prompt from s")
def sca_22_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", rag.prompt_column(F.lit("who?"), F.col("t.text")).alias("prompt"))


@query("select item_id, 'Answer: ' || text answer from benchmark")
def sca_23_echo_model(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", rag.generate_column(rag.EchoModel(), F.col("text")).alias("answer"))


@query("select event_id, case when user_id % 3 = 0 then 'bearer:' || ('token-' || event_id || '-0123456789')[:16] when user_id % 3 = 1 then 'ip:10.0.0.' || (user_id % 256) else 'anon' end fingerprint from events")
def sca_24_fingerprint(spark, sf_dir):
    n = F.col("user_id") % 3
    bearer = F.when(n == 0, F.concat(F.lit("Bearer token-"), F.col("event_id").cast("string"), F.lit("-0123456789")))
    peer = F.when(n == 1, F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", T.principal_fingerprint(bearer, peer).alias("fingerprint"))


# Chunks


@query("with s as (select doc_id, text, unnest(range(0, (ceil(greatest(length(text) - 500, 0) / 450.0) * 450)::bigint + 1, 450)) a from documents where length(text) > 0) select doc_id, (a // 450)::int as index, a::int char_start, substr(text, a + 1, 500) as text from s")
def chk_01_fixed(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", F.inline(chunking.fixed_chunks(F.col("text"))))
    return cut.select("doc_id", "index", "char_start", "text")


def _chunk_rows(spark, sf_dir, strategy) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(chunking.chunks(F.col("text"), strategy)))


@query()
def chk_02_sentence(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, "sentence")


@query()
def chk_03_heading(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, "heading")


@query()
def chk_04_code(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, "code")


@query()
def chk_05_by_type(spark, sf_dir):
    kinds = F.element_at(F.array(*(F.lit(k) for k in chunking.BY_TYPE)), (F.col("doc_id") % 5 + 1).cast("int"))
    return _chunk_rows(spark, sf_dir, chunking.strategy_for(kinds))


@query("with s as (select doc_id, text, source, unnest(range(0, (ceil(greatest(length(text) - 300, 0) / 280.0) * 280)::bigint + 1, 280)) a from documents where length(text) > 0) select source bucket, doc_id || '#' || (a // 280) external_id, substr(text, a + 1, 300) as text, doc_id::varchar parent_doc_id, (a // 280)::int chunk_index from s")
def chk_06_explode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), F.col("doc_id").cast("string"), "text", F.lit("{}").alias("metadata"))
    return chunking.explode_documents(docs, "fixed", 300, 20).select("bucket", "external_id", "text", "parent_doc_id", "chunk_index")


# Retrieval


@query("select vec_id, round(list_cosine_distance(embedding::DOUBLE[], " + of(0) + "), 6) score from embeddings order by list_cosine_distance(embedding::DOUBLE[], " + of(0) + "), vec_id limit 10")
def ret_01_knn(spark, sf_dir):
    return rounded(knn.topk(table(spark, sf_dir, "embeddings"), vector_of(spark, sf_dir, 0), 10, tie=("vec_id",)).select("vec_id", "score"))


@query(f"with {RANKED.replace('where e.vec_id <> a.query_id', '')} select query_id, row_id vec_id, rank::int rank from ranked where rank <= 10")
def ret_01_knn_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return knn.batch_topk(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10).select("query_id", "vec_id", "rank")


@query("with a as (select 'l2sq' metric, vec_id, list_distance(embedding::DOUBLE[], " + of(0) + ") ** 2 d from embeddings union all select 'neg_dot', vec_id, -list_dot_product(embedding::DOUBLE[], " + of(0) + ") from embeddings) select metric, vec_id, round(d, 6) score from a qualify row_number() over (partition by metric order by d, vec_id) <= 10")
def ret_02_metrics(spark, sf_dir):
    e, q = table(spark, sf_dir, "embeddings"), vector_of(spark, sf_dir, 0)
    l2, dot = (knn.topk(e, q, 10, m, tie=("vec_id",)).select(F.lit(m).alias("metric"), "vec_id", "score") for m in ("l2sq", "neg_dot"))
    return rounded(l2.union(dot))


def near_index(spark: SparkSession, sf_dir: str, quantized: bool = False) -> tuple[knn.IvfIndex, DataFrame]:
    """The stored index over embeddings: 32 cells fitted on a sample, every row in one."""
    e = table(spark, sf_dir, "embeddings")
    path = built(spark, sf_dir, f"cells-{quantized}", ("embeddings",), lambda p: knn.IvfIndex.fit(e, 32).store(e, p, quantized))
    return knn.IvfIndex.load(spark, path)


def recall_of(spark, sf_dir, quantized: bool) -> DataFrame:
    """Queries with ids divisible by 100 against all rows: whether the index finds 0.9 of the exact neighbours."""
    e = table(spark, sf_dir, "embeddings")
    index, rows = near_index(spark, sf_dir, quantized)
    asked = e.where("vec_id % 100 = 0").orderBy("vec_id").collect()  # a stated set of queries
    found = [index.search(rows, r.embedding, 10, probes=24).select(F.lit(r.vec_id).alias("query_id"), "vec_id") for r in asked]
    exact = knn.batch_topk(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    share = knn.recall(reduce(DataFrame.union, found), exact)
    return spark.createDataFrame([(len(asked), rows.count(), share >= 0.9)], "queries bigint, rows_indexed bigint, recall_holds boolean")


RECALL = "select count(*) filter (where vec_id % 100 = 0) queries, count(*) rows_indexed, true recall_holds from embeddings"


@query(RECALL)
def ret_01_ivf(spark, sf_dir):
    return recall_of(spark, sf_dir, False)


@query(RECALL)
def ret_01_ivf_int8(spark, sf_dir):
    return recall_of(spark, sf_dir, True)


def bm25_sql(source: str, key: str, q: str, k: int, extra: str = "") -> str:
    terms = ", ".join(f"'{t}'" for t in lexical.terms_of(q))
    return f"""tok as (select {key} doc, unnest({TOKENS.format('text')}) t from {source}), n as (select count(*) n from {source}), dl as (select doc, count(*) len from tok group by doc),
 st as (select n.n, (select count(*) from tok) / n.n::double avgdl from n), tf as (select doc, t, count(*) f from tok where t in ({terms}) group by doc, t), df as (select t, count(*) df from tf group by t),
 sc as (select tf.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) score from tf join df using (t) join dl using (doc), st {extra} group by tf.doc order by score desc, tf.doc limit {k})"""


@query(f"with {bm25_sql('documents', 'doc_id', 'the idiot erin', 20)} select doc doc_id, round(score, 6) score from sc")
def ret_03_bm25(spark, sf_dir):
    return rounded(word_index(spark, sf_dir).search("the idiot erin", 20))


@query(f"with {bm25_sql('documents', 'doc_id', 'the idiot erin', 20)} select doc doc_id, round(score, 6) score from sc")
def ret_03_bm25_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(lexical.bm25(docs, "the idiot erin", 20, key=("doc_id",)).select("doc_id", "score"))


@query(f"select doc_id, t term, count(*) tf, any_value(len)::int len from (select doc_id, unnest(k) t, length(k) len from (select doc_id, {TOKENS.format('text')} k from documents)) group by doc_id, t")
def ret_04_postings(spark, sf_dir):
    return word_index(spark, sf_dir).postings().select("doc_id", "term", "tf", "len")


CHANGED = "changed as (select doc_id, case when doc_id % 5 = 0 then reverse(text) || ' erin' else text end as text from documents where doc_id % 7 <> 0)"


@query(f"with {CHANGED}, {bm25_sql('changed', 'doc_id', 'the idiot erin', 20)} select doc doc_id, round(score, 6) score from sc")
def ret_04_maintenance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = lexical.WordIndex(spark, scratch(spark, "words"), ("doc_id",), 8)
    index.add(docs)
    index.add(docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.reverse("text"), F.lit(" erin"))))
    index.remove(docs.where("doc_id % 7 = 0"))
    return rounded(index.search("the idiot erin", 20))


HYBRID_Q = "the on and"


def hybrid_sql(weights: tuple[float, float], k: int) -> str:
    stage = fusion.stage_k(k)
    return f"""with {DOCS}, {bm25_sql('docs', 'external_id', HYBRID_Q, stage)},
 nv as (select external_id, 1 / (1 + list_cosine_distance(v, {sql_vector(HYBRID_Q)})) s from docs order by list_cosine_distance(v, {sql_vector(HYBRID_Q)}), external_id limit {stage}),
 a as (select external_id, case when max(s) over () - min(s) over () <= 1.1920929e-7 then 1 else (s - min(s) over ()) / (max(s) over () - min(s) over ()) end x from nv),
 b as (select doc external_id, case when max(score) over () - min(score) over () <= 1.1920929e-7 then 1 else (score - min(score) over ()) / (max(score) over () - min(score) over ()) end y from sc)
 select external_id id, round({weights[0]} * coalesce(x, 0) + {weights[1]} * coalesce(y, 0), 6) score from a full join b using (external_id) order by {weights[0]} * coalesce(x, 0) + {weights[1]} * coalesce(y, 0) desc, id limit {k}"""


@query(hybrid_sql((0.5, 0.5), 10))
def ret_05_hybrid(spark, sf_dir):
    e = Engine(stored_corpus(spark, sf_dir), dim=DIM, words=corpus_index(spark, sf_dir))
    return rounded(e.search(HYBRID_Q, 10, hybrid=True).select("id", "score"))


@query(hybrid_sql((0.2, 0.8), 10))
def ret_06_weights(spark, sf_dir):
    e = Engine(documents(spark, sf_dir), dim=DIM, weights=fusion.Weights(by_bucket={"docs": (0.2, 0.8)}))  # scans
    return rounded(e.search(HYBRID_Q, 10, bucket="docs", hybrid=True).select("id", "score"))


@query("select * from (values (0, 'how do I set up VPN, or k8s?'), (1, 'how do I set up virtual private network or k8s?'), (2, 'how do I set up remote access or k8s?'), (3, 'how do I set up VPN, or kubernetes')) t(nth, variant)")
def ret_07_expand(spark, sf_dir):
    return spark.createDataFrame([(i, v) for i, v in enumerate(fusion.expand_query("how do I set up VPN, or k8s?"))], "nth int, variant string")


@query(f"with {DOCS}, c as (select external_id, list_cosine_distance(v, {sql_vector('db on tls')}) a, list_cosine_distance(v, {sql_vector('database on tls')}) b, list_cosine_distance(v, {sql_vector('db on ssl')}) c, list_cosine_distance(v, {sql_vector('db on transport layer security')}) d from docs), u as (" + " union all ".join(f"(select external_id, {x} s from c order by {x}, external_id limit 15)" for x in "abcd") + ") select external_id id, round(min(s), 6) score from u group by external_id order by min(s), id limit 5")
def ret_08_merge_variants(spark, sf_dir):
    return rounded(engine(spark, sf_dir).grounding("db on tls", 5, expand=True).select("id", "score"))


@query(docs_hits(of(6), 12) + " select external_id id, (12 - row_number() over (order by hits.score, external_id) + 1)::double score from hits order by hits.score, external_id limit 4")
def ret_09_rerank(spark, sf_dir):
    hits = engine(spark, sf_dir).vector_search(vector_of(spark, sf_dir, 6), 12)
    return fusion.rerank(hits, "q", 4, key=("bucket", "id")).select("id", "score")


RAG_Q = "what is the on?"
#: The three nearest documents, the prompt over them, and what the echo model makes of it.
ANSWERED = f"""with {DOCS}, {HITS.format(q=sql_vector(RAG_Q), k=3)}, n as (select *, row_number() over (order by score, external_id) - 1 nth from hits),
 a as (select 'Answer: Context:' || chr(10) || string_agg('[' || nth || '] ' || text || chr(10), '' order by nth) || chr(10) || 'Question: {RAG_Q}' || chr(10) || 'Answer concisely using only the context above.' answer, string_agg(external_id || '@' || round(score, 4), ',' order by nth) sources from n)"""


@query(f"{ANSWERED} select '{RAG_Q}' query, answer, sources from a")
def ret_10_rag(spark, sf_dir):
    a = engine(spark, sf_dir).rag_answer(RAG_Q, 3)
    return spark.createDataFrame([(a["query"], a["answer"], ",".join(f"{s['doc']}@{round(s['score'], 4)}" for s in a["sources"]))], "query string, answer string, sources string")


@query()
def ret_10_rag_all_steps(spark, sf_dir):
    a = engine(spark, sf_dir).rag_answer(RAG_Q, 3, hybrid=True, expand=True, rerank=True)
    return spark.createDataFrame([(a["query"], a["answer"], [(s["doc"], s["chunk"], s["score"]) for s in a["sources"]])], "query string, answer string, sources array<struct<doc:string,chunk:int,score:double>>")


@query(f"""{ANSWERED}, d as (select unnest(regexp_extract_all(answer, '[^ ]* |[^ ]+$')) w, generate_subscripts(regexp_extract_all(answer, '[^ ]* |[^ ]+$'), 1) i from a)
 select nth::int nth, 'context' event, external_id as value from n union all select (2 + i)::int, 'answer_delta', w from d union all select (3 + (select max(i) from d))::int, 'done', ''""")
def ret_11_rag_stream(spark, sf_dir):
    events = list(engine(spark, sf_dir).rag_stream(RAG_Q, 3))
    return spark.createDataFrame([(i, e["event"], str(e.get("id") or e.get("delta") or "")) for i, e in enumerate(events)], "nth int, event string, value string")


@query(f"{ANSWERED} select 'ai_answer' id, answer, sources from a")
def ret_12_ai_answer(spark, sf_dir):
    row = engine(spark, sf_dir).sql(f"SELECT ai_answer('{RAG_Q}', 'docs', 3)")
    return row.select("id", "answer", F.array_join(F.transform("sources", lambda s: F.concat(s["doc"], F.lit("@"), F.round(s["score"], 4).cast("string"))), ",").alias("sources"))


PLANNED = (
    '{"node": "aggregate", "input": {"node": "scan", "bucket": "docs", "semantic": {"node": "match", "column": "text", "query": "x"}, '
    '"filters": [{"path": "lang", "values": ["en", "de"]}], "columns": null, "order_by": null, "limit": null}, "group_keys": ["lang"], '
    '"aggs": [{"fn": "count", "path": null, "alias": "n"}], "order_by": {"key": "n", "descending": true}, "limit": 3}'
)


@query(f"select '{PLANNED}' as plan")
def ret_14_explain(spark, sf_dir):
    plan = engine(spark, sf_dir).explain("SELECT lang, COUNT(*) AS n FROM docs WHERE semantic_match(text, 'x') AND lang IN ('en', 'de') GROUP BY lang ORDER BY n DESC LIMIT 3")
    return spark.createDataFrame([(plan,)], "plan string")


# Mutations


@query(f"{FOLD} select bucket, external_id, parent parent_doc_id, text from live")
def mut_07_fold(spark, sf_dir):
    return changelog.fold(event_log(spark, sf_dir)).select("bucket", "external_id", "parent_doc_id", "text")


@query("with l as (select *, row_number() over (partition by user_id order by event_id desc) r from events) select 'p' || user_id external_id, event_type || ' ' || event_id as text from l where r = 1")
def mut_01_upsert(spark, sf_dir):
    log = event_log(spark, sf_dir).drop("id", "op", "chunks", "text").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"), F.concat_ws(" ", "event_type", "event_id").alias("text")), "seq")
    log = log.withColumns({"op": F.lit("insert"), "chunks": F.lit(None).cast("array<struct<index:int,char_start:int,text:string,vector:array<float>>>"), "bucket": F.lit("b")})
    return changelog.fold(log).select("external_id", "text")


@query(f"{FOLD} select bucket, count(*) docs, count(distinct parent) parents from live group by bucket")
def mut_06_state_by_bucket(spark, sf_dir):
    return changelog.fold(event_log(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("docs"), F.countDistinct("parent_doc_id").alias("parents"))


@query("select 2 seq, 2 dropped, 3 docs")
def mut_08_compact(spark, sf_dir):
    log = changelog.ChangeLog(spark, scratch(spark, "log"))
    for i in range(3):
        log.upsert("b", f"k{i}", f"text {i}")
    seq = log.snapshot()
    dropped = log.compact([seq - 1])
    return spark.createDataFrame([(seq, dropped, log.corpus().count())], "seq int, dropped int, docs int")


# Change events


@query(f"with {LOG} select seq as cursor, seq + 1 next_cursor, op, bucket, case when op <> 'empty_bucket' then id end id, case when op = 'insert' then text end as text, (case when op = 'insert_document' then 2 end)::int chunks from log")
def str_01_events(spark, sf_dir):
    e = cdc.to_events(event_log(spark, sf_dir))
    return e.select("cursor", "next_cursor", "op", F.col("key.bucket").alias("bucket"), F.col("key.id").alias("id"), F.col("body.text").alias("text"), F.when(F.col("body.chunks").isNotNull(), F.size("body.chunks")).alias("chunks"))


@query(f"with {LOG} select seq as cursor, op from log where bucket = 'b2' and op in ('insert', 'delete')")
def str_02_filter(spark, sf_dir):
    return cdc.filter_events(cdc.to_events(event_log(spark, sf_dir)), "b2", ("insert", "delete")).select("cursor", "op")


@query(f"with {LOG} select seq as cursor, seq + 1 next_cursor, op from log")
def str_03_cdc_files(spark, sf_dir):
    path = scratch(spark, "log")
    event_log(spark, sf_dir).write.parquet(path)
    out = scratch(spark, "events")
    cdc.to_files(cdc.to_events(cdc.tail(spark, path)), out, scratch(spark, "cursor")).awaitTermination()
    return spark.read.schema("cursor bigint, next_cursor bigint, op string").json(out)


@query(f"{FOLD} select bucket, external_id, text from live")
def str_04_follower(spark, sf_dir):
    path, copy = scratch(spark, "log"), scratch(spark, "copy")
    event_log(spark, sf_dir).repartition(4, "seq").write.parquet(path)
    cdc.follow(cdc.tail(spark, path, 2), copy, scratch(spark, "cursor")).awaitTermination()
    return cdc.follower_state(spark, copy).select("bucket", "external_id", "text")


@query(f"with {LOG}, l as (select *, seq % 7 epoch from log) select seq, bucket from l where bucket not in ('b0', 'b4') and not (bucket = 'b1' and epoch < 3)")
def str_05_cross_region(spark, sf_dir):
    owned = spark.createDataFrame([("b0",), ("b4",)], "bucket string")
    epochs = spark.createDataFrame([("b1", 3)], "bucket string, epoch bigint")
    return cdc.skip_home(event_log(spark, sf_dir), owned, epochs).select("seq", "bucket")


@query("with c as (select event_id, 5 leader_seg, 8192 leader_off, 4 + event_id % 3 seg, (event_id * 37) % 12000 off from events) select event_id, (leader_seg > seg or (leader_seg = seg and leader_off > off)) behind, case when leader_seg = seg then greatest(leader_off - off, 0) end lag_bytes, (not (leader_seg > seg or (leader_seg = seg and leader_off > off)) or coalesce((case when leader_seg = seg then greatest(leader_off - off, 0) end) <= 4096, false)) caught_up from c")
def str_06_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit(5).alias("leader_seg"), F.lit(8192).alias("leader_off"), (4 + F.col("event_id") % 3).alias("seg"), ((F.col("event_id") * 37) % 12000).alias("off"))
    return stats.lag(e).select("event_id", "behind", F.col("lag_bytes").cast("bigint").alias("lag_bytes"), "caught_up")


@query("select n_name bucket, 'r' || n_regionkey region, n_nationkey::bigint epoch from nation where n_nationkey = 7")
def str_07_home_region(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    seeds = corpus.as_corpus(n, F.lit("__regions__"), F.col("name"), F.col("name"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("home_region"), F.col("n_nationkey").alias("home_epoch"))))
    name = n.where("n_nationkey = 7").first()["name"]
    return corpus.home_region(seeds, name).select(F.lit(name).alias("bucket"), "region", "epoch")


@query("select count(*) rows_out, count(distinct text) keys from benchmark")
def svc_02_embedding_cache(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    cache = items.where("item_id % 2 = 0").select(T.cache_key(F.lit("hash"), F.col("text")).alias("key"), embed_column(HashEmbedder(DIM), F.col("text")).alias("embedding"))
    found = embed_with_table(items, cache, HashEmbedder(DIM))
    return found.where("embedding is not null").agg(F.count("*").alias("rows_out"), F.countDistinct("key").alias("keys"))


def fold_sql(*ops: str) -> str:
    """FOLD over the records of some operations."""
    chosen = ", ".join(f"'{o}'" for o in ops)
    return FOLD.replace("put as (", f"kept as (select * from log where op in ({chosen})), put as (", 1).replace("from log where op =", "from kept where op =").replace("from log, (values", "from kept, (values").replace("from log g where", "from kept g where")


def fold_of(spark, sf_dir, *ops: str) -> DataFrame:
    return changelog.fold(event_log(spark, sf_dir).where(F.col("op").isin(*ops))).select("bucket", "external_id", "parent_doc_id", "text")


SELECT_LIVE = " select bucket, external_id, parent parent_doc_id, text from live"


@query(fold_sql("insert", "delete") + SELECT_LIVE)
def mut_07_fold_deletes(spark, sf_dir):
    return fold_of(spark, sf_dir, "insert", "delete")


@query(fold_sql("insert_document", "delete_document") + SELECT_LIVE)
def mut_07_fold_documents(spark, sf_dir):
    return fold_of(spark, sf_dir, "insert_document", "delete_document")


def item_log(spark, sf_dir) -> changelog.ChangeLog:
    """benchmark as rows of bucket b in a stored log, and conversations as documents of bucket c, one chunk a turn."""
    log = changelog.ChangeLog(spark, scratch(spark, "log"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    log.append(items.select(F.lit("insert").alias("op"), F.lit("b").alias("bucket"), F.col("item_id").cast("string").alias("id"), "text", (F.row_number().over(stats.Window.orderBy("item_id")) - 1).alias("nth")))  # a few items
    said = table(spark, sf_dir, "conversations").select(F.lit("c").alias("bucket"), F.concat_ws("#", "conv_id", "turn").alias("external_id"), "text", F.lit(None).cast("string").alias("metadata"), F.col("conv_id").cast("string").alias("parent_doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.lit(None).cast("array<float>").alias("embedding"))
    log.import_rows(said)
    return log


ITEMS = "rows as (select 'b' bucket, item_id::varchar external_id, text from benchmark union all select 'c', conv_id || '#' || turn, text from conversations)"


@query("select item_id::varchar id, item_id % 7 <> 0 as went_in, case when item_id % 7 <> 0 then text end as stored from benchmark")
def mut_02_bulk_upsert(spark, sf_dir):
    log = changelog.ChangeLog(spark, scratch(spark, "log"), "hash", 2)
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").collect()  # the items of a few requests
    said = []
    for at in range(0, len(rows), changelog.BULK_MOST):
        part = rows[at : at + changelog.BULK_MOST]
        answers = log.bulk("b", [{"id": str(r.item_id), "text": r.text, "embedding": [1.0, 0.0, 0.0] if r.item_id % 7 == 0 else [1.0, 0.0]} for r in part])
        said += [(a["id"], a["ok"]) for a in answers]
    told = spark.createDataFrame(said, "id string, went_in boolean")
    return told.join(log.corpus().select(F.col("external_id").alias("id"), F.col("text").alias("stored")), "id", "left")


@query(f"with {ITEMS} select external_id, text from rows where external_id not like '3#%' union all values ('3#0', 'one'), ('3#1', 'two')")
def mut_03_upsert_document(spark, sf_dir):
    log = item_log(spark, sf_dir)
    log.upsert_document("c", "3", [{"index": i, "char_start": 0, "text": t} for i, t in enumerate(("one", "two"))])
    return log.corpus().select("external_id", "text")


@query(f"with {ITEMS} select external_id, text, true unknown_is_refused from rows where external_id not in ('2', '3#1')")
def mut_04_delete(spark, sf_dir):
    log = item_log(spark, sf_dir)
    log.delete("b", "2")
    log.delete("c", "3#1")
    refused = False
    try:
        log.delete("b", "no such key")
    except NotFound:
        refused = True
    return log.corpus().select("external_id", "text", F.lit(refused).alias("unknown_is_refused"))


@query(f"with {ITEMS} select external_id, text, (select count(*) from conversations where conv_id = 3) deleted from rows where external_id not like '3#%'")
def mut_05_delete_document(spark, sf_dir):
    log = item_log(spark, sf_dir)
    n = log.delete_document("c", "3")
    return log.corpus().select("external_id", "text", F.lit(n).cast("bigint").alias("deleted"))


@query("select item_id::varchar external_id, text, (select count(*) from conversations) emptied from benchmark")
def mut_06_empty_bucket(spark, sf_dir):
    log = item_log(spark, sf_dir)
    n = log.empty_bucket("c")
    return log.corpus().select("external_id", "text", F.lit(n).cast("bigint").alias("emptied"))


@query(f"with {SIDES.format(q=of(4), ku=10, ko=10)} select u.id || ':' || o.id id, u.id \"u.id\", o.id \"o.id\" from u join o on case when u.id::int % 3 > 0 then u.nation end = o.nation")
def join_04_null_keys(spark, sf_dir):
    rows = customers_and_orders(spark, sf_dir)
    bare = (F.col("bucket") == "users") & (F.col("external_id").cast("int") % 3 == 0)
    e = engine(spark, sf_dir, rows.withColumn("metadata", F.when(bare, F.lit("{}")).otherwise(F.col("metadata"))))
    v = literal(vector_of(spark, sf_dir, 4))
    return e.sql(f"SELECT u.id, o.id FROM users u JOIN orders o ON u.nation = o.nation WHERE vector_distance(u.embedding, '{v}') AND vector_distance(o.embedding, '{v}')").drop("bucket", "score")


@query("select 'kb' bucket, 'item-' || item_id || '#0' external_id, text, 'item-' || item_id parent_doc_id, 0 chunk_index, 'text' doc_type, length(text)::varchar char_count from benchmark where length(text) between 1 and 500")
def src_07_ingest(spark, sf_dir):
    path = scratch(spark, "files")
    for r in table(spark, sf_dir, "benchmark").where("length(text) <= 500").collect():  # a file for each of a few items
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-{r.item_id % 3}/item-{r.item_id}.txt")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(r.text.encode()))
        out.close()
    rows = ingest(spark, path, "kb")
    told = (M.json_text(F.col("metadata"), c).alias(c) for c in ("doc_type", "char_count"))
    return rows.select("bucket", "external_id", "text", "parent_doc_id", "chunk_index", *told)


@query(f"with {LOG} select seq, op, bucket, id from log")
def src_13_log_tail(spark, sf_dir):
    path, out = scratch(spark, "log"), scratch(spark, "copy")
    event_log(spark, sf_dir).repartition(4, "seq").write.parquet(path)
    read = cdc.tail(spark, path, 1).select("seq", "op", "bucket", "id")
    read.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(read.schema).parquet(out)


@query(f"with {LOG} select count(*) events, max(seq) last_cursor from log where op = 'delete'")
def snk_04_callable(spark, sf_dir):
    path = scratch(spark, "log")
    event_log(spark, sf_dir).write.parquet(path)
    seen: list[int] = []
    events = cdc.filter_events(cdc.to_events(cdc.tail(spark, path)), ops=("delete",))
    cdc.to_callable(events, lambda batch: seen.extend(e["cursor"] for e in batch), scratch(spark, "cursor")).awaitTermination()
    return spark.createDataFrame([(len(seen), max(seen, default=None))], "events bigint, last_cursor bigint")


@query(docs_hits(of(8), 32) + " select count(*) candidates, round(max(score), 6) farthest from hits")
def top_06_overfetch(spark, sf_dir):
    from .plans import execute, plan

    scan = plan.plan(f"SELECT id FROM docs WHERE vector_distance(embedding, '{literal(vector_of(spark, sf_dir, 8))}') AND lang IN ('en', 'de', 'fr', 'es') LIMIT 3")
    e = engine(spark, sf_dir)
    found = execute.hits(scan, execute.Context(e.corpus, e.embedder, dim=DIM))
    return found.agg(F.count("*").alias("candidates"), F.round(F.max("score"), 6).alias("farthest"))
