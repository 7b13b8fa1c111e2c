"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Names in the middle of a sentence, numbers and the units after them become typed placeholders; what is left is lower-cased
and loses its punctuation. Windows of eight template words are joined by hash with those of the benchmark. Windows of
one document and one item that lie on one diagonal (document place minus item place) are one alignment. Where an
alignment covers placeholders, the values must answer each other one to one: a question with other names and numbers
passes, a page that only looks alike does not.

A second template makes a placeholder of every capitalised word, those that open a sentence, a line or a quotation too.
Its windows are joined along with those of the first, and its alignments are judged by its own slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Between, stored

WIDTH = 8
#: Rows up to this many (about 40 MB) are broadcast: windows of the benchmark, slots, ids with leaks. More are joined by
#: a shuffle.
BROADCAST_MOST = 1_000_000
#: Units that make a placeholder after a number.
UNITS = "km|cm|mm|m|mi|ft|in|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hr|hrs|hours|hour|minutes|seconds|days|day|weeks|years|year|meters|metres|miles|feet|inches|grams|kilograms|pounds|liters|litres|percent|dollars|euros|cents|usd|eur|mph|kmh|hz|khz|mhz|ghz|kb|mb|gb|tb|°c|°f|c|f|k|%"
NAME = r"([\p{Ll},;›] )\p{Lu}\p{L}*"
CAPITAL = r"(?<![\p{L}\p{N}])\p{Lu}\p{L}*"
#: Signs that are set around a capitalised word where only the second template makes it a name.
OPEN, CLOSE = "\x01", "\x02"
NUMBER = r"\p{Sc}?[0-9]+(?:[.,:/][0-9]+)*"
UNIT = rf"(‹num› ?)(?:{UNITS})([^\p{{L}}\p{{N}}]|$)"
PUNCTUATION = r"[^\p{L}\p{N}‹› \t\n\r\f\x0B]+"
SPACE = r"[ \t\n\r\f\x0B]+"


def _placed(text: Column, capitals: bool = False) -> Column:
    """The text with placeholders, lower-cased, its white space as it was; with capitals, every capitalised word is a name."""
    once = F.regexp_replace(text, CAPITAL, "‹name›") if capitals else F.regexp_replace(F.regexp_replace(text, NAME, "$1‹name›"), NAME, "$1‹name›")
    return F.lower(F.regexp_replace(F.regexp_replace(once, NUMBER, "‹num›"), UNIT, "$1‹unit›$2"))


def template_words(text: Column, capitals: bool = False) -> Column:
    """The words of the template, as an array."""
    return F.array_remove(F.split(F.regexp_replace(_placed(text, capitals), PUNCTUATION, ""), SPACE), "")


def _marked(text: Column) -> Column:
    """The text of both templates at once: names of the first are placeholders, words that only the second takes for names
    stand between OPEN and CLOSE."""
    bare = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "!!")).otherwise(text)
    named = F.regexp_replace(F.regexp_replace(bare, NAME, "$1‹name›"), NAME, "$1‹name›")
    both = F.regexp_replace(F.regexp_replace(named, CAPITAL, f"{OPEN}$0{CLOSE}"), NUMBER, "‹num›")
    return F.regexp_replace(F.lower(F.regexp_replace(both, UNIT, "$1‹unit›$2")), PUNCTUATION.replace("‹›", f"‹›{OPEN}{CLOSE}"), "")


def _both_words(marked: Column) -> tuple[Column, Column]:
    """template_words() of both templates from the marked text."""
    plain = F.replace(F.replace(marked, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    capital = F.regexp_replace(marked, f"{OPEN}[^{CLOSE}]*{CLOSE}", "‹name›")
    return tuple(F.array_remove(F.split(x, SPACE), "") for x in (plain, capital))


def template_slots(text: Column, capitals: bool = False) -> Column:
    """array<struct<word, value>>: the template's words again, each with what stands in the text at its place."""
    words = F.transform(F.split(_placed(text, capitals), SPACE), lambda w: F.regexp_replace(w, PUNCTUATION, ""))
    values = F.transform(F.split(text, SPACE), lambda w: F.regexp_replace(w, PUNCTUATION, ""))
    both = F.zip_with(words, values, lambda w, v: F.struct(w.alias("word"), v.alias("value")))
    return F.filter(both, lambda s: s["word"] != "")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _rolled(hs: str, place: str) -> Column:
    """The hash of the window that begins at the place, null where none does; fewer than WIDTH words are one window.

    Elements are named one by one: slices of the array would be copied, and hashed outside of generated code.
    """
    at, count = F.col(place), F.size(hs)
    return F.when((at < count) & (at <= F.greatest(count - WIDTH, F.lit(0))), F.xxhash64(*(F.get(hs, at + k) for k in range(WIDTH))))


def _windows(texts: DataFrame, key: str, place: str, capitals: bool) -> DataFrame:
    """key, place, hash, templates of every window of WIDTH template words; a shorter text is one window.

    templates has bit 1 for a window of the first template and bit 2 for one of that with capitals.
    """
    # Places come from an outer explode: of an inner one the optimizer infers a filter on the array, and works it out twice.
    if not capitals:
        hashed = texts.select(key, _hashed(template_words(F.col("text"))).alias("hs"))
        placed = hashed.select(key, "hs", F.posexplode_outer("hs").alias(place, "_"))
        return placed.select(key, place, _rolled("hs", place).alias("hash"), F.lit(1).alias("templates")).where("hash is not null")
    plain, capital = _both_words(F.col("marked"))
    hashed = texts.select(key, _marked(F.col("text")).alias("marked")).select(key, _hashed(plain).alias("hs"), _hashed(capital).alias("cs"))
    longer = F.when(F.size("cs") > F.size("hs"), F.col("cs")).otherwise(F.col("hs"))
    placed = hashed.select(key, "hs", "cs", F.posexplode_outer(longer).alias(place, "_"))
    rolled = placed.select(key, place, _rolled("hs", place).alias("h"), _rolled("cs", place).alias("c"))
    same = F.col("h").eqNullSafe(F.col("c"))
    both = F.stack(F.lit(2), F.col("h"), F.when(same, 3).otherwise(1), F.when(~same, F.col("c")), F.lit(2))
    return rolled.select(key, place, both.alias("hash", "templates")).where("hash is not null")


def _row(id_column: str, text_column: str) -> Column:
    """What names a row: a hash of its id and text, so that rows that share an id, or have none, are judged one by one."""
    return F.xxhash64(F.col(id_column).cast("string"), F.col(text_column).cast("string"))


def alignments(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", capitals: bool = True, between: Between | None = None) -> DataFrame:
    """(doc, item, template, diagonal, places, consistent): one row for each alignment of a row of docs and an item in a template.

    doc is the row's name, see _row(); repeated rows have one.
    places are those of the item's windows that the alignment covers; consistent says that its slots answer each other.
    """
    between = between or Between(docs.sparkSession)
    texts = docs.select(_row(id_column, text_column).alias("doc"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_column).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null and item is not null")
    kinds = {1: False, 2: True} if capitals else {1: False}
    each = lambda rows: rows.withColumn("template", F.explode(F.array(*map(F.lit, kinds)))).where("templates & template != 0").drop("templates")
    bench = each(_windows(items, "item", "i", capitals)).groupBy("item", "template", "hash").agg(F.min("i").alias("i"))
    bench = bench.groupBy("item", "hash", "i").agg(F.sum("template").cast("int").alias("asked"))
    bench = F.broadcast(bench) if bench.count() <= BROADCAST_MOST else bench
    own = _windows(texts, "doc", "j", capitals)
    met = own.join(bench, "hash").select("doc", "item", (F.col("j") - F.col("i")).alias("diagonal"), "i", F.expr("templates & asked").alias("templates"))
    hits = between.kept(each(met).distinct())

    slotted = [items.select("item", F.lit(t).alias("template"), F.posexplode(template_slots(F.col("text"), c)).alias("p", "slot")) for t, c in kinds.items()]
    slots = reduce(DataFrame.unionByName, slotted).where("slot.word like '%‹%'").select("item", "template", "p", F.col("slot.value").alias("theirs"))
    covered = hits.select("doc", "item", "template", "diagonal", F.explode(F.sequence(F.col("i"), F.col("i") + WIDTH - 1)).alias("p"))
    asked = between.kept(covered.join(F.broadcast(slots) if slots.count() <= BROADCAST_MOST else slots, ["item", "template", "p"]).distinct())
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("item", "template", "diagonal", "p", "theirs")).alias("wanted"))
    wanted = F.broadcast(wanted) if asked.count() <= BROADCAST_MOST else wanted  # else the texts are shuffled
    found = texts.withColumnRenamed("doc", "of").join(wanted, F.col("of") == F.col("doc"))
    values = found.select("doc", "wanted", *(template_slots(F.col("text"), c).alias(f"slots{t}") for t, c in kinds.items()))
    value = lambda t: F.get(f"slots{t}", F.col("w.p") + F.col("w.diagonal"))["value"]
    pairs = values.select("*", F.explode("wanted").alias("w")).select("doc", "w.*", (F.when(F.col("w.template") == 1, value(1)).otherwise(value(2)) if capitals else value(1)).alias("ours"))
    forth = pairs.groupBy("doc", "item", "template", "diagonal", "theirs").agg(F.min("ours").alias("low"), F.max("ours").alias("high"))
    # One to one: each of their values has one of ours, and as many different ones of ours as of theirs.
    judged = forth.groupBy("doc", "item", "template", "diagonal").agg((F.max((F.col("low") != F.col("high")).cast("int")) == 0).alias("one"), F.count("*").alias("n"), F.countDistinct("low").alias("m")).select(F.col("doc").alias("d"), F.col("item").alias("t"), F.col("template").alias("k"), F.col("diagonal").alias("g"), (F.col("one") & (F.col("n") == F.col("m"))).alias("consistent"))
    counted = hits.groupBy("doc", "item", "template", "diagonal").agg(F.collect_list("i").alias("places"))
    met = counted.join(judged, (F.col("doc") == F.col("d")) & (F.col("item") == F.col("t")) & (F.col("template") == F.col("k")) & (F.col("diagonal") == F.col("g")), "left")
    return met.select("doc", "item", "template", "diagonal", "places", F.coalesce("consistent", F.lit(True)).alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.3, least_windows: int = 8, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", capitals: bool = True, between: Between | None = None) -> DataFrame:
    """(doc, item, covered, windows, first) of each leak: consistent alignments cover enough of the item's windows.

    doc is the row's name, see _row(): rows that share an id, or have none, are judged one by one. A window that a text
    repeats counts once; first counts those covered in the first template. Enough is the share least_share and at least
    least_windows windows, or the whole item if it has fewer. Null texts and null items never match. An item of fewer than
    WIDTH words leaks only to a text that is just its words. An empty table on either side gives no rows.
    """
    sizes = benchmark.select(F.col(item_column).alias("item"), template_words(F.col("text").cast("string")).alias("words")).where("words is not null and item is not null")
    sizes = sizes.groupBy("item").agg(F.max(F.greatest(F.size("words") - WIDTH + 1, F.least(F.size("words"), F.lit(1)))).alias("windows"))
    met = alignments(docs, benchmark, id_column, text_column, item_column, capitals, between).where("consistent")
    met = met.select("doc", "item", (F.col("template") == 1).cast("bigint").alias("first"), F.explode("places").alias("i")).groupBy("doc", "item", "i").agg(F.max("first").alias("first"))
    met = met.groupBy("doc", "item").agg(F.count("*").alias("covered"), F.sum("first").alias("first"))
    leaks = met.join(sizes, "item").select("doc", "item", "covered", F.col("windows").cast("bigint").alias("windows"), "first")
    return leaks.where((F.col("covered") >= least_share * F.col("windows")) & ((F.col("covered") >= least_windows) | (F.col("covered") == F.col("windows"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, all columns, that have no leak, as often as they came; rows with null texts are kept.

    Of rows that share an id only those with a leak go.
    """
    between = Between(docs.sparkSession)
    leaks, _ = stored(contaminated(docs, benchmark, id_column=id_column, text_column=text_column, between=between, **options).select(F.col("doc").alias("__leaked")).distinct(), "leaks")
    between.drop()
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_MOST else leaks
    return docs.join(leaks, _row(id_column, text_column) == F.col("__leaked"), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row for each row of docs: id, contaminated, n_items, items (item ids in order, comma-joined), n_windows.

    Leaks are found in both templates; n_windows counts the windows covered in the first. Rows that share an id each have
    their own result.
    """
    between = Between(docs.sparkSession)
    leaks = contaminated(docs, benchmark, id_column=id_column, text_column=text_column, between=between, **options)
    by_doc = leaks.groupBy("doc").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item")), lambda x: x.cast("string")), ",").alias("items"), F.sum("first").alias("n_windows"))
    by_doc, _ = stored(by_doc, "leaks")
    between.drop()
    by_doc = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_MOST else by_doc
    joined = docs.select(F.col(id_column), _row(id_column, text_column).alias("__row")).join(by_doc, F.col("__row") == F.col("doc"), "left")
    return joined.select(id_column, (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"))
