"""Benchmark decontamination by templates.

Texts are reduced to words (letters, marks, digits); numbers, words that begin with a capital and
units after numbers become the placeholders <num>, <name> and <unit>.  Windows of template words of
the benchmark are hash-joined with those of the documents.  Where windows of an item match a
document along one diagonal (same distance of positions), each value in the item's slots must stand
for one value in the document throughout: a question asked again with other numbers or names
matches, an accidental likeness of templates does not.  Where they do not, only windows that equal
the item word for word count.

All this is done in two views: of the text as it is, and of the text in lower case, where no word is
a name.  A copy in capitals or in lower case is found in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, written

UNITS = "km|m|cm|mm|mi|ft|kg|g|mg|lb|oz|l|ml|h|hours?|min|minutes?|s|sec|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|eur|usd"
WINDOW, LITERALS, COVERED = 8, 4, 13
#: Benchmark windows that are broadcast at most (about 300 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def base_words(text: Column) -> Column:
    """The text's words with one space between, "3.5km" as "35 km"."""
    out = F.regexp_replace(text, r"([0-9])[.,]([0-9])", "$1$2")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.regexp_replace(out, rf"([0-9])({UNITS})( |$)", "$1 $2$3")


def template(base: Column) -> Column:
    """base with placeholders, as many words as before."""
    out = F.regexp_replace(base, rf"([0-9]) ({UNITS})( |$)", "$1 <unit>$3")
    out = F.regexp_replace(out, r"(^| )\p{Lu}[^ ]*", "$1<name>")
    return F.lower(F.regexp_replace(out, r"(^| )[0-9][^ ]*", "$1<num>"))


def _views(rows: DataFrame) -> DataFrame:
    """rows twice: in view 0 with the text as it is, in view 1 in lower case."""
    out = rows.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.withColumn("text", F.when(F.col("view") == 0, F.col("text")).otherwise(F.lower("text")))


def _windows(rows: DataFrame) -> DataFrame:
    """rows (with text) with base and slots, split to words, and a row for each window start `at`."""
    words = rows.withColumn("base", base_words(F.coalesce("text", F.lit("")))).withColumn("slots", template(F.col("base")))
    words = words.withColumns({"base": F.split("base", " "), "slots": F.split("slots", " ")}).drop("text")
    # The outer form keeps the words from being worked out twice, for a filter and for the windows.
    starts = F.when(F.size("slots") >= WINDOW, F.sequence(F.lit(1), F.size("slots") - WINDOW + 1))
    return words.withColumn("at", F.explode_outer(starts))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, tag, text) and (item, text) to (id, tag, view, item, item_words, diagonal, place, slot, item_value, value, exact): the words of all matching windows; exact if the window equals the item word for word."""
    docs, benchmark = _views(docs), _views(benchmark)
    cut = lambda c: F.slice(c, F.col("at"), WINDOW)
    items = _windows(benchmark).where("at is not null").select("view", "item", F.size("slots").alias("item_words"), F.col("at").alias("item_at"), cut("slots").alias("item_slots"), cut("base").alias("item_values"))
    items = items.withColumn("h", F.xxhash64("view", "item_slots")).where(F.size(F.filter("item_slots", lambda x: ~x.startswith("<"))) >= LITERALS)
    items = written(items)
    own = _windows(docs).withColumn("h", F.xxhash64("view", cut("slots")))
    if items.count() <= BROADCAST_WINDOWS:
        found = own.join(F.broadcast(items), ["h", "view"]).where(cut("slots") == F.col("item_slots")).withColumn("values", cut("base"))
    else:
        # Only hashes are shuffled; the words of the documents that match come by a second join.
        narrow = own.where("at is not null").select("id", "tag", "view", "at", "h").join(items, ["h", "view"])
        hit = narrow.select(F.col("id").alias("h_id"), F.col("tag").alias("h_tag"), F.col("view").alias("h_view")).distinct()
        words = docs.join(hit, docs["id"].eqNullSafe(hit["h_id"]) & (docs["tag"] == hit["h_tag"]) & (docs["view"] == hit["h_view"]), "left_semi")
        words = words.withColumn("base", base_words(F.coalesce("text", F.lit("")))).select("id", "tag", "view", F.split("base", " ").alias("base"), F.split(template(F.col("base")), " ").alias("slots"))
        words = words.dropDuplicates(["id", "tag", "view"]).withColumnsRenamed({"id": "w_id", "tag": "w_tag", "view": "w_view"})
        found = narrow.join(words, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tag") == F.col("w_tag")) & (F.col("view") == F.col("w_view"))).where(cut("slots") == F.col("item_slots")).withColumn("values", cut("base"))
    found = found.select("id", "tag", "view", "item", "item_words", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), (F.col("values") == F.col("item_values")).alias("exact"), F.posexplode(F.arrays_zip("item_slots", "item_values", "values")).alias("i", "w"))
    return found.select("id", "tag", "view", "item", "item_words", "diagonal", (F.col("item_at") + F.col("i")).alias("place"), F.col("w.item_slots").alias("slot"), F.col("w.item_values").alias("item_value"), F.col("w.values").alias("value"), "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, tag, n_items, most_covered) of the documents that hold benchmark text; tag is a hash of the text.

    An item is held if in one of the views consistent diagonals, and exact windows on others, cover COVERED of its
    words, or half of them if that is less (a window at least).  Null and empty texts, and items of fewer words than a window, hold
    nothing.  Null ids are ids; rows that repeat an id are told apart by their text.
    """
    own = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col).cast("string")).alias("tag"), col(text_col).cast("string").alias("text"))
    items = benchmark.select(col(item_col).alias("item"), col(item_text_col).cast("string").alias("text"))
    places = matches(own, items).groupBy("id", "tag", "view", "item", "item_words", "diagonal", "place").agg(F.min("slot").alias("slot"), F.min("item_value").alias("item_value"), F.min("value").alias("value"), F.bool_or("exact").alias("exact"))
    held = F.when(F.col("slot").startswith("<"), F.concat("slot", "item_value"))
    slots = places.groupBy("id", "tag", "view", "item", "item_words", "diagonal", held.alias("held")).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), (F.col("held").isNull() | (F.min("value") == F.max("value"))).alias("same"))
    lines = slots.groupBy("id", "tag", "view", "item", "item_words", "diagonal").agg(F.when(F.bool_and("same"), F.sum("n")).otherwise(F.sum("exact")).alias("n"))
    per_item = lines.groupBy("id", "tag", "view", "item", "item_words").agg(F.sum("n").alias("n"))
    per_item = per_item.where(F.col("n") >= F.greatest(F.lit(WINDOW), F.least(F.lit(COVERED), F.ceil(F.col("item_words") / 2))))
    per_item = per_item.groupBy("id", "tag", "item").agg(F.max("n").alias("n"))
    return per_item.groupBy("id", "tag").agg(F.count("*").alias("n_items"), F.max("n").alias("most_covered"))


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """(id, contaminated, n_items, most_covered) for every row of docs."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    rows = docs.select(col(id_col).alias(id_col), F.xxhash64(col(text_col).cast("string")).alias("_tag"))
    out = rows.join(found, rows[id_col].eqNullSafe(found["id"]) & (rows["_tag"] == found["tag"]), "left")
    return out.select(rows[id_col], F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("most_covered", F.lit(0)).cast("bigint").alias("most_covered"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """The rows of docs that hold no benchmark text, with all their columns."""
    found = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("_held"), F.col("tag").alias("_tag"))
    return docs.join(found, docs[id_col].eqNullSafe(found["_held"]) & (F.xxhash64(docs[text_col].cast("string")) == found["_tag"]), "left_anti")
