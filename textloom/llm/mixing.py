"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time 0 to 1, piecewise linear.  The integral of a
schedule, scaled to the source's target, is the number of words of the source that training has
asked for by then.  Documents of a source stand in a seeded order; a document's first word stands at
some offset in its source's words, and the time at which the cumulated demand reaches this offset,
the inverse of the integral, is the document's training position.  Documents are then range-sorted
by position.

Targets: all sources together share `total` times all words by weight; no source gets more than
`most` times what it has, and what is cut off there goes to the others by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import col, partitions, written

#: (time, weight) knots by turns: even demand, rising, falling.  Only the shape counts: a schedule is scaled to its source's target.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Slices of each source by hash, over which running sums are taken first; each slice then has a running sum of its own.
SLICES = 1 << 12


def words(text: Column) -> Column:
    """The number of words of a text (null: 0)."""

    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """(source, source_size) with place, weight and target.

    Sources are ordered by code point, null last.  A source is held at its cap if the level that all
    sources from it on would share reaches the cap, going through them by cap / weight; the rest get
    the level of what remains times their weight.  From the first source that is not held on, levels
    only fall, so the one that holds is the largest of those that stay below their cap.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sources.withColumn("place", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "place")
    rows = rows.withColumn("all_words", F.sum("source_size").over(W.partitionBy()))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("level", (total * F.col("all_words") - F.col("before")) / F.col("rest"))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "place", "weight", "target")


def position(share: Column, place: Column, schedules: tuple[tuple[tuple[float, float], ...], ...] = SCHEDULES) -> Column:
    """The time at which a source's demand reaches this share of its target: the inverse of its schedule's integral."""
    out = F.lit(None).cast("double")
    for s, knots in enumerate(schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        whole, done = sum(areas), 0.0
        time = F.lit(float(knots[-1][0]))
        for (t0, w0), (t1, w1), area, past in reversed([(a, b, x, sum(areas[:i])) for i, (a, b, x) in enumerate(zip(knots, knots[1:], areas, strict=False))]):
            need = share * whole - past
            slope = (w1 - w0) / (t1 - t0)
            # w0 * t + slope / 2 * t**2 = need, in the form that also holds for a slope of 0.
            inner = 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)))
            time = F.when(need <= area, F.greatest(F.lit(0.0), inner) + t0).otherwise(time)
        out = F.when(place % len(schedules) == s, time).otherwise(out)
    return F.least(F.lit(1.0), out)


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], total: float, most: float, schedules: tuple) -> DataFrame:
    """(id, source, size, tie, source_size, target, taken, positions): of every row, also when each of its turns begins."""
    key = F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")))
    rows = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), words(col(text_col).cast("string")).alias("size"), key.alias("key"), _tie(text_col).alias("tie"))
    rows = written(rows.withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    slices = written(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    aims = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, total, most)
    ahead = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    starts = slices.withColumn("ahead", ahead).withColumnRenamed("source", "s").join(aims, F.col("s").eqNullSafe(F.col("source"))).select("s", "slice", "ahead", "source_size", "target", "place")
    starts = written(starts)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (rows["slice"] == starts["slice"])).drop(starts["slice"])
    inside = F.sum("size").over(W.partitionBy("source", "slice").orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    rows = rows.withColumn("offset", F.col("ahead") + inside)
    passes = int(most) + (most > int(most))
    begins = [F.col("offset") + p * F.col("source_size") for p in range(passes)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - b)) for b in begins]
    turns = F.array(*(F.when(part > 0, position(b / F.nullif(F.col("target"), F.lit(0.0)), F.col("place"), schedules)) for b, part in zip(begins, parts, strict=True)))
    return rows.select("id", "source", "size", "tie", "source_size", "target", sum(parts, F.lit(0)).cast("bigint").alias("taken"), F.array_compact(turns).alias("positions"))


def _tie(text_col: str) -> Column:
    return F.xxhash64(col(text_col).cast("string"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """(id, source, size, source_size, target, taken, position) for every row of docs.

    size: the text's words (null: 0).  taken: how many of its words the mix takes, repeats counted:
    a source's documents follow each other in an order fixed by a hash of their ids (ties: by text),
    as often as it takes to reach the target, rounded down; the last document may be taken in part.
    position: when its first word is asked for (null if it is not taken).  A null source is a source
    of its own and stands last.  Null ids and repeated rows are rows like all others.  Sources
    without words get the target 0.  The result is range-sorted by position.
    """
    rows = _placed(docs, id_col, source_col, text_col, weights, total, most, schedules)
    out = rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return out.repartitionByRange(partitions(docs.sparkSession), "position", id_col).sortWithinPartitions("position", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES, position_col: str | None = None) -> DataFrame:
    """The documents of the mix, with all their columns, in the order of training.

    A document has one row for each time that it is begun, each at a position of its own; rows are
    range-sorted by it, and position_col (None: no such column) holds it.  Documents of which the
    mix takes nothing go.  Rows that agree in id and text are all taken as often as the one of them
    that is taken most.  An empty table stays empty.
    """
    taken = _placed(docs, id_col, source_col, text_col, weights, total, most, schedules).where("taken > 0")
    taken = taken.groupBy(F.col("id").alias("_mix_id"), F.col("tie").alias("_mix_tie")).agg(F.max(F.struct("taken", "positions")).alias("_mix"))
    held = docs.join(taken, col(id_col).eqNullSafe(F.col("_mix_id")) & (_tie(text_col) == F.col("_mix_tie")))
    held = held.select(*(col(c) for c in docs.columns), F.explode("_mix.positions").alias("_mix_at"))
    # Demand over all sources is spread over time, so equal stretches of it are near equal parts.
    n = partitions(docs.sparkSession)
    stretch = F.least(F.floor(F.col("_mix_at") * n), F.lit(n - 1)).cast("int")
    held = held.repartitionById(n, stretch).sortWithinPartitions("_mix_at", col(id_col))
    return held.select(*(col(c) for c in docs.columns), *([F.col("_mix_at").alias(position_col)] if position_col else []))
