"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Vectors are lengthened by one component so that the largest inner product is the smallest angle
(the usual reduction: sqrt(longest norm**2 - norm**2); queries get 0).  This is done in bands of
norm, each at most twice as long as its shortest, so that a few long vectors do not turn all others
to one side.  Each of TREES trees of a band hashes them to 64 sign bits of random directions; a tree
is the sorted array of these strings, cut into tasks by its first bits and, where many vectors share
them, by blocks of vectors.

A query first learns how many vectors share its first d bits, for every d in every tree (for prefixes
shorter than those that the tasks are cut by, from the sizes of these).  It then goes down to the
longest prefixes and comes up in all trees at once, one bit at a time, until the vectors met, summed
over the trees, reach a budget; all of these are scored exactly, in double precision, on the original
vectors.

The budget is fitted: FITTED queries (the first by a hash of their ids) are compared with all
vectors, and it is the least with which GOAL of their neighbours are met.  Vectors without any
structure are the hardest: what the trees meet is then nearly independent, and a recall of 0.9 needs
about half of all vectors; the work then grows with the number of queries times that of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .shared import col, partitions, written

TREES, DEPTH = 24, 64
#: Queries that the budget is fitted on at most, and the share of their neighbours that it must meet.
FITTED, GOAL = 256, 0.93
#: The budget is this many times the wanted neighbours at least: each of them can be met in all trees, and the query itself too.
LEAST = 2 * TREES
#: Bands of norm at most; the last one holds all that is shorter.
BANDS = 8
#: Vectors that a task holds of one tree at once.
BLOCK = 4096


def _directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((TREES * DEPTH, dim + 1))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _hashed(batches: Iterator[pa.RecordBatch], dim: int, longest: dict[int, float], seed: int, query: bool) -> Iterator[pa.RecordBatch]:
    directions = _directions(dim, seed)
    weights = np.uint64(1) << np.arange(DEPTH - 1, -1, -1, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _vectors(batch.column("v"))
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, np.array([longest[b] for b in batch.column("band").to_pylist()]) ** 2 - (v**2).sum(axis=1)))
        bits = np.hstack([v, extra[:, None]]) @ directions.T >= 0
        strings = (bits.reshape(len(v), TREES, DEPTH) * weights).sum(axis=2, dtype=np.uint64)
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * TREES).astype(np.int32)), pa.array(strings.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("band"), lists], ["id", "v", "band", "strings"])


def _shared_bits(sorted_strings: np.ndarray, query: np.uint64, floor: int) -> np.ndarray:
    """How many strings share the first d bits of query, for d from floor to DEPTH."""
    d = np.arange(floor, DEPTH + 1, dtype=np.uint64)
    ones = np.where(d == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(DEPTH) - np.maximum(d, 1).astype(np.uint64))) - np.uint64(1))
    low, high = query & ~ones, query | ones
    return np.searchsorted(sorted_strings, high, "right") - np.searchsorted(sorted_strings, low, "left")


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    asks = np.asarray(table.column("asks"))
    return table.filter(pa.array(~asks)), table.filter(pa.array(asks))


def _counts(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    for table in K.grouped(batches, "tree", "prefix", "block"):
        rows, queries = _split(table)
        if not queries.num_rows:
            continue
        strings = np.sort(np.asarray(rows.column("string")).view(np.uint64))
        counts = np.array([_shared_bits(strings, q, floor) for q in np.asarray(queries.column("string")).view(np.uint64)], np.int64)
        yield pa.RecordBatch.from_arrays([queries.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array((np.arange(len(counts) + 1) * counts.shape[1]).astype(np.int32)), pa.array(counts.reshape(-1)))], ["query_id", "counts"])


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for table in K.grouped(batches, "tree", "prefix", "block"):
        rows, queries = _split(table)
        if not (queries.num_rows and rows.num_rows):
            continue
        strings = np.asarray(rows.column("string")).view(np.uint64)
        order = np.argsort(strings, kind="stable")
        strings, ids = strings[order], np.asarray(rows.column("id"))[order]
        v = _vectors(rows.column("v").combine_chunks())[order]
        asked = _vectors(queries.column("v").combine_chunks())
        out = [], [], []
        for own, q, string, depth in zip(np.asarray(queries.column("id")), asked, np.asarray(queries.column("string")).view(np.uint64), np.asarray(queries.column("depth")), strict=True):
            ones = ~np.uint64(0) if depth == 0 else (np.uint64(1) << np.uint64(DEPTH - depth)) - np.uint64(1)
            a, b = np.searchsorted(strings, string & ~ones, "left"), np.searchsorted(strings, string | ones, "right")
            if a == b:
                continue
            found, rows_met = ids[a:b], v[a:b]
            other = found != own
            if len(found) > k + 1:
                # The fast product only says who can be among the k best: its error is far below slack.
                score = np.where(other, rows_met @ q, -np.inf)
                least = np.partition(score, len(score) - k)[len(score) - k]
                slack = 1e-12 * len(q) * np.abs(rows_met).max() * np.abs(q).max()
                other &= score >= least - slack
            found = found[other]
            # One product at a time, in the order of the components: the score depends on nothing else.
            score = np.add.accumulate(rows_met[other] * q, axis=1)[:, -1]
            top = np.lexsort((found, -score))[:k]
            out[0].append(np.full(len(top), own))
            out[1].append(found[top])
            out[2].append(score[top])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])


def _compared(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task, the k best of each query."""
    best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    for batch in batches:
        if not batch.num_rows:
            continue
        mine = batch.column("id").to_numpy()
        score = asked @ _vectors(batch.column("v")).T
        score[ids[:, None] == mine[None, :]] = -np.inf
        best_id, best = np.hstack([best_id, np.broadcast_to(mine, score.shape)]), np.hstack([best, score])
        if best.shape[1] > k:
            top = np.argpartition(-best, k - 1, axis=1)[:, :k]
            best_id, best = np.take_along_axis(best_id, top, 1), np.take_along_axis(best, top, 1)
    if best.size:
        good = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])[good.reshape(-1)]), pa.array(best_id[good]), pa.array(best[good])], ["query_id", "vec_id", "score"])


def _budget(rows: DataFrame, index: DataFrame, asked: DataFrame, met: DataFrame, k: int) -> float:
    """The least number of vectors met with which GOAL of the neighbours of the fitted queries are."""
    fitted = rows.where("asks").orderBy(F.xxhash64("id"), "id").limit(FITTED).select("id", "v").collect()
    if not fitted:
        return 0.0
    ids, v = np.array([r["id"] for r in fitted], np.int64), np.array([r["v"] for r in fitted], np.float64)
    best = rows.select("id", "v").mapInArrow(lambda it: _compared(it, ids, v, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id"))
    theirs = index.select(F.col("id").alias("vec_id"), "tree", F.col("string").alias("x")).join(truth, "vec_id")
    both = theirs.join(asked.select(F.col("id").alias("query_id"), "tree", F.col("string").alias("y")), ["query_id", "tree"])
    differ = F.col("x").bitwiseXOR(F.col("y"))
    common = F.when(differ == 0, F.lit(DEPTH)).otherwise(DEPTH - F.length(F.bin(differ)))
    deepest = both.groupBy("query_id", "vec_id").agg((F.max(common) + 1).alias("d"))
    # A pair is met if one bit deeper too few vectors are.
    need = sorted(r["n"] + 1 for r in deepest.join(met, ["query_id", "d"], "left").select(F.coalesce("n", F.lit(0)).alias("n")).collect())
    return float(need[min(len(need) - 1, int(GOAL * len(need)))]) if need else 0.0


def _search(vectors: DataFrame, query: str, k: int, id_col: str, vec_col: str, seed: int, keep: int) -> DataFrame:
    """(query_id, vec_id, score) of the vectors that are scored for k neighbours, at least the keep best of each block."""
    spark = vectors.sparkSession
    v = col(vec_col)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # Single-precision components stay so on disk; all sums are of doubles.
    kind = "array<float>" if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where(col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    rows = rows.select(col(id_col).cast("bigint").alias("id"), v.cast(kind).alias("v"), F.expr(query).alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Of several vectors of an id the smallest counts, component by component.
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("norm", norm))
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id bigint, vec_id bigint, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, n = shape["dim"], shape["n"]
    band = F.least(F.lit(BANDS - 1), F.floor(F.log2(F.lit(float(shape["longest"])) / F.col("norm"))).cast("int"))
    rows = rows.where(F.size("v") == dim).withColumn("band", F.greatest(F.lit(0), band))
    longest = {r["band"]: r["longest"] for r in rows.groupBy("band").agg(F.max("norm").alias("longest")).collect()}
    floor = max(0, int(np.ceil(np.log2(n / (8 * BLOCK))))) if n else 0

    def strings(df: DataFrame, query: bool) -> DataFrame:
        out = df.select("id", "v", "band").mapInArrow(lambda it: _hashed(it, dim, longest, seed, query), f"id bigint, v {kind}, band int, strings array<bigint>")
        if query:
            out = out.withColumn("band", F.explode(F.array(*(F.lit(b) for b in sorted(longest)))))
        out = out.select("id", "v", "band", F.posexplode("strings").alias("tree", "string")).withColumn("tree", F.col("tree") + TREES * F.col("band")).drop("band")
        return out.withColumn("prefix", F.shiftrightunsigned("string", DEPTH - floor) if floor else F.lit(0).cast("bigint"))

    index = written(strings(rows, False))
    asked = written(strings(rows.where("asks"), True))
    # A prefix that many vectors share is dealt out in blocks; its queries go to all of them.
    blocks = written(index.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).alias("blocks")))
    held = index.join(blocks, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks", "size")
    # What shares the first `level` bits, for levels up to floor: all prefixes that begin with them.
    levels = F.explode(F.sequence(F.lit(0), F.lit(floor))).alias("level")
    begin = F.expr(f"shiftright(prefix, {floor} - level)").alias("begin")
    under = blocks.select("tree", "prefix", "size", "blocks", levels).select("tree", "level", begin, "prefix", "size", "blocks")

    def spread(queries: DataFrame) -> DataFrame:
        """Each query (with a level) in all blocks of the prefixes that begin with the first bits of its own."""
        return queries.select("id", "v", "tree", "string", "level", "depth", begin).join(under, ["tree", "level", "begin"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("size", "blocks", "begin", "level")

    def dealt(queries: DataFrame, vectors_too: bool) -> DataFrame:
        pick = ["tree", "prefix", "block", "id", "string", *["v"] * vectors_too]
        both = held.select(*pick, F.lit(0).alias("depth"), F.lit(False).alias("asks")).union(queries.select(*pick, "depth", F.lit(True).alias("asks")))
        return both.repartition(partitions(spark), "tree", "prefix", "block").sortWithinPartitions("tree", "prefix", "block")

    counts = dealt(spread(asked.withColumns({"level": F.lit(floor), "depth": F.lit(0)})), False).mapInArrow(lambda it: _counts(it, floor), "query_id bigint, counts array<bigint>")
    met = counts.select("query_id", F.posexplode("counts").alias("d", "n")).select("query_id", (F.col("d") + floor).alias("d"), "n")
    sizes = under.where(F.col("level") < floor).groupBy("tree", "level", "begin").agg(F.sum("size").alias("n"))
    above = asked.select("id", "tree", "prefix", levels).select(F.col("id").alias("query_id"), "tree", "level", begin).join(sizes, ["tree", "level", "begin"])
    met = written(met.union(above.select("query_id", F.col("level").alias("d"), "n")).groupBy("query_id", "d").agg(F.sum("n").alias("n")))
    budget = max(_budget(rows, index, asked, met, k), LEAST * k)
    deepest = met.groupBy("query_id").agg(F.max(F.when(F.col("n") >= budget, F.col("d"))).alias("deepest"))
    # Where even the root does not hold so many, all vectors are met.
    deep = asked.join(written(deepest), asked["id"] == F.col("query_id"), "left").withColumn("depth", F.coalesce("deepest", F.lit(0)).cast("int"))
    found = dealt(spread(deep.withColumn("level", F.least("depth", F.lit(floor)))), True).mapInArrow(lambda it: _best(it, keep), schema)
    return found.dropDuplicates(["query_id", "vec_id"])


def nearest(vectors: DataFrame, query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every row where the SQL condition query holds.

    All other rows are candidates; ties go to the smaller id; with fewer candidates all that are met
    are returned.  If a query's prefixes hold fewer, it comes up to the root, where all vectors are met.
    Vectors that are null, empty, all zero, hold a null or a non-finite component, or
    differ in length from the most common length take no part, nor do null ids.  Repeated ids count
    once; if their vectors differ, with the smallest, component by component.  Other columns are not looked at.
    """
    found = _search(vectors, query, k, id_col, vec_col, seed, keep=k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
