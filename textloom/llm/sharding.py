"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets by a seeded hash, so many that each fits in a
task's memory.  Bucket b is partition b of this one exchange, so the generator of pass two, which
Spark seeds with seed + partition, is a generator for each bucket: every bucket is put in an order
that depends on its rows alone and shuffled by itself (Fisher-Yates).  Buckets follow each other;
shards are equal stretches of this order, so their row counts are at most one apart, whatever the
ids, sources or texts.  The order depends on the rows and the seed, not on how the input is dealt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import col, fresh, partitions, written

#: Rows and bytes of a bucket in the mean, and the most buckets; beyond that they grow.
BUCKET_ROWS, BUCKET_BYTES, MOST_BUCKETS = 4096, 4 << 20, 100_000
#: A row that is there more often is scattered over all buckets by its number among the equal ones.
OFTEN = 1024


def _bucket(h: Column, nth: Column | None, buckets: int) -> Column:
    return F.pmod(h if nth is None else F.xxhash64(h, nth), F.lit(buckets)).cast("int")


def _stretches(n: Column, step: int) -> Column:
    """0 to n - 1 in stretches of step: (begin, end)."""
    return F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / step)), lambda i: F.struct((i * step).alias("begin"), (F.least(n, (i + 1) * step) - 1).alias("end"))))


def _numbers(begin: Column, end: Column) -> Column:
    return F.explode(F.sequence(begin, end))


def _places(counts: DataFrame) -> DataFrame:
    """(bucket, n) to (bucket, start): sums of what is in the buckets before, over groups of a thousand and then within them."""
    sizes = counts.withColumn("part", F.floor(F.col("bucket") / 1000))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("g")).select("part", (F.sum("g").over(W.orderBy("part")) - F.col("g")).alias("ahead"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("bucket")) - F.col("n")
    return sizes.withColumn("inside", inside).join(parts, "part").select("bucket", (F.col("ahead") + F.col("inside")).alias("start"))


def shuffled(rows: DataFrame, shards: int, seed: int = 10, bucket_rows: int | None = None) -> DataFrame:
    """(h1, h2, row, size) to (row, shard, slot), in order of place.

    h1 and h2 are seeded hashes of all that tells rows apart; rows that agree in both may change
    places.  size: a row's bytes.  A bucket holds BUCKET_BYTES in the mean at most, and bucket_rows
    where they are given.
    """
    spark = rows.sparkSession
    keys = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    total = keys.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("n").alias("most")).first()
    n = total["n"] or 0
    by_rows, by_bytes = math.ceil(n / bucket_rows) if bucket_rows else 1, math.ceil((total["size"] or 0) / BUCKET_BYTES)
    buckets = max(1, min(max(by_rows, by_bytes), MOST_BUCKETS))
    counts = keys.where(F.col("n") <= OFTEN).select(_bucket(F.col("h1"), None, buckets).alias("bucket"), "n")
    held = rows.select(_bucket(F.col("h1"), None, buckets).alias("bucket"), "h1", "h2", "row")
    if (total["most"] or 0) > OFTEN:
        often = keys.where(F.col("n") > OFTEN).select("h1", "h2")
        copies = keys.where(F.col("n") > OFTEN).select("h1", _stretches(F.col("n"), OFTEN).alias("s")).select("h1", _numbers(F.col("s.begin"), F.col("s.end")).alias("nth"))
        counts = counts.union(copies.select(_bucket(F.col("h1"), F.col("nth"), buckets).alias("bucket"), F.lit(1).cast("bigint").alias("n")))
        # One row stands for its copies until a stretch of them is dealt out.
        one = rows.join(often, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"), F.count("*").alias("n"))
        one = one.select("h1", "h2", "row", _stretches(F.col("n"), OFTEN).alias("s")).repartition(partitions(spark), "h1", "s.begin").select("h1", "h2", "row", _numbers(F.col("s.begin"), F.col("s.end")).alias("nth"))
        held = held.join(often, ["h1", "h2"], "left_anti").select("bucket", "h1", "h2", "row").union(one.select(_bucket(F.col("h1"), F.col("nth"), buckets).alias("bucket"), "h1", "h2", "row"))
    starts = _places(counts.groupBy("bucket").agg(F.sum("n").alias("n")))
    # A bucket's start comes with its rows; it sorts first and holds no row.
    nothing = F.lit(None)
    both = held.withColumn("start", nothing.cast("bigint")).unionByName(starts.select("bucket", nothing.cast("bigint").alias("h1"), nothing.cast("bigint").alias("h2"), nothing.cast(rows.schema["row"].dataType).alias("row"), "start"))
    both = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "h1", "h2")
    groups = both.groupBy("bucket").agg(F.max("start").alias("start"), F.collect_list("row").alias("rows"))
    out = groups.withColumn("rows", F.shuffle("rows", F.lit(seed))).select("start", F.posexplode("rows").alias("at", "row")).select((F.col("start") + F.col("at")).alias("place"), "row")
    shard = F.floor((F.col("place") * shards).cast("decimal(38,0)") / F.lit(max(n, 1))).cast("int")
    begin = F.ceil((F.col("shard").cast("bigint") * n).cast("decimal(38,0)") / F.lit(shards)).cast("bigint")
    return out.withColumn("shard", shard).select("row", "shard", (F.col("place") - begin).alias("slot"))


def shard_index(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 10, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    The shards are written with all columns, a folder for each, and the rows are told from what is
    read back.  size: UTF-8 bytes of the text (null: none) plus 1.  law: `rows`.  slot: the row's
    place in its shard, from 0 without gaps.  Null ids, null texts and repeated rows are rows like
    all others; an empty table gives an empty one.
    """
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    out = written(sharded(docs, shards, seed, bucket_rows), shard)
    text = F.encode(F.coalesce(col(text_col).cast("string"), F.lit("")), "UTF-8")
    size = (F.octet_length(text) + 1).cast("bigint").alias("size")
    return out.select(col(id_col), size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 10, bucket_rows: int | None = None) -> DataFrame:
    """docs in shard order, all columns and shard, slot (with underscores where the names are taken).

    Whole rows are scattered once, into buckets by the size of their text and binary columns, of
    bucket_rows in the mean at most.  Equal rows and nulls are rows like all others; an empty table
    stays empty.
    """
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    values = [F.to_json(F.struct(col(c))) if "map" in t or "variant" in t else col(c) for c, t in docs.dtypes]
    size = sum((F.coalesce(F.octet_length(col(c)), F.lit(0)) for c, t in docs.dtypes if t in ("string", "binary")), F.lit(8 * len(values))).cast("bigint")
    # Nulls and their places count: the hash alone skips them.
    gaps = F.array(*(col(c).isNull() for c in docs.columns))
    hashed = [F.xxhash64(F.lit(seed + s), *values, gaps).alias(f"h{s + 1}") for s in range(2)]
    out = shuffled(docs.select(*hashed, F.struct(*(col(c) for c in docs.columns)).alias("row"), size.alias("size")), shards, seed, bucket_rows)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("shard").alias(shard), F.col("slot").alias(slot))
