"""b-bit MinHash near-duplicates.

Every document's distinct word shingles get a signature of minima under PERMS random
permutations.  Bands of whole minima give candidate buckets; of each minimum only the low BITS bits
are kept and packed into longs.  Candidates are filtered by the collision-corrected similarity,
(matching share - 2**-BITS) / (1 - 2**-BITS), counted with bit operations inside the join, and the
rest are verified on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .linking import components, link
from .shared import col, drop, partitions, written

PERMS, BITS, ROWS = 128, 2, 4
BANDS = PERMS // ROWS
LONGS = PERMS * BITS // 64
#: Spread of the estimate at the threshold, times five: fewer than one link in a million is lost by it.
SLACK = 5

_RNG = np.random.default_rng(8)
_MUL = _RNG.integers(1, 2**63, PERMS, dtype=np.uint64) * K.U(2) + K.U(1)
_ADD = _RNG.integers(1, 2**63, PERMS, dtype=np.uint64)


def signatures(name: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of PERMS minima for each set (sets must not be empty)."""
    out = np.empty((len(bounds) - 1, PERMS), np.uint64)
    for p in range(PERMS):
        x = name * _MUL[p] + _ADD[p]
        x ^= x >> K.U(32)
        x *= K.U(0x9E3779B97F4A7C15)
        out[:, p] = np.minimum.reduceat(x, bounds[:-1])
    return out


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.chunks(whole):
            name, bounds = K.sets(K.words(batch.column("text"), lower=True), k)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            bands, packed = np.zeros((len(size), BANDS), np.uint64), np.zeros((len(size), LONGS), np.uint64)
            total, other = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            if len(full):
                minima = signatures(name, np.append(bounds[:-1][full], bounds[-1]))
                key = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    key = K.mix(key * K.U(0xD6E8FEB86659FD93) + minima[:, r::ROWS])
                bands[full] = K.mix(key + np.arange(BANDS, dtype=np.uint64))
                low = K.mix(minima) & K.U(2**BITS - 1)
                per = 64 // BITS
                for j in range(LONGS):
                    packed[full, j] = np.bitwise_or.reduce(low[:, j * per : (j + 1) * per] << (np.arange(per, dtype=np.uint64) * K.U(BITS)), axis=1)
                total[full] = np.add.reduceat(K.mix(name), bounds[:-1][full])
                other[full] = np.bitwise_xor.reduceat(K.mix(name + K.U(0x1234567)), bounds[:-1][full])
            cut = lambda x: K.lists(x.reshape(-1), np.arange(len(size) + 1) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(size.astype(np.int64)), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), cut(bands), cut(packed)], ["id", "tag", "n", "h1", "h2", "bands", "packed"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.chunks(whole):
            name, bounds = K.sets(K.words(batch.column("text"), lower=True), k)
            data = name.tobytes()
            offsets = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])], ["id", "names"])


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= percent * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def most_different(percent: int) -> int:
    """The most bit groups in which packed signatures of a link may differ."""
    s = percent / 100
    c = s + (1 - s) * 2.0**-BITS
    least = max(0.0, c - SLACK * (c * (1 - c) / PERMS) ** 0.5)
    return int((1 - least) * PERMS) + 1


_EVEN = int("01" * 32, 2)


def estimated(percent: int, x: str, y: str) -> Column:
    """The condition that the corrected estimate of rows x and y (of n and packed) may belong to a link."""
    differ: Column = F.lit(0)
    for j in range(LONGS):
        z = F.col(f"{x}.packed")[j].bitwiseXOR(F.col(f"{y}.packed")[j])
        differ = differ + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(_EVEN)))
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ <= most_different(percent))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [(np.frombuffer(x.as_buffer(), np.uint64) >> K.U(32)).astype(np.uint32).tobytes() for x in batch.column("names")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(short, pa.binary())], ["id", "short"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each group (key, block, row block): for each row that asks, one probable link to each other component."""
    most = most_different(percent)
    wide = lambda t, c, w: t.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, w)
    for table in K.grouped(batches, "key", "block", "asking"):
        asks = np.asarray(table.column("asks"))
        if asks.all() or not asks.any():
            continue
        key = np.uint64(table.column("key")[0].as_py() & (1 << 64) - 1)
        ids, part, main, n = (np.asarray(table.column(c)) for c in ("id", "part", "main", "n"))
        packed, bands = wide(table, "packed", LONGS), wide(table, "bands", BANDS)
        short = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("short").combine_chunks()]
        codes = np.unique(np.concatenate(short), return_inverse=True)[1]
        ends = np.cumsum([len(x) for x in short])
        codes = np.split(codes, ends[:-1])
        flags = np.zeros(max((int(c.max()) for c in codes), default=0) + 1, bool)
        rows = np.flatnonzero(~asks)
        band = int(np.flatnonzero(bands[rows[0]] == key)[0])
        out = [], []
        for o in np.flatnonzero(asks):
            z = packed[rows] ^ packed[o]
            differ = np.bitwise_count((z | z >> K.U(1)) & K.U(_EVEN)).sum(axis=1)
            good = (part[rows] != part[o]) & ((part[rows] == main[o]) | (ids[rows] < ids[o])) & (differ <= most)
            good &= 100 * np.minimum(n[rows], n[o]) >= percent * np.maximum(n[rows], n[o])
            # Each pair is looked at in the first band that it shares.
            good &= ~(bands[rows, :band] == bands[o, :band]).any(axis=1)
            near = rows[good]
            if not len(near):
                continue
            flags[codes[o]] = True
            size = np.array([len(codes[r]) for r in near])
            common = np.add.reduceat(flags[np.concatenate([codes[r] for r in near])], np.append(0, np.cumsum(size)[:-1]), dtype=np.int64)
            flags[codes[o]] = False
            near = near[100 * common >= percent * (n[near] + n[o] - common)]
            _, one = np.unique(part[near], return_index=True)
            for r in near[one]:
                out[0].append(max(ids[o], ids[r]))
                out[1].append(min(ids[o], ids[r]))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in out], ["a", "b"])


#: Rows of one bucket that a task compares at once.
BLOCK = 2048


def near_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, tag, n, lead_id, lead_tag) for every row of docs: the first id, and of its texts the first tag, in the row's component (null: no links)."""
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    sketch = written(rows.mapInArrow(lambda it: _sketch(it, shingle), "id bigint, tag bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>, packed array<bigint>"))
    used = sketch.where("n > 0 and id is not null")
    # A class is named by its smallest id, or by a hash if other classes have the same (an id with several texts).
    classes = written(used.groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "tag")).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"), F.first("packed").alias("packed")).select("n", "h1", "h2", F.col("first.id").alias("id"), F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag"), "weight", "bands", "packed"))
    several = written(classes.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id"))
    if not several.isEmpty():
        named = classes.join(several.withColumn("several", F.lit(True)), "id", "left")
        named = named.withColumn("id", F.when(F.col("several"), F.xxhash64("id", "n", "h1", "h2")).otherwise(F.col("id"))).select(*classes.columns)
        plain, classes = classes, written(named)
        drop(plain)
    members = classes.select(F.explode("bands").alias("key"), "id", "weight")
    keys = written(members.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p != q").select("key"))
    members = written(members.join(keys, "key"))
    drop(keys, several)
    wanted = members.select("id").distinct().join(classes.select("id", "first_id", "first_tag"), "id")
    wanted = wanted.select(F.col("id").alias("class"), F.col("first_id").alias("id"), F.col("first_tag").alias("tag"))
    full = rows.join(wanted, ["id", "tag"]).select(F.col("class").alias("id"), "text").mapInArrow(lambda it: _full_sets(it, shingle), "id bigint, names binary")
    names = written(full)
    if names.count() > members.select("id").distinct().count():
        names, repeated = written(names.dropDuplicates(["id"])), names
        drop(repeated)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(names.select(F.col("id").alias("a"), F.col("names").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("names").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lambda it: _links(it, percent), pairs.select("a", "b").schema)

    packed = classes.select("id", "n", "packed")

    def checked(pairs: DataFrame) -> DataFrame:
        near = pairs.alias("p").join(packed.alias("x"), F.col("p.a") == F.col("x.id")).join(packed.alias("y"), F.col("p.b") == F.col("y.id"))
        return verify(near.where(estimated(percent, "x", "y")).select("p.a", "p.b"))

    def across(rows: DataFrame) -> DataFrame:
        size = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(F.col("part") != F.col("main")) / BLOCK).alias("askings"))
        payload = classes.join(names.mapInArrow(_short, "id bigint, short binary"), "id").select("id", "n", "packed", "bands", "short")
        rows = written(rows.join(written(size), "key").join(payload, "id"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        held = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("asking", each("askings")).withColumn("asks", F.lit(False))
        asks = rows.where("part != main").withColumn("asking", F.pmod(F.xxhash64("id"), "askings")).withColumn("block", each("blocks")).withColumn("asks", F.lit(True))
        both = held.unionByName(asks).drop("blocks", "askings")
        both = both.repartition(partitions(docs.sparkSession), "key", "block", "asking").sortWithinPartitions("key", "block", "asking")
        return both.mapInArrow(lambda it: _across(it, percent), "a bigint, b bigint")

    part = written(components(link(members, checked, across)))
    own = written(classes.select("n", "h1", "h2", "id", "first_id", "first_tag"))
    drop(names, classes)
    linked = part.join(own, "id").select("id", "component", F.struct(F.col("first_id").alias("id"), F.col("first_tag").alias("tag")).alias("first"))
    leads = written(linked.groupBy("component").agg(F.min("first").alias("lead")))
    of = own.join(part, "id", "left").join(leads, "component", "left").select("n", "h1", "h2", F.coalesce("lead.id", "first_id").alias("lead_id"), F.coalesce("lead.tag", "first_tag").alias("lead_tag"))
    return sketch.select("id", "tag", "n", "h1", "h2").join(of, ["n", "h1", "h2"], "left").select("id", "tag", "n", *(F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("lead_id", "lead_tag")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Words are lower-cased (A-Z only).  Documents are linked if 100 * intersection >= percent * union
    of their distinct shingles of so many words; with fewer words the whole sequence is one shingle.
    Null or wordless texts have no shingles and no links.  Equal sets are one class from the start,
    so thousands of copies cost one signature.  A null id takes no part in links (component null,
    kept).  Repeated rows stay rows.  Rows that share an id but differ in text are judged each by its
    own text, so they can have different components.  Other columns are not looked at.
    """
    rows = near_classes(docs, id_col, text_col, shingle, percent)
    component = F.coalesce("lead_id", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest id (then the first by a hash of the text).

    Rows without an id or without words all stay; of rows that agree in id and text one stays.
    Columns are those of docs; an empty table stays empty.
    """
    rows = near_classes(docs, id_col, text_col, shingle, percent).where("n > 0 and id is not null")
    judged = written(rows.groupBy("id", "tag").agg(F.min((F.col("id") == F.col("lead_id")) & (F.col("tag") == F.col("lead_tag"))).alias("lead"), F.count("*").alias("times")))
    tag = F.xxhash64(col(text_col).cast("string"))
    gone = judged.where("not lead").select(F.col("id").alias("_n_id"), F.col("tag").alias("_n_tag"))
    on = lambda x: (col(id_col).cast("bigint") == x["_n_id"]) & (tag == x["_n_tag"])
    left = docs.join(gone, on(gone), "left_anti")
    again = judged.where("lead and times > 1").select(F.col("id").alias("_n_id"), F.col("tag").alias("_n_tag"))
    if not again.isEmpty():
        first = F.struct(*(col(c) for c in docs.columns))
        one = left.join(again, on(again), "left_semi").groupBy(col(id_col), tag.alias("_n_tag")).agg(F.first(first).alias("_n_row")).select("_n_row.*")
        left = left.join(again, on(again), "left_anti").select(*(col(c) for c in docs.columns)).union(one)
    return left.select(*(col(c) for c in docs.columns))
