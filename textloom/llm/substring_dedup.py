"""Removal of repeated word windows, found by recompression.

A text is parsed bottom-up in rounds.  A pair round splits the symbols by one bit of their name into
left and right ones and replaces every adjacent (left, right) by a new symbol; a run round replaces
a run of one symbol.  A new name is a fingerprint of what it replaces, so equal strings get equal
symbols in every task, apart from their edges.  With each symbol goes its *context*: the words that
decided that it was formed.  Wherever the words of the context recur, the symbol recurs.

A window of words in which no symbol's context lies is a symbol of its own, so every window holds at
least one.  A window that holds a symbol which occurs in no other document cannot recur in another
document, and one that recurs holds the same symbols at the same places each time.  Two exchanges
follow from that:

1. symbols of LEAST words or more are compared across documents; shared ones are told to their
   documents: these reveal where something may repeat,
2. windows that hold a shared symbol and no unshared one are compared by name: the symbol that ends
   first in them, its place, and a 64-bit fingerprint of all their words; those that also start in a
   document with a smaller id are told to their documents.

In both, a task first settles what repeats within its own slice of the input and sends on only one
entry of it, so text that stands in a third of all documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import col, partitions

#: Words that a symbol must cover to be compared, and rounds (True: runs, False: pairs).
LEAST = 3
ROUNDS = (False, False, False, True)
_PACKED = "bucket int, ids binary, tags binary, counts binary, names binary, at binary"


def symbols(w: K.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, rows and contexts (first word, end) of all symbols with a context of at most a window."""
    n = len(w.name)
    name, row = w.name, w.row
    start, stop = np.arange(n), np.arange(1, n + 1)
    low, high = start.copy(), stop.copy()
    found = []
    for r, runs in enumerate(ROUNDS):
        if len(name) < 2:
            break
        same = row[1:] == row[:-1]
        # What stands before and after a symbol: up to the context of its neighbour, or outside the row.
        before, after = w.bounds[row] - 1, w.bounds[row + 1] + 1
        before[1:][same], after[:-1][same] = low[:-1][same], high[1:][same]
        if runs:
            inner = same & (name[1:] == name[:-1])
            head = np.append(True, ~inner)
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(name)) - 1
            size = tails - heads + 1
            name = np.where(size > 1, K.mix(name[heads] * K.U(0x2545F4914F6CDD1D) + size.astype(np.uint64)), name[heads])
            row, start, stop = row[heads], start[heads], stop[tails]
            low, high = np.minimum(low[heads], before[heads]), np.maximum(high[tails], after[tails])
            new = size > 1
        else:
            left = (K.mix(name + K.U(r + 1)) >> K.U(17)) & K.U(1) == 0
            pair = same & left[:-1] & ~left[1:]
            first, second = np.append(pair, False), np.append(False, pair)
            alone = ~(first | second)
            low = np.where(alone & ~left, np.minimum(low, before), low)
            high = np.where(alone & left, np.maximum(high, after), high)
            at = np.flatnonzero(first)
            name = name.copy()
            name[at] = K.mix(name[at] * K.U(0xD6E8FEB86659FD93) + name[at + 1] + K.U(r))
            stop, high = stop.copy(), high.copy()
            stop[at], high[at] = stop[at + 1], high[at + 1]
            keep = ~second
            name, row, start, stop, low, high, new = (x[keep] for x in (name, row, start, stop, low, high, first))
        good = new & (stop - start >= LEAST) & (high - low <= window)
        found.append((name[good], row[good], low[good], high[good]))
    name, row, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    # A window in which no symbol's context lies is a symbol of its own.
    gram, at = K.grams(w, window)
    bare = _first_inside(low, high, at, window) < 0
    return np.concatenate([name, K.mix(gram[bare] + K.U(window))]), np.concatenate([row, w.row[at[bare]]]), np.concatenate([low, at[bare]]), np.concatenate([high, at[bare] + window])


def _first_inside(low: np.ndarray, high: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each window the number of the symbol whose context lies in it and ends first (of several, begins first); -1 for none."""
    if not len(low) or not len(at):
        return np.full(len(at), -1)
    order = np.lexsort((high, low))
    ends = (high[order] << 32) | np.arange(len(order))
    ends = np.append(np.minimum.accumulate(ends[::-1])[::-1], np.iinfo(np.int64).max)
    first = ends[np.searchsorted(low[order], at)]
    return np.where(first >> 32 <= at + window, order[np.minimum(first & 0xFFFFFFFF, len(order) - 1)], -1)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with all lowest bytes first, and so on: the high bytes are mostly 0 and compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _name_bytes(name: np.ndarray, short: bool) -> bytes:
    return (name.astype(np.uint32) if short else name).tobytes()


def _send(ids: np.ndarray, tags: np.ndarray, row: np.ndarray, name: np.ndarray, at: np.ndarray, buckets: int, salt: int, short: bool) -> pa.RecordBatch:
    """Entries (row's id, name, at) packed by bucket of the name; where one name is in several documents here, all but that of the smallest id go to a bucket of their own (-1 - salt): they are settled.

    short: of names only 32 bits go with the bucket; two names that are taken for one then only leave more for the exact comparison.
    """
    owner = ids[row]
    order = np.lexsort((owner, name))
    name, owner, at, row = name[order], owner[order], at[order], row[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    group = np.cumsum(new) - 1
    smallest = owner[np.flatnonzero(new)][group] if len(name) else owner
    settled = owner != smallest
    shared = np.zeros(int(new.sum()), bool)
    shared[group[settled]] = True
    bucket = (name >> K.U(40)).astype(np.int64) % buckets
    bucket[settled] = -1 - salt
    # An owner of the smallest id is told whether the name is shared already: its sign.
    order = np.lexsort((at, row, bucket))
    bucket, name, row, at, shared = bucket[order], name[order], row[order], at[order], shared[group][order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = row[a:b]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(heads, b - a)).astype(np.uint32)
        place = (at[a:b].astype(np.uint64) << K.U(1)) | shared[a:b].astype(np.uint64)
        rows.append((int(bucket[a]), ids[own[heads]].astype(np.int64).tobytes(), tags[own[heads]].tobytes(), counts.tobytes(), _name_bytes(name[a:b], short) if bucket[a] >= 0 else b"", _planes(place.astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 5))], ["bucket", "ids", "tags", "counts", "names", "at"])


def _tables(batch: pa.RecordBatch, short: bool) -> Iterator[tuple]:
    for bucket, ids, tags, counts, names, at in zip(*(batch.column(i) for i in range(6)), strict=True):
        counts = np.frombuffer(counts.as_buffer(), np.uint32)
        owner, tag = (np.repeat(np.frombuffer(x.as_buffer(), np.int64), counts) for x in (ids, tags))
        name = np.frombuffer(names.as_buffer(), np.uint32 if short else np.uint64).astype(np.uint64)
        if short:
            name = name | np.uint64(max(0, bucket.as_py()) << 32)
        yield bucket.as_py() < 0, owner, tag, name, _from_planes(at)


_REPLIES = "dealt int, ids binary, tags binary, counts binary, at binary"


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


def _answer(owner: np.ndarray, tag: np.ndarray, at: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """(id, tag, place) packed by groups of documents: one row for each group, however many documents it has."""
    dealt = (K.mix(owner.view(np.uint64) ^ K.mix(tag.view(np.uint64))) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((at, tag, owner, dealt))
    owner, tag, at, dealt = owner[order], tag[order], at[order], dealt[order]
    cuts = _runs(dealt)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        docs = _runs(owner[a:b], tag[a:b])
        heads = docs[:-1] + a
        rows.append((int(dealt[a]), owner[heads].tobytes(), tag[heads].tobytes(), np.diff(docs).astype(np.uint32).tobytes(), _planes(at[a:b])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 4))], ["dealt", "ids", "tags", "counts", "at"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: all its places."""
    parts: list[tuple] = []
    for batch in batches:
        for ids, tags, counts, at in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.uint32)
            parts.append((*(np.repeat(np.frombuffer(x.as_buffer(), np.int64), counts) for x in (ids, tags)), _from_planes(at)))
    if not parts:
        return
    owner, tag, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, tag, owner))
    owner, tag, at = owner[order], tag[order], at[order]
    cuts = _runs(owner, tag)
    for i in range(0, len(cuts) - 1, 10_000):
        part = cuts[i : i + 10_001]
        yield pa.RecordBatch.from_arrays([pa.array(owner[part[:-1]]), pa.array(tag[part[:-1]]), pa.array([at[a:b].tobytes() for a, b in zip(part[:-1], part[1:], strict=True)], pa.binary())], ["id", "tag", "told"])


def _settle(batches: Iterator[pa.RecordBatch], first_too: bool, groups: int) -> Iterator[pa.RecordBatch]:
    """Tells each document the places of its names that others have (first_too: those with smaller ids only count otherwise)."""
    owners, tags, names, places = [], [], [], []
    known: list[tuple] = []
    for batch in batches:
        for settled, owner, tag, name, at in _tables(batch, first_too):
            if settled:
                known.append((owner, tag, at >> 1))
            else:
                owners.append(owner)
                tags.append(tag)
                names.append(name)
                places.append(at)
    if not names:
        if known:
            yield from _answer(*(np.concatenate(x) for x in zip(*known, strict=True)), groups)
        return
    owner, tag, name, at = (np.concatenate(x) for x in (owners, tags, names, places))
    order = np.lexsort((owner, name))
    owner, tag, name, at = owner[order], tag[order], name[order], at[order]
    new = np.append(True, name[1:] != name[:-1])
    group = np.cumsum(new) - 1
    told = owner != owner[np.flatnonzero(new)][group]
    if first_too:
        shared = np.zeros(int(new.sum()), bool)
        shared[group[told | (at & 1).astype(bool)]] = True
        told = shared[group]
    known.append((owner[told], tag[told], at[told] >> 1))
    # All of a task's answers go out as one row for each group of documents.
    yield from _answer(*(np.concatenate(x) for x in zip(*known, strict=True)), groups)


def _symbols_out(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.chunks(whole):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            w = K.words(batch.column("text"))
            name, row, low, _ = symbols(w, window)
            yield _send(ids, batch.column("tag").to_numpy(), row, name, _places(name, row), buckets, int(ids[0]) % buckets, True)


def _places(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The number of each symbol among those of its row, in the order in which they are found."""
    order = np.argsort(row, kind="stable")
    heads = np.searchsorted(row[order], row[order])
    out = np.empty(len(row), np.int64)
    out[order] = np.arange(len(row)) - heads
    return out


def _marked(batch: pa.RecordBatch, column: str, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether (row, place) is among the places told to the row."""
    lists = batch.column(column)
    told = [np.unique(np.frombuffer(v, np.uint32)).astype(np.int64) if (v := y.as_py()) else np.zeros(0, np.int64) for y in lists]
    flat = np.concatenate([t + (r << 32) for r, t in enumerate(told)]) if told else np.zeros(0, np.int64)
    mine = (row.astype(np.int64) << 32) + place
    at = np.searchsorted(flat, mine)
    at[at == len(flat)] = 0
    return (flat[at] == mine) if len(flat) else np.zeros(len(mine), bool)


def candidates(w: K.Words, window: int, name: np.ndarray, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the windows that hold a shared symbol's context and no unshared one's.

    A window is named by that symbol, its place in the window, and a fingerprint of all the words:
    what a symbol does not reveal as a likely repeat is not compared.
    """
    gram, at = K.grams(w, window)
    cut = np.zeros(len(w.name) + 2, np.int64)
    a, b = np.maximum(high[~shared] - window, 0), low[~shared] + 1
    cut += np.bincount(a[a < b], minlength=len(cut)) - np.bincount(b[a < b], minlength=len(cut))
    open_ = np.cumsum(cut)[at] == 0
    gram, at = gram[open_], at[open_]
    name, low, high = name[shared], low[shared], high[shared]
    held = _first_inside(low, high, at, window)
    found = held >= 0
    gram, at, held = gram[found], at[found], held[found]
    return K.mix(gram ^ K.mix(name[held] + (low[held] - at).astype(np.uint64))), at


def _windows_out(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.chunks(whole):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            w = K.words(batch.column("text"))
            name, row, low, high = symbols(w, window)
            name, at = candidates(w, window, name, low, high, _marked(batch, "told", row, _places(name, row)))
            row = w.row[at]
            yield _send(ids, batch.column("tag").to_numpy(), row, name, at - w.bounds[row], buckets, int(ids[0]) % buckets, False)


def _cleaned(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, told in zip(K.strings(batch.column("text")), batch.column("told"), strict=True):
            words = text.as_py().encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if v := told.as_py():
                at = np.unique(np.frombuffer(v, np.uint32)).astype(np.int64)
                gone[at] += 1
                gone[at + window] -= 1
            gone = np.cumsum(gone[:-1]) > 0 if words else np.zeros(0, bool)
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            left = b" ".join(x for x, g in zip(words, gone, strict=True) if not g) if removed[-1] else b" ".join(words)
            kept.append(left.decode() if texts else hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("raw_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row of docs.

    A window is so many consecutive words of one document.  Every word covered by a window whose
    words also start in a document with a smaller id is removed; windows are judged on the input.
    kept: the words left, joined by one space (texts=False: its SHA-256 in hex).  Null text: no
    words.  A null id: nothing is removed, and nothing is compared with it.  Rows that repeat an id
    are told apart by their text; equal rows get equal results.  Ids are whole numbers.  Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    rows = docs.select(col(id_col).alias("raw_id"), col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    known = rows.where("id is not null")

    def settled(out: DataFrame, first_too: bool) -> DataFrame:
        told = out.repartition(n, "bucket").mapInArrow(lambda it: _settle(it, first_too, n), _REPLIES)
        return told.repartition(n, "dealt").mapInArrow(_merge, "id bigint, tag bigint, told binary")

    # Both joins deal out the same rows by the same keys, so the texts are shuffled once.
    dealt = known.select("id", "tag", "text")
    sent = dealt.mapInArrow(lambda it: _symbols_out(it, window, buckets), _PACKED)
    shared = settled(sent, True)
    sent = dealt.join(shared, ["id", "tag"], "left").mapInArrow(lambda it: _windows_out(it, window, buckets), _PACKED)
    repeated = settled(sent, False)
    schema = f"id {rows.schema['raw_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string"
    nothing = F.lit(None).cast("binary").alias("told")
    final = dealt.join(repeated, ["id", "tag"], "left").select(F.col("id").cast(rows.schema["raw_id"].dataType).alias("raw_id"), "text", "told")
    unknown = rows.where("id is null").select("raw_id", "text", nothing)
    clean = lambda df: df.mapInArrow(lambda it: _cleaned(it, window, texts), schema)
    out = clean(final).union(clean(unknown))
    return out.withColumnRenamed("id", id_col)
