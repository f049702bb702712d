"""Token ids in files: static range asymmetric numeral systems (rANS).

A token table is a Parquet folder whose rows are *units* in ascending order of document id.  A unit
holds whole documents with about UNIT ids and is decoded by itself:

====================  ==================================================================
part, unit            the unit's place: ascending part, then ascending unit
n_docs, n_tokens      counts
doc_ids               int64 little-endian; null_ids: one byte each, 1 for a null id
lengths               uint32, ids of each document, the end id included
symbols, freqs        the unit's shared frequency table: uint32 ids, uint32 shares of 2**BITS
states, cuts          checkpoints: uint64 final state of each block, uint32 where its words begin
words                 uint32 words of all blocks
crcs                  uint32 CRC-32 of each block's ids as little-endian uint32
====================  ==================================================================

Blocks are BLOCK consecutive ids with a coder state of their own.  Coder and decoder go through all
blocks of a unit side by side, one id of each in a step, and a reader can begin at any checkpoint.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .shared import col, partitions

UNIT, BLOCK, BITS, LOW = 2_000_000, 1024, 20, 31
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_200_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20
_U = np.uint64


class Encoder:
    """Ids of texts by the tokenizers library; each distinct word is encoded once.

    A text may be cut before any space that stands between two characters that are no white space:
    the tokenizer's own splitting always cuts there, so the pieces' ids joined are the text's.
    Texts with other spaces, or with the string of a special token, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = self._ids(["\n\n"])[0]
        if len(self.blank) != 1:
            raise ValueError("a blank line must be a single id of this tokenizer")
        self._forget()

    def _forget(self) -> None:
        """The words that were met, the ids of each with a space before it (from start on in flat) and their number, -1 if they cannot be told without the word's text."""
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        # A few at a time: the library keeps much more than the ids of each text.
        few = (self.tokenizer.encode_batch_fast(texts[i : i + 100], add_special_tokens=False) for i in range(0, len(texts), 100))
        return [np.asarray(e.ids, "<u4") for batch in few for e in batch]

    def _learn(self, words: pa.Array) -> None:
        """Encodes words with a space before each, a thousand in one text: a blank line always is a single id of its own there."""
        odd = np.zeros(len(words), bool)
        for begin, end in ((0, 1), (-1, None)):
            ends = pc.utf8_slice_codeunits(words, begin, end).dictionary_encode()
            odd |= np.array([not x or x.isspace() for x in ends.dictionary.to_pylist()], bool)[np.asarray(ends.indices)]
        alone = np.zeros(len(words), bool)
        for x in ("\n\n", *self.special):
            alone |= np.asarray(pc.match_substring(words, x))
        alone &= ~odd
        several = words.filter(pa.array(~odd & ~alone))
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(several), 1000), len(several)), pa.int32()), several)
        joined = [f" {x}" for x in pc.binary_join(lists, "\n\n ").to_pylist()] if len(several) else []
        singles = [f" {x}" for x in words.filter(pa.array(alone)).to_pylist()]
        ids = self._ids(joined + singles)
        flat = np.concatenate([np.zeros(0, "<u4"), *(y for x in ids[: len(joined)] for y in (x, self.blank))])
        ends = np.flatnonzero(flat == self.blank)
        if len(ends) != len(several):
            raise ValueError("a blank line must be a single id of this tokenizer")
        size, start = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int64)
        plain = ~odd & ~alone
        start[plain] = np.append(0, ends + 1)[:-1]
        size[plain] = ends - start[plain]
        size[alone] = [len(x) for x in ids[len(joined) :]]
        start[alone] = len(flat) + np.cumsum(size[alone]) - size[alone]
        self.start = np.append(self.start, start + len(self.flat))
        self.size = np.append(self.size, size)
        self.flat = np.concatenate([self.flat, flat, *ids[len(joined) :]])
        self.known = pa.concat_arrays([self.known, words])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        pieces = pc.split_pattern(texts, " ")
        coded = pieces.values.dictionary_encode()
        words, index = coded.dictionary.cast(pa.string()), np.asarray(coded.indices)
        heads = np.asarray(pieces.offsets)[:-1].astype(np.int64)
        later = np.ones(len(index), bool)
        later[heads] = False
        used = np.bincount(index[later], minlength=len(words)) > 0
        inner = words.filter(pa.array(used))
        place = pc.index_in(inner, value_set=self.known)
        new = np.asarray(pc.is_null(place))
        at = np.asarray(pc.fill_null(place, 0)).astype(np.int64)
        at[new] = len(self.known) + np.arange(int(new.sum()))
        self._learn(inner.filter(pa.array(new)))
        # Pieces at a text's beginning have no space before them; texts that cannot be cut are one such piece.
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[used], start[used] = self.size[at], self.start[at]
        whole = np.add.reduceat(((size[index] < 0) & later).astype(np.int64), heads) > 0
        for t in self.special:
            whole |= np.asarray(pc.match_substring(texts, t))
        first = words.take(pa.array(index[heads])).to_pylist()
        whole |= np.array([not x or x[-1].isspace() for x in first])
        begin = self._ids([texts[r].as_py() if w else x for r, (x, w) in enumerate(zip(first, whole.tolist(), strict=True))])
        n, at = size[index], start[index]
        n[np.repeat(whole, np.diff(np.append(heads, len(index))))] = 0
        n[heads] = [len(x) for x in begin]
        at[heads] = len(self.flat) + np.cumsum(n[heads]) - n[heads]
        flat = np.concatenate([self.flat, *begin])
        place = np.repeat(at - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        return flat[place], np.add.reduceat(n, heads)


_ENCODERS: dict[str, Encoder] = {}


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their shares, whole numbers of at least 1 that sum to 2**BITS."""
    if len(ids) and int(ids.max()) < 1 << BITS:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    share = np.maximum(1, counts * (1 << BITS) // counts.sum()).astype(np.int64)
    order = np.argsort(-share, kind="stable")
    over = int(share.sum()) - (1 << BITS)
    for i in order:
        if not over:
            break
        take = over if over < 0 else min(over, int(share[i]) - 1)
        share[i] -= take
        over -= take
    return symbols.astype(np.uint32), share.astype(np.uint32)


def _places(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each id's place among the symbols."""
    if int(symbols[-1]) >= 1 << BITS:
        return np.searchsorted(symbols, ids)
    places = np.zeros(int(symbols[-1]) + 1, np.int32)
    places[symbols] = np.arange(len(symbols), dtype=np.int32)
    return places[ids]


def compress(ids: np.ndarray) -> dict[str, np.ndarray]:
    """The table, checkpoints, block checksums and words of a unit's ids."""
    symbols, freqs = frequencies(ids)
    blocks = -(-len(ids) // BLOCK)
    place = np.zeros(blocks * BLOCK, np.int32)
    place[: len(ids)] = _places(symbols, ids)
    # A row for each step: what one step needs of all blocks lies together.
    place = np.ascontiguousarray(place.reshape(blocks, BLOCK).T)
    freq, start = freqs.astype(np.uint64), (np.cumsum(freqs, dtype=np.uint64) - freqs)
    x = np.full(blocks, 1 << LOW, np.uint64)
    words, used = np.zeros((BLOCK, blocks), np.uint32), np.zeros((BLOCK, blocks), bool)
    for t in range(BLOCK - 1, -1, -1):
        s = place[t]
        f = freq[s]
        big = x >= f << _U(LOW - BITS + 32)
        words[t] = x & _U(0xFFFFFFFF)
        used[t] = big
        x = np.where(big, x >> _U(32), x)
        q = x // f
        x = (q << _U(BITS)) + (x - q * f) + start[s]
    count = used.sum(axis=0)
    data = np.ascontiguousarray(ids, "<u4").tobytes()
    crcs = np.array([zlib.crc32(data[i : i + 4 * BLOCK]) for i in range(0, len(data), 4 * BLOCK)], np.uint32)
    return {"symbols": symbols, "freqs": freqs, "states": x, "cuts": (np.cumsum(count) - count).astype(np.uint32), "crcs": crcs, "words": words.T[used.T]}


def expand(n: int, symbols: np.ndarray, freqs: np.ndarray, states: np.ndarray, cuts: np.ndarray, words: np.ndarray, crcs: np.ndarray | None = None, blocks: slice = slice(None)) -> np.ndarray:
    """The first n ids of the chosen blocks; crcs: every block is held against its checksum."""
    freq, start = freqs.astype(np.uint64), np.cumsum(freqs, dtype=np.uint64) - freqs
    which = np.repeat(np.arange(len(symbols), dtype=np.int32), freqs)
    x, at = states[blocks].copy(), cuts[blocks].astype(np.int64)
    words = np.append(words, np.uint32(0))
    out = np.empty((BLOCK, len(x)), np.uint32)
    for t in range(BLOCK):
        slot = x & _U((1 << BITS) - 1)
        s = which[slot.astype(np.int64)]
        out[t] = symbols[s]
        x = freq[s] * (x >> _U(BITS)) + slot - start[s]
        small = x < _U(1 << LOW)
        x = np.where(small, (x << _U(32)) | words[np.minimum(at, len(words) - 1)].astype(np.uint64), x)
        at += small
    ids = out.T.reshape(-1)[:n]
    if crcs is not None:
        data = ids.astype("<u4").tobytes()
        for k, crc in enumerate(crcs[blocks].tolist()):
            if zlib.crc32(data[4 * BLOCK * k : 4 * BLOCK * (k + 1)]) != crc:
                raise ValueError(f"checksum of block {k} differs")
    return ids


_FIELDS = [("part", pa.int32()), ("unit", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "null_ids", "lengths", "symbols", "freqs", "states", "cuts", "crcs", "words"))]
SCHEMA = ", ".join(f"{k} {'int' if t == pa.int32() else 'bigint' if t == pa.int64() else 'binary'}" for k, t in _FIELDS)


def _units(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    # A task has one core: the library's own threads would only wait for it.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    # Kept between the tasks of a worker, with the words it has met.
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    part, unit = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate([x for _, x in held])
        values = {k: v.tobytes() for k, v in compress(ids).items()}
        values |= {"part": part, "unit": unit, "n_docs": len(held), "n_tokens": len(ids), "doc_ids": np.array([i or 0 for i, _ in held], np.int64).tobytes(), "null_ids": bytes(i is None for i, _ in held), "lengths": np.array([len(x) for _, x in held], np.uint32).tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([values[k]], t) for k, t in _FIELDS], [k for k, _ in _FIELDS])

    for whole in batches:
        for batch in K.chunks(whole, size=TEXT_BYTES):
            ids, counts = encoder.encode(K.strings(batch.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends += np.arange(1, len(ends) + 1)
            for i, a, b in zip(batch.column("id").to_pylist(), (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                held.append((i, ids[a:b]))
                size += b - a
                if size >= UNIT:
                    yield row()
                    held, size, unit = [], 0, unit + 1
    if held:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encodes every text (null: empty) and writes the token table in ascending order of id.

    Null ids come first; rows that share an id are ordered by a hash of their text.  Strings of
    special tokens in a text are what the tokenizer takes them for.  An empty table gives an empty
    token table.  A document is never cut: a task's memory must hold the longest text and its ids.
    """
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(lambda it: _units(it, tokenizer, end_id), SCHEMA).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            get = lambda k, t: np.frombuffer(r[k], t)  # noqa: B023, E731
            ids = expand(r["n_tokens"], get("symbols", np.uint32), get("freqs", np.uint32), get("states", np.uint64), get("cuts", np.uint32), get("words", np.uint32), get("crcs", np.uint32))
            flat = ids.astype("<u4").tobytes()
            lengths = get("lengths", np.uint32).astype(np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            own = pa.array(get("doc_ids", np.int64), mask=get("null_ids", bool))
            lists = pa.nulls(len(ends), pa.list_(pa.int32())) if not with_ids else pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["unit"], np.int32)), own, pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()), lists], ["part", "unit", "id", "inside", "n_tokens", "ids_crc32", "ids"])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document of a token table (ids=False: without the last); checksums are verified."""
    table = spark.read.schema(SCHEMA).parquet(path)
    docs = table.mapInArrow(lambda it: _decoded(it, ids), "part int, unit int, id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    # Running sums in two levels: over the parts (one row for each file), then within each.
    units = table.select("part", "unit", "n_tokens")
    before = units.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inner = units.select("part", "unit", (F.sum("n_tokens").over(W.partitionBy("part").orderBy("unit")) - F.col("n_tokens")).alias("within"))
    offsets = inner.join(before, "part")
    return docs.join(offsets, ["part", "unit"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("within") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
