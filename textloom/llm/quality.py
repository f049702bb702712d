"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation
maximisation estimates, from the counts of all vote patterns in the corpus, how often documents of
either class get each vote; the posterior of each pattern labels its documents.  These labels train
a logistic scorer over hashed features (shapes of words, repeated words, bins of the heuristics'
figures), which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import col, fresh, written

DIMS = 1 << 14
#: The scorer is fitted on at most so many documents, those with the smallest hash of their id.
SAMPLE = 20_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!;:"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("x")

#: Name of a figure, bad above, good below, least words for a vote.
LABELLERS = (
    ("repeats", 0.2, 0.05, 8),  # share of words equal to the one before
    ("marks", 0.5, 0.1, 1),  # symbols by word
    ("capitals", 0.5, 0.15, 3),  # share of ASCII letters that are capitals
    ("lone_marks", 0.15, 0.02, 4),  # share of words without letters, digits or bytes above ASCII
    ("sameness", 0.75, 0.45, 30),  # share of words that are repetitions of a word of the document
    ("unstopped", 60.0, 25.0, 20),  # words by sentence mark
    ("top_word", 0.25, 0.12, 20),  # share of the commonest word
)


def figures(w: K.Words) -> np.ndarray:
    """The labellers' figures, a row for each text."""
    n = np.diff(w.bounds)
    per = np.maximum(n, 1)
    rows = len(n)
    sums = lambda flag: np.bincount(w.row, flag, minlength=rows)
    total = lambda table: (lambda c: c[w.end] - c[w.first])(np.append(0, np.cumsum(table[w.data])))
    same = np.append(False, (w.name[1:] == w.name[:-1]) & (w.row[1:] == w.row[:-1])) if len(w.name) else np.zeros(0, bool)
    order = np.lexsort((w.name, w.row))
    name, row = w.name[order], w.row[order]
    new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])) if len(name) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    top = np.zeros(rows)
    np.maximum.at(top, row[heads], np.diff(np.append(heads, len(name))))
    distinct = np.bincount(row[heads], minlength=rows)
    letters, upper, marks = total(_LETTER), total(_UPPER), total(_MARK)
    solid = total((_LETTER | (np.arange(256) >= 128) | ((np.arange(256) >= 48) & (np.arange(256) < 58))))
    return np.stack([sums(same) / per, sums(marks) / per, sums(upper) / np.maximum(sums(letters), 1), sums(solid == 0) / per, 1 - distinct / per, n / np.maximum(sums(total(_STOP) > 0), 0.5), top / per], axis=1)


def votes(figure: np.ndarray, n: np.ndarray) -> np.ndarray:
    """2 for bad, 1 for good, 0 for no vote."""
    out = np.zeros(figure.shape, np.int8)
    for j, (_, bad, good, least) in enumerate(LABELLERS):
        out[:, j] = np.where(n < least, 0, np.where(figure[:, j] > bad, 2, np.where(figure[:, j] < good, 1, 0)))
    return out


def features(w: K.Words, figure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed dimensions and values, each row's in the same order whatever is beside it."""
    n = np.diff(w.bounds)
    shaped = w._replace(data=_SHAPE[w.data])
    power, inverse = K._powers(len(w.data) + 1)
    total = np.append(np.uint64(0), np.cumsum(K._VALUES[shaped.data] * power[: len(w.data)], dtype=np.uint64))
    shape = K.mix((total[w.end] - total[w.first]) * inverse[w.first]) if len(w.first) else np.zeros(0, np.uint64)
    place = (shape % np.uint64(DIMS)).astype(np.int64)
    key, count = np.unique(w.row * DIMS + place, return_counts=True)
    row, dim = key // DIMS, key % DIMS
    value = count / np.maximum(n[row], 1)
    bins = np.clip((np.sqrt(np.clip(figure, 0, 100)) * 8).astype(np.int64), 0, 60)
    rows = len(n)
    row = np.concatenate([row, np.repeat(np.arange(rows), len(LABELLERS))])
    extra = K.mix((bins + np.arange(len(LABELLERS)) * 64 + 1).astype(np.uint64).reshape(-1)) % np.uint64(DIMS)
    dim = np.concatenate([dim, extra.astype(np.int64)])
    value = np.concatenate([value, np.full(rows * len(LABELLERS), 0.5)])
    order = np.lexsort((dim, row))
    return row[order], dim[order], value[order]


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The probability that documents of each vote pattern are bad, and rates[class, labeller]: how often a vote is bad.

    Class 0 is good text; there is a class of bad text for each labeller, as junk of one kind rouses
    few labellers.  Given the class, votes are independent; no vote says nothing.  Good text gets a
    prior of few bad votes, as strong as the corpus, since labellers are set to be seldom wrong.
    """
    classes = patterns.shape[1] + 1
    is_bad, voted = (patterns == 2).astype(float), (patterns > 0).astype(float)
    share = np.hstack([0.03 * np.ones((len(patterns), 1)), is_bad + 1e-4])
    share[~is_bad.any(axis=1), 0] = 30
    share /= share.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = share * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + classes)
        strength = np.full((classes, 1), 1.0)
        strength[0] = counts.sum()
        first = np.full((classes, classes - 1), 0.1)
        first[0] = 0.001
        first[np.arange(1, classes), np.arange(classes - 1)] = 0.9
        rates = (weight.T @ is_bad + strength * first) / (weight.T @ voted + strength)
        log = np.log(prior) + is_bad @ np.log(rates).T + (voted - is_bad) @ np.log(1 - rates).T
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log)
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return 1 - share[:, 0], rates


def train(row: np.ndarray, dim: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by full-batch Adagrad; the last weight is the intercept."""
    w, seen = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-6)
    for _ in range(rounds):
        z = np.bincount(row, value * w[dim], minlength=len(target)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - target) / len(target)
        gradient = np.append(np.bincount(dim, value * error[row], minlength=DIMS), error.sum()) + decay * w
        seen += gradient**2
        w -= rate * gradient / np.sqrt(seen)
    return w


class Model(NamedTuple):
    weights: np.ndarray
    threshold: float
    patterns: dict[str, float]  #: vote pattern to the posterior of being good
    rates: np.ndarray

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with score (probability of being good, six decimals), keep, votes, n_words; where such a name is taken, underscores follow it."""
        weights, threshold = self.weights, self.threshold
        new = {k: fresh(docs, k) for k in ("score", "keep", "votes", "n_words")}
        kinds = (T.DoubleType(), T.BooleanType(), T.StringType(), T.LongType())
        schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in zip(new.values(), kinds, strict=True))])
        place = docs.columns.index(text_col)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.chunks(whole, place):
                    w = K.words(batch.column(place))
                    figure, n = figures(w), np.diff(w.bounds)
                    row, dim, value = features(w, figure)
                    z = np.bincount(row, value * weights[dim], minlength=len(n)) + weights[-1]
                    score = np.where(n > 0, np.round(1 / (1 + np.exp(-z)), 6), 0.0)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= threshold), pa.array(_names(votes(figure, n))), pa.array(n.astype(np.int64))], [*batch.schema.names, *new.values()])

        return docs.mapInArrow(scored, schema)


def _names(v: np.ndarray) -> list[str]:
    return ["".join("-+!"[x] for x in r) for r in v]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.chunks(whole):
            w = K.words(batch.column("text"))
            figure, n = figures(w), np.diff(w.bounds)
            row, dim, value = features(w, figure)
            cuts = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(_names(votes(figure, n))), pa.ListArray.from_arrays(cuts, pa.array(dim.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))], ["h", "votes", "dims", "vals"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> Model:
    """Weak labels from all documents with words, and a scorer fitted on at most `sample` of them.

    Which documents are sampled is decided by a hash of the id and the first 100 characters; texts are
    read whole.  With no documents, or none with words, every text with words scores 0.5 and is kept.
    """
    rows = docs.select(F.xxhash64(col(id_col).cast("string"), F.substring(col(text_col), 1, 100)).alias("h"), col(text_col).cast("string").alias("text")).where("text is not null")
    facts = written(rows.mapInArrow(_facts, "h bigint, votes string, dims array<int>, vals array<float>").where(F.size("dims") > len(LABELLERS)))
    found = sorted((r["votes"], r["count"]) for r in facts.groupBy("votes").count().collect())  # at most 3**7 patterns
    if not found:
        return Model(np.zeros(DIMS + 1), threshold, {}, np.zeros((len(LABELLERS) + 1, len(LABELLERS))))
    patterns = np.array([["-+!".index(x) for x in p] for p, _ in found])
    bad, rates = posteriors(patterns, np.array([c for _, c in found], float))
    good = {p: float(1 - b) for (p, _), b in zip(found, bad, strict=True)}
    # Hashes are even, so those that can be among the smallest are known beforehand: tasks send little more than the sample.
    share = min(1.0, (1.2 * sample + 200) / sum(c for _, c in found))
    facts = facts.where(F.col("h") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    taken = facts.orderBy("h", "votes").limit(sample).toArrow()
    dims, vals = taken.column("dims").combine_chunks(), taken.column("vals").combine_chunks()
    row = np.repeat(np.arange(len(taken)), np.diff(dims.offsets.to_numpy()))
    target = np.array([good[v] for v in taken.column("votes").to_pylist()])
    weights = train(row, dims.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy().astype(float), target)
    return Model(weights, threshold, good, rates)


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with score, keep, votes and n_words.

    A text without words (null, empty, white space) scores 0 and is not kept.  Null ids, repeated
    rows and other columns pass through; equal texts get equal scores.
    """
    return fit(docs, id_col, text_col, threshold, sample).score(docs, text_col)
