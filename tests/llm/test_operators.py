"""The ten operators against SQL, brute force and exact round trips, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import json
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import same
from textloom.llm import ann, chat, decontaminate, linking, near_dup, quality, token_store
from textloom.llm import line_dedup as line_dedup_of
from textloom.llm import substring_dedup as substring
from textloom.llm.ann import _search, nearest
from textloom.llm.decontaminate import decontaminated, decontamination
from textloom.llm.kernel import sets, words
from textloom.llm.line_dedup import SHINGLE, deduplicated, line_dedup
from textloom.llm.mixing import mix, mixed_documents
from textloom.llm.near_dup import near_duplicates
from textloom.llm.quality import fit, quality_classifier
from textloom.llm.queries import ORACLES, QUERIES
from textloom.llm.sharding import shard_index, sharded
from textloom.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"
LONG = "ein sehr langer Text mit vielen Worten 12 km weit " * 8000
PROSE = "Anna walked 12 km to the market in Berlin and bought seven red apples for her mother there."
TEXTS = [
    (1, PROSE, "en", "web"),
    (2, PROSE, "en", "web"),
    (3, PROSE.replace("seven", "eight"), "en", "web"),
    (4, None, "en", "books"),
    (5, "", "en", None),
    (6, " \n\t ", None, "web"),
    (7, LONG, "de", "web"),
    (8, LONG + "Ende", "de", "web"),
    (9, "one", "en", "web"),
    (10, "One", "en", "books"),
    (11, "a b\n" + PROSE + "\nlast line of this text", "en", "web"),
    (12, "a b\n" + PROSE + "\nlast line of this text", "en", "web"),
    (12, "a b\n" + PROSE + "\nlast line of this text", "en", "web"),
    (None, PROSE, "en", "web"),
    (13, "x " * 40, "en", "wiki"),
    (14, "caf\u00e9 \u00e0 la cr\u00e8me \U0001f600 " * 5, "fr", "wiki"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that the operators use."""
    rows = [(i, t, lang, s, len(t or ""), "x", 1, 2.5, True, "y", 3, "z") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tag int, score double, keep boolean, shard string, slot int, _bucket string").repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder of distinct ids with copies, near copies and shared passages."""
    made = tmp_path_factory.mktemp("tables")
    draw = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = list(draw.choice(vocabulary, int(draw.integers(0, 120))))
        if i % 3 == 0 and i:
            text = rows[i // 2][1].split(" ") if rows[i // 2][1] else []
            if len(text) > 20 and i % 2:
                text[5] = "changed"
        if i % 7 == 0:
            text = text[:30] + ["the", "shared", "passage"] * 8 + text[30:]
        rows.append((i, " ".join(text) if i % 11 else None, ["web", None, "b"][i % 3]))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    table.repartition(4).write.parquet(str(made / "documents.parquet"))
    return str(made)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op6_mixing", "op8_near_dup"])
def test_sql_of_copies(spark, folder, name):
    assert same(QUERIES[name](spark, folder), ORACLES[name], folder) is None


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# op1


def _line_classes(texts):
    """Brute force: every pair of lines by exact sets, joined up; the first line of each class stays."""
    places = [(i, n, line) for i, text in texts for n, line in enumerate(text.split("\n")) if line.strip()]
    grams = [{x[2][k : k + SHINGLE] for k in range(max(1, len(x[2]) - SHINGLE + 1))} for x in places]
    part = list(range(len(places)))

    def top(a):
        while part[a] != a:
            a = part[a]
        return a

    for a in range(len(places)):
        for b in range(a):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {(places[a][0], places[a][1]) for a in range(len(places)) if top(a) != a}


def test_lines_as_by_brute_force(spark):
    draw = np.random.default_rng(5)
    pool = ["".join(draw.choice(list("abcdefgh "), 80)) for _ in range(25)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(int(draw.integers(1, 6))):
            line = list(pool[int(draw.integers(len(pool)))])
            if draw.random() < 0.3:
                line[2] = "Z"
            if draw.random() < 0.1:
                line = line[:40]
            lines.append("".join(line))
        texts.append((i, "\n".join([*lines, "", "  "])))
    got = line_dedup(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    gone = {(r["doc_id"], n) for r in got for n in range(r["n_lines"]) if n not in r["kept_lines"]}
    assert gone == _line_classes(texts)


def test_one_character_edits_in_the_middle(spark):
    draw, texts = np.random.default_rng(6), []
    for n in range(40, 121, 2):
        line = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), n - 2))
        line = f"a{line}z"
        texts += [line, line[: n // 2] + "Z" + line[n // 2 + 1 :]]
    got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    missed = [i for i in range(1, len(texts), 2) if got[i]]
    assert len(missed) <= 1
    assert all(got[i] for i in range(0, len(texts), 2))


def test_bins_near_the_largest_int(spark):
    draw = np.random.default_rng(8)
    short = ["".join(x) for x in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), (60_000, 10))]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(short)], "h bigint, line string")
    top = texts.where(f"shiftrightunsigned(xxhash64(encode(line, 'UTF-16BE')), 33) > {2**31 - 1 - 15 * 7919}").select("line").collect()
    assert top
    rows = [(i, r["line"]) for i, r in enumerate(top * 2)]
    got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: [0] if i < len(top) else [] for i in range(len(rows))}


@pytest.mark.parametrize("half", [False, True])
def test_signatures_rule_out_no_link_and_most_others(spark, half):
    """Short lines too, which meet in many buckets, are told apart before their texts are read."""
    draw, texts = np.random.default_rng(9), []
    for n in range(8, 88):
        line = "".join(draw.choice(list("abcdefgh "), n)).strip() + "."
        texts += [line, line + "x", line[:-1] + "ab", line[: n // 2]]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id bigint, line string")
    signed = line_dedup_of._signed(lines)
    signed = (line_dedup_of._halved(signed) if half else signed).cache()
    both = signed.alias("x").join(signed.alias("y"), F.col("x.id") < F.col("y.id"))
    passed = {(r["a"], r["b"]) for r in both.where(line_dedup_of._agree("x", "y", 80, half)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    grams = [{x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in texts]
    linked = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    assert len(linked) > 100 and linked <= passed
    assert len(passed - linked) < 0.02 * len(texts) * (len(texts) - 1) / 2


def _grams(text):
    return {text[k : k + SHINGLE] for k in range(max(1, len(text) - SHINGLE + 1))}


def test_parity_maps_rule_out_no_link_and_most_lines_below_the_threshold(spark):
    draw, texts, similar = np.random.default_rng(13), [], {}
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    for n in (3, 30, 100, 300, 600, 1500, 6000):
        for share in (0.0, 0.02, 0.03, 0.05, 0.05, 0.055, 0.08, 0.12, 0.2):
            line = draw.choice(letters, n)
            other = np.where(draw.random(n) < share, draw.choice(letters, n), line)
            texts += ["".join(line), "".join(other)]
            x, y = map(_grams, texts[-2:])
            similar[len(texts) - 2] = len(x & y) / len(x | y)
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, line string")
    own = line_dedup_of._parities(rows).cache()
    assert {r["id"]: r["size"] for r in own.collect()} == {i: len(_grams(x)) for i, x in enumerate(texts)}
    both = own.alias("x").join(own.alias("y"), F.expr("x.id % 2 = 0 and y.id = x.id + 1"))
    passed = {r["id"] for r in both.where(line_dedup_of._alike("x", "y", 80)).select("x.id").collect()}
    linked = {i for i, j in similar.items() if j >= 0.8}
    assert len(linked) > 20 and linked <= passed
    assert not [i for i in passed if len(texts[i]) <= 600 and similar[i] < (0.7 if len(texts[i]) <= 300 else 0.65)]


def test_lines_around_a_group_make_few_pairs(spark, monkeypatch):
    """Many copies of a line, and as many lines that are nearly, but not quite, linked with each of them: hardly any pair of both is verified."""
    draw, texts, made = np.random.default_rng(14), [], []
    line = draw.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)
    for edits in [2] * 100 + [12] * 100:
        x = line.copy()
        x[np.arange(edits) * (290 // edits) + 5 + draw.integers(0, 290 // edits - 5, edits)] = "Z"
        texts.append("a" + "".join(x) + "z")
    link = linking.link_to_pivots

    def watched(busy, verify, across):
        def counted(rows):
            pairs = across(rows)
            made.append(pairs.count())
            return pairs

        return link(busy, verify, counted)

    monkeypatch.setattr(line_dedup_of, "link_to_pivots", watched)
    rows = [(i, x) for i, x in enumerate(texts)]
    got = {r["doc_id"]: list(r["kept_lines"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {(i, 0) for i in got if not got[i]} == _line_classes(rows)
    assert len(_line_classes(rows)) == 99 and made[0] < 1000


def test_pivots_are_not_looked_at_again(spark):
    """A bucket of two lines is done when one has met the other; in larger ones everyone has met the pivot."""
    seen, none = [], "a bigint, b bigint"
    busy = linking.written(spark.createDataFrame([(1, 10, 10), (1, 11, 10), (2, 12, 12), (2, 13, 12), (2, 14, 12), (3, 15, 15), (3, 16, 15), (3, 17, 15)], "key bigint, id bigint, low bigint"))

    def verify(pairs):
        return pairs.where("a = 17 and b = 15 or a = 14 and b = 13")

    def across(rows):
        seen.extend((r["key"], r["id"]) for r in rows.collect())
        return spark.createDataFrame([(14, 13)], none)

    assert _rows(linking.link_to_pivots(busy, verify, across), "a", "b") == [(14, 13), (17, 15)]
    assert sorted(seen) == [(2, 13), (2, 14), (3, 16), (3, 17)]


def test_scratch_tables_of_lines(spark, monkeypatch):
    """Lines that are like no other: signatures stay narrow, and no bucket of one line is written."""
    draw, peak = np.random.default_rng(11), []
    syllables = ["".join(x) for x in draw.choice(list("abcdefghijklmnop"), (400, 3))]
    texts = ["".join(draw.choice(syllables, 60)) for _ in range(20_000)]
    folder = Path(line_dedup_of.written(spark.range(1)).inputFiles()[0].removeprefix("file://")).parents[1]
    used = lambda: sum(x.stat().st_size for x in folder.rglob("*.parquet"))
    before, written = used(), linking.written

    def watched(*x):
        out = written(*x)
        peak.append(used() - before)
        return out

    monkeypatch.setattr(line_dedup_of, "written", watched)
    monkeypatch.setattr(linking, "written", watched)
    got = line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert max(peak) < 1.2 * sum(map(len, texts))
    assert got.where("size(kept_lines) < n_lines").isEmpty()


def test_lines_of_odd_rows(spark, docs):
    got = {r["doc_id"]: (r["n_lines"], sorted(r["kept_lines"])) for r in line_dedup(docs).collect()}
    assert got[4] == (0, [])
    assert got[5] == (1, [0])
    assert got[None] == (1, [0])
    assert got[1] == (1, [])
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count()


# op2


def test_chat_reads_back(spark):
    hard = ["\\", "\\\\", "###", "\\###", "</turn>", "</turn>\n", "### Assistant: x", "a\n", "", None, "<\\/turn>", "\\n", "x\\", "😀###", ": ", "</turn"]
    rows = [(i, k, role, text) for i, (k, role, text) in enumerate((k, role, text) for k, text in enumerate(hard) for role in ("user", "assistant", "a: b", "###", None, "</turn>\n"))]
    turns = spark.createDataFrame([(0, i, role, text) for i, _, role, text in rows] + [(None, 1, "user", "x"), (3, None, "assistant", "y"), (3, None, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    want = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in rows)
    assert got[0]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    learned = "".join(text or "" for _, _, role, text in rows if role == "assistant")
    assert got[0]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got[0]["loss_chars"] == len(learned)
    assert (got[None]["n_turns"], got[3]["n_turns"]) == (1, 2)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:"]), st.text(st.sampled_from(list("\\#</turn>\n :a"))))))
@settings(max_examples=5, deadline=None)
def test_chat_of_marks(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] or [(1, 0, "user", "")]
    df = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    assert df.first()["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


# op3


def test_quality_on_held_out_labels(spark):
    """No label is used in training: all of them are held out."""
    sf = "/root/testdata/sf0.01"
    scored = quality_classifier(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = sum((r["keep"] is True) == (r["quality"] == 1) for r in scored) / len(scored)
    kept = [r["keep"] for r in scored if r["quality"] == 1]
    assert right > 0.8
    assert sum(kept) / len(kept) > 0.95


def _document_by_document(patterns, counts, rounds=200):
    """The same expectation maximisation, written for one document and one labeller at a time."""
    rows = [p for p, c in zip(patterns, counts, strict=True) for _ in range(c)]
    m, n = len(rows[0]), len(rows)
    share = []
    for p in rows:
        x = [0.03 if 2 in p else 30.0, *((v == 2) + 1e-4 for v in p)]
        share.append([y / sum(x) for y in x])
    for _ in range(rounds):
        prior, rates = [], []
        for k in range(m + 1):
            prior.append((sum(s[k] for s in share) + 1) / (n + m + 1))
            strength = n if k == 0 else 1
            first = [0.001 if k == 0 else 0.9 if j == k - 1 else 0.1 for j in range(m)]
            rates.append([(sum(s[k] for s, p in zip(share, rows, strict=True) if p[j] == 2) + strength * first[j]) / (sum(s[k] for s, p in zip(share, rows, strict=True) if p[j]) + strength) for j in range(m)])
        new = []
        for p in rows:
            x = [prior[k] * np.prod([1.0 if not v else rates[k][j] if v == 2 else 1 - rates[k][j] for j, v in enumerate(p)]) for k in range(m + 1)]
            new.append([y / sum(x) for y in x])
        moved = max(abs(a - b) for s, t in zip(share, new, strict=True) for a, b in zip(s, t, strict=True))
        if moved < 1e-9:
            break
        share = new
    return {p: 1 - s[0] for p, s in zip(rows, share, strict=True)}, rates


def test_expectation_maximisation_document_by_document():
    draw = np.random.default_rng(2)
    votes_ = [tuple(int(v) for v in draw.choice([0, 1, 1, 1, 2], 3)) for _ in range(60)]
    patterns = sorted(set(votes_))
    counts = [votes_.count(p) for p in patterns]
    want, rates = _document_by_document(patterns, counts)
    got, found = quality.posteriors(np.array(patterns), np.array(counts, float))
    assert np.allclose(got, [want[p] for p in patterns], atol=1e-6)
    assert np.allclose(found, rates, atol=1e-6)


def test_planted_labellers():
    """Labellers of known accuracy: each sees bad text of its own kind in 90 of 100 cases, and is wrong about good text in 1 of 100."""
    draw, n = np.random.default_rng(4), 40_000
    kind = np.where(draw.random(n) < 0.7, 0, draw.integers(1, 5, n))
    bad = draw.random((n, 4)) < np.where(np.arange(1, 5) == kind[:, None], 0.9, np.where(kind[:, None] == 0, 0.01, 0.1))
    votes_ = np.where(draw.random((n, 4)) < 0.1, 0, np.where(bad, 2, 1))
    patterns, place, counts = np.unique(votes_, axis=0, return_inverse=True, return_counts=True)
    got, rates = quality.posteriors(patterns, counts.astype(float))
    assert np.abs(rates[np.arange(1, 5), np.arange(4)] - 0.9).max() < 0.1
    assert rates[0].max() < 0.02
    right = (got[place.reshape(-1)] > 0.5) == (kind > 0)
    assert right.mean() > 0.93


def test_quality_of_odd_rows(spark, docs):
    out = quality_classifier(docs)
    assert {"score_", "keep_", "votes", "n_words"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert all(not r["keep_"] for r in rows if not (r["text"] or "").strip())
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], r["score_"]) == r["score_"]
    model = fit(docs)
    assert _rows(model.score(docs), "doc_id", "score_") == _rows(out, "doc_id", "score_")


# op4


def test_planted_templates(spark):
    item = "the clerk told Maria that the parcel weighs 12 kg and later Maria paid 30 dollars for the parcel"
    again = "Well: the clerk told Peter that the parcel weighs 95 kg and later Peter paid 12 dollars for the parcel, he said"
    mixed = "the clerk told Peter that the parcel weighs 95 kg and later Susan paid 12 dollars for the parcel"
    other = "The weather in Lisbon was fine for 3 days and Maria went to the sea with her mother and two friends"
    rows = spark.createDataFrame([(1, f"before {item} after"), (2, again), (3, mixed), (4, other), (5, None), (None, item), (1, f"before {item} after")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id bigint, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination(rows, items).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, None: True}
    assert sorted(r["doc_id"] for r in decontaminated(rows, items).collect()) == [3, 4, 5]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_both_joins_find_null_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    test_planted_templates(spark)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_copies_in_another_case(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    item = "the Clerk told Maria that Anna and Peter weighed 12 kg of Apples in Berlin before Noon"
    rows = spark.createDataFrame([(1, item.upper()), (2, f"so {item.lower()} again"), (3, item), (4, "THE WEATHER IN LISBON WAS FINE FOR 3 DAYS AND WE WENT TO THE SEA")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination(rows, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}


def test_exact_runs_count_on_inconsistent_diagonals(spark):
    rest = "the old clerk of the town walked slowly home with De Vries and all of his seven brothers every day of the long winter"
    item = f"De Haan said that {rest}"
    rows = spark.createDataFrame([(1, f"Van Haan said that {rest}"), (2, "De Haan said that it rained all day")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], r["most_covered"]) for r in decontamination(rows, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (True, len(item.split()) - 1), 2: (False, 0)}


# op5


def test_windows_of_odd_rows(spark, docs):
    got = {}
    for r in substring_dedup(docs).collect():
        assert got.setdefault(r["doc_id"], r) == r or r["doc_id"] == 12
    assert (got[4]["n_words"], got[4]["kept"]) == (0, "")
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == got[2]["n_words"] == len(PROSE.split())
    assert got[8]["n_removed"] == len(LONG.split())
    assert got[None]["n_removed"] == 0
    digests = substring_dedup(docs, texts=False).where("doc_id = 2").first()
    assert digests["kept"] == hashlib.sha256(b"").hexdigest()


def _windows_found(docs, window=13):
    """What the two exchanges compare, within one task: groups of (document, place) of windows with one name."""
    w = words(pa.array([" ".join(d) for d in docs], pa.string()))
    name, row, low, high = substring.symbols(w, window)
    owners = {}
    for n, r in zip(name.tolist(), row.tolist(), strict=True):
        owners.setdefault(n, set()).add(r)
    shared = np.array([len(owners[n]) > 1 for n in name.tolist()], bool)
    found = {}
    for n, at in zip(*(x.tolist() for x in substring.candidates(w, window, name, low, high, shared)), strict=True):
        found.setdefault(n, set()).add((int(w.row[at]), at - int(w.bounds[w.row[at]])))
    return {frozenset(g) for g in found.values() if len({d for d, _ in g}) > 1}


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_symbols_reveal_all_repeats(data):
    vocabulary = data.draw(st.sampled_from([["a"], ["a", "b"], [f"w{i}" for i in range(30)]]))
    pool = data.draw(st.lists(st.lists(st.sampled_from(vocabulary), max_size=50), min_size=1, max_size=4))
    docs = [sum(x, []) for x in data.draw(st.lists(st.lists(st.sampled_from(pool), max_size=3), min_size=1, max_size=6))]
    same = {}
    for d, x in enumerate(docs):
        for i in range(len(x) - 12):
            same.setdefault(tuple(x[i : i + 13]), set()).add((d, i))
    assert _windows_found(docs) == {frozenset(g) for g in same.values() if len({d for d, _ in g}) > 1}


def test_without_symbols_nothing_is_found(monkeypatch):
    docs = [[f"w{i}" for i in range(40)]] * 2
    assert len(_windows_found(docs)) == 28
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    monkeypatch.setattr(substring, "symbols", lambda w, window: none)
    assert not _windows_found(docs)


# op6


def test_mix_laws(spark, docs):
    rows = mix(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["target"] <= 2 * own[0]["source_size"]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert _rows(mix(docs.repartition(7)), "doc_id", "taken", "position") == _rows(mix(docs), "doc_id", "taken", "position")
    out = mixed_documents(docs, position_col="at")
    assert out.columns == [*docs.columns, "at"]
    # Each row's turns stand at positions of their own, the first where the mix has it, and rows come in their order.
    at = [r["at"] for r in out.collect()]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    first = {(r["doc_id"], r["text"]): min(x["at"] for x in out.collect() if (x["doc_id"], x["text"]) == (r["doc_id"], r["text"])) for r in out.collect() if r["doc_id"] != 12}
    assert sorted(first.values()) == sorted(r["position"] for r in rows if r["taken"] and r["doc_id"] != 12)
    out = out.drop("at")
    assert out.columns == docs.columns
    assert {r["text"] for r in out.collect()} <= {t for _, t, _, _ in TEXTS}
    assert any(r["doc_id"] is None for r in out.collect()) == any(r["taken"] for r in rows if r["doc_id"] is None)


# op7


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_as_by_the_library(spark, docs, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    odd = [(100, "a  b\u00a0c \n\n d"), (101, "  lead"), (102, "x\r\n\r\ny  "), (103, "<|endoftext|> z"), (104, " "), (105, "\n\n")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string")).where("doc_id is not null").dropDuplicates(["doc_id"])
    token_store.write_tokens(table, str(tmp_path / "t"), vocabulary)
    got = sorted(token_store.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (_, text) in zip(got, sorted(map(tuple, table.collect())), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)


def test_long_documents_and_many_units(vocabulary, monkeypatch):
    monkeypatch.setattr(token_store, "UNIT", 1500)
    monkeypatch.setattr(token_store, "REMEMBERED", 5)
    texts = [(i, f"word{i} " * (1 + i * i * 40) + "end") for i in range(12)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in texts], "text": [t for _, t in texts]})
    monkeypatch.setattr(token_store.TaskContext, "get", lambda: type("Here", (), {"partitionId": lambda self: 0})())
    units = list(token_store._units(iter([batch.slice(0, 7), batch.slice(7)]), vocabulary, 0))
    assert len(units) > 3
    got = [r for b in token_store._decoded(iter(units), True) for r in b.to_pylist()]
    encoder = token_store.Encoder(vocabulary)
    for r, (i, text) in zip(got, texts, strict=True):
        assert r["id"] == i and r["ids"] == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_known_words_take_little_memory(vocabulary):
    """A worker keeps the words of its tasks: their letters, their ids and a few bytes."""
    draw = np.random.default_rng(12)
    texts = [" ".join(map("".join, draw.choice(list("abcdefghijklmnop"), (10_000, 6)))) for _ in range(20)]
    encoder = token_store.Encoder(vocabulary)
    tracemalloc.start()
    before, held = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes()
    for text in texts:
        ids, n = encoder.encode(pa.array([text]))
        assert n.tolist() == [len(ids)]
    assert ids.tolist() == encoder.tokenizer.encode(texts[-1], add_special_tokens=False).ids
    del ids
    kept = tracemalloc.get_traced_memory()[0] - before + pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert len(encoder.known) > 190_000
    assert kept < 100 * len(encoder.known)


def test_blocks_by_themselves():
    ids = np.random.default_rng(1).integers(0, 900, 5000).astype(np.uint32)
    unit = token_store.compress(ids)
    part = token_store.expand(2 * token_store.BLOCK, **unit, blocks=slice(1, 3))
    assert (part == ids[token_store.BLOCK : 3 * token_store.BLOCK]).all()
    unit["crcs"] = unit["crcs"] ^ np.uint32(1)
    with pytest.raises(ValueError, match="checksum"):
        token_store.expand(len(ids), **unit)


def test_damaged_tokens_are_noticed(spark, vocabulary, tmp_path):
    token_store.write_tokens(spark.createDataFrame([(1, "some text")], "doc_id bigint, text string"), str(tmp_path / "t"), vocabulary)
    bad = spark.read.parquet(str(tmp_path / "t")).withColumn("crcs", F.unhex(F.lit("00000001")))
    bad.write.parquet(str(tmp_path / "u"))
    with pytest.raises(Exception, match="checksum"):
        token_store.read_tokens(spark, str(tmp_path / "u")).collect()


@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=5000))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint32)
    packed = token_store.compress(ids)
    assert np.array_equal(token_store.expand(len(ids), **packed), ids)
    if len(ids) > token_store.BLOCK:
        own = token_store.expand(token_store.BLOCK, **packed, blocks=slice(1, 2))
        assert np.array_equal(own[: len(ids) - token_store.BLOCK], ids[token_store.BLOCK : 2 * token_store.BLOCK])


# op8


def _near_classes(texts, k, percent):
    import pyarrow as pa

    w = words(pa.array(texts, pa.string()), lower=True)
    name, bounds = sets(w, k)
    own = [set(name[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if own[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]):
                x, y = part[a], part[b]
                part = [min(x, y) if p in (x, y) else p for p in part]
    return part


def test_near_duplicates_as_by_brute_force(spark):
    draw = np.random.default_rng(11)
    base = [list(draw.choice([f"v{i}" for i in range(300)], 60)) for _ in range(12)]
    texts = []
    for _ in range(160):
        text = list(base[int(draw.integers(len(base)))])
        for _ in range(int(draw.integers(0, 6))):
            text[int(draw.integers(len(text)))] = f"n{int(draw.integers(1000))}"
        texts.append(" ".join(text))
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=3).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == _near_classes(texts, 3, 80)


def test_near_duplicates_of_odd_rows(spark, docs):
    got = near_duplicates(docs, shingle=2).collect()
    assert len(got) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert by_id[8]["component_id"] == 7
    assert by_id[10]["component_id"] == 9
    assert (by_id[4]["n_shingles"], by_id[4]["component_id"], by_id[4]["kept"]) == (0, 4, True)
    assert by_id[5]["component_id"] == 5 and by_id[6]["component_id"] == 6
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]


def test_ids_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = spark.createDataFrame([(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (4, "z"), (4, "z")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(rows).collect())
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    assert sorted(r["text"][:2] for r in near_dup.deduplicated(rows).collect()) == ["a0", "b0", "z"]


@pytest.mark.parametrize("block", [4, 2048])
def test_outsiders_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    draw, texts = np.random.default_rng(11), []
    core = [f"w{i}" for i in range(120)]
    for _ in range(60):
        words_ = list(core)
        for at in draw.choice(120, int(draw.integers(0, 9)), replace=False):
            words_[at] = f"x{draw.integers(10**6)}"
        texts.append(" ".join(words_))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=2).collect()}
    assert [got[i] for i in range(len(texts))] == _near_classes(texts, 2, 80)


# op9


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], np.float64)
    got = {}
    for r in nearest(table, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        order = [int(j) for j in np.lexsort((ids, -score)) if j != q][:20]
        found = got[int(ids[q])]
        assert sorted(found) == list(range(1, 21))
        hits += len({ids[j] for j in order} & {i for i, _ in found.values()})
        wanted += 20
        for i, s in found.values():
            assert abs(s - float(v[np.searchsorted(ids, i)] @ v[q])) < 1e-9
    assert hits / wanted >= 0.9


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_recall_of_many(spark, tmp_path, n):
    v = np.random.default_rng(n).standard_normal((n, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), tmp_path / "v.parquet", row_group_size=n // 8)
    table, ask = spark.read.parquet(str(tmp_path / "v.parquet")), f"vec_id % {n // 40} = 0"
    got = {}
    for r in nearest(table, ask).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, n, n // 40):
        score = v.astype(np.float64) @ v[q].astype(np.float64)
        score[q] = -9
        assert len(got[q]) == 20
        hits += len(set(np.argsort(-score)[:20].tolist()) & got[q])
    assert hits / (20 * len(got)) >= 0.9
    # Only a part is scored.
    scored = [r["count"] for r in _search(table, ask, 20, "vec_id", "embedding", 9, keep=n).groupBy("query_id").count().collect()]
    assert len(scored) == len(got)
    assert sum(scored) / len(scored) < 0.75 * n


@pytest.mark.parametrize("longest", [1.0, 30.0])
def test_all_queries_are_answered_above_the_floor(spark, monkeypatch, longest):
    monkeypatch.setattr(ann, "BLOCK", 16)
    n, draw = 5000, np.random.default_rng(4)
    v = draw.standard_normal((n, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[1] *= longest
    got = {}
    for r in nearest(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>"), "vec_id % 100 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(got) == list(range(0, n, 100))
    assert all(sorted(found) == list(range(1, 21)) for found in got.values())
    hits = 0
    for q, found in got.items():
        score = v @ v[q]
        score[q] = -99
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(found.values()))
    assert hits / (20 * len(got)) >= 0.9


def test_long_vectors_do_not_hide_the_others(spark, tmp_path):
    n = 30_000
    v = np.random.default_rng(3).standard_normal((n, 16))
    v[7] *= 20
    flat = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), 16).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat}), tmp_path / "v.parquet")
    table, ask = spark.read.parquet(str(tmp_path / "v.parquet")), f"vec_id % {n // 40} = 0"
    found = [tuple(r) for r in _search(table, ask, 20, "vec_id", "embedding", 9, keep=n).select("query_id", "vec_id").collect()]
    hits = 0
    for q in range(0, n, n // 40):
        mine = {i for x, i in found if x == q}
        score = v @ v[q]
        score[q] = -1e9
        best = np.argsort(-score)[:20]
        assert len(mine) >= 20
        hits += len(set(best.tolist()) & mine)
    assert hits / (20 * 40) >= 0.9
    assert len(found) / 40 < 0.5 * n


def test_vectors_that_share_an_id_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.5, 3.0]), (2, [0.5, 1.0]), (3, [0.5, 2.0]), (4, [0.5, 4.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4), "vec_id = 0", k=3)
    assert _rows(got, "rank", "vec_id", "score") == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, 0.5)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    got = nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, id string"), "vec_id % 20 = 0", k=5)
    assert _rows(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 8, 1.0), (0, 2, 1, 0.5)]


# op10


def test_shards(spark, docs):
    rows = shard_index(docs, shards=4).collect()
    assert len(rows) == len(TEXTS)
    count = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in count.values())
    assert max(map(len, count.values())) - min(map(len, count.values())) <= 1
    for r in rows:
        data = next((t or "").encode() for i, t, _, _ in TEXTS if i == r["doc_id"])
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert _rows(shard_index(docs.repartition(5), shards=4), "doc_id", "shard", "slot") == _rows(shard_index(docs, shards=4), "doc_id", "shard", "slot")
    out = sharded(docs, shards=4)
    assert out.columns == [*docs.columns, "shard_", "slot_"]
    assert json.dumps(_rows(out, *docs.columns)) == json.dumps(_rows(docs, *docs.columns))


def test_the_shards_hold_the_documents(spark):
    """Whole rows are in the files that the index is read from, a folder for each shard."""
    out = QUERIES["op10_sharding"](spark, SF)
    folder = out.inputFiles()[0].rsplit("/", 2)[0]
    held, docs = spark.read.parquet(folder), spark.read.parquet(f"{SF}/documents.parquet")
    assert set(held.columns) == {*docs.columns, "shard", "slot"}
    assert _rows(held, *docs.columns) == _rows(docs, *docs.columns)
    assert _rows(held, "doc_id", "shard", "slot") == _rows(out, "doc_id", "shard", "slot")


def test_large_rows_make_more_buckets(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), 1 << 20).alias("text"))
    out = sharded(rows, bucket_rows=4096)
    assert out.count() == 40
    assert sum(1 for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n) > 4


def test_the_order_depends_on_rows_and_seed_only(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 977).alias("text"))
    order = lambda df: [(r["shard"], r["slot"], r["doc_id"]) for r in df.orderBy("shard", "slot").collect()]
    first = order(shard_index(rows))
    assert len(first) == 60_000 and first != sorted(first, key=lambda r: r[2])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert order(shard_index(rows.repartition(7))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert order(shard_index(rows, seed=11)) != first


def test_a_third_of_equal_rows_fills_no_bucket(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.range(4000).select(F.lit(5).cast("bigint"), F.lit("t")))
    out = sharded(rows, bucket_rows=500)
    sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == 12_000 and max(sizes) < 800
    got = [(r["shard"], r["slot"], r["doc_id"]) for r in out.orderBy("shard", "slot").collect()]
    assert got == [(r["shard"], r["slot"], r["doc_id"]) for r in sharded(rows.repartition(3), bucket_rows=500).orderBy("shard", "slot").collect()]
    assert sorted(i for _, _, i in got) == sorted([*range(8000), *[5] * 4000])


# all of them


def test_empty_tables(spark, docs, vocabulary, tmp_path):
    none = docs.where("false")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for out in (line_dedup(none), deduplicated(none), quality_classifier(none), decontamination(none, items), decontaminated(docs, items).where("false"), substring_dedup(none), mix(none), mixed_documents(none), near_duplicates(none), shard_index(none), sharded(none)):
        assert out.count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), "vec_id % 20 = 0").count() == 0
    token_store.write_tokens(none, str(tmp_path / "t"), vocabulary)
    assert token_store.read_tokens(spark, str(tmp_path / "t")).count() == 0
