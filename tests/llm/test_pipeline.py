"""The corpus pipeline, stage by stage and as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_operators import _near_classes, _rows
from textloom.llm.mixing import mix
from textloom.llm.quality import quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names():
    assert [name for name, _ in C.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]


def test_quality_keeps_clean_documents(spark, docs):
    kept = C.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    assert _rows(kept, "doc_id") == _rows(quality_classifier(docs).where("keep"), "doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id").select("doc_id")
    assert clean.join(kept, "doc_id").count() >= 0.95 * clean.count()


def test_one_of_each_group_stays(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    part = _near_classes([t for _, t in rows], 5, 80)
    want = [(i,) for k, (i, _) in enumerate(rows) if part[k] == k]
    assert _rows(C.near_dedup(spark, docs, SF), "doc_id") == sorted(want, key=str)


def test_stages_take_odd_rows(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "other words", "en", None, 11), (2, "x " * 3000, "en", "a", 6000), (2, "x " * 3000, "en", "a", 6000)], docs.schema)
    with_more = odd.withColumns({"shard": F.lit("s"), "id": F.lit(1), "tag": F.lit(2), "_bucket": F.lit("b")})
    for rows in (odd, with_more, odd.where("false")):
        for name, stage in C.STAGES:
            out = stage(spark, rows, SF)
            extra = [] if name != "sharding" else ["shard_" if "shard" in rows.columns else "shard", "slot"]
            assert out.columns == [*rows.columns, *extra], name
            assert out.count() <= 2 * rows.count()
    assert C.sharding(spark, odd, SF).count() == 5
    assert sorted(r["text"] or "" for r in C.near_dedup(spark, odd, SF).collect()) == ["", "", "other words", "x " * 3000]


def test_decontaminate_takes_out_what_is_contaminated(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").limit(1).first()["text"]
    planted = spark.createDataFrame([(-1, f"before {items} after", "en", "a", 9), (-2, "nothing of it here", "en", "a", 9)], docs.schema)
    assert _rows(C.decontaminate(spark, planted, SF), "doc_id") == [(-2,)]


def test_mixing_begins_documents_as_often_as_taken(spark, docs):
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mix(docs).collect() if r["taken"]}
    got = {}
    for (i,) in _rows(C.mixing(spark, docs, SF), "doc_id"):
        got[i] = got.get(i, 0) + 1
    assert got == taken


def test_run(spark, docs):
    out = C.run(spark, SF).cache()
    assert out.columns == [*docs.columns, "shard", "slot"]
    by_hand = docs
    for _, stage in C.STAGES[:-1]:
        by_hand = stage(spark, by_hand, SF)
    assert _rows(out, "doc_id") == _rows(by_hand, "doc_id")
    counts = [n for _, n in _rows(out.groupBy("shard").count(), "shard", "count")]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
