"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import random

import corpus_pipeline
from provena.llm import secrets
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    good = [" ".join(word() for _ in range(80)) for _ in range(160)]
    bad = [" ".join(word() + "&&&" for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    rows += [(300, good[0], "en", "s", 1), (301, good[1] + " extra", "en", "s", 1), (302, good[2] + " token = " + "0123456789abcdef" * 2, "en", "s", 1), (303, "short", "en", "s", 5), (304, None, "en", "s", None)]
    labels = [(i, int(i < 160), 0) for i in range(200)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), DOCS.replace(" long", "").replace(" string", "").split(", "), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
            sizes.append({r["doc_id"] for r in docs.collect()})
    assert not sizes[0] & set(range(160, 200)) and len(sizes[0] & set(range(160))) > 150
    assert not sizes[1] & {303, 304} and sizes[1] <= sizes[0]
    assert not sizes[2] & {300, 301, 302} and {0, 1, 2} & sizes[2] == {0, 1, 2} & sizes[1]
    assert sizes[3] == sizes[2] and not any(secrets.base_spans(r["text"]) for r in docs.collect())
    packed = out.collect()
    assert {r["doc_id"] for r in packed} == sizes[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_rows_and_none(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns, one very long text; and empty tables, stage by stage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    long_ = " ".join(word() for _ in range(60_000))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s", 1) for i in range(40)]
    rows += [rows[0], (None, " ".join(word() for _ in range(60)), None, None, None), (100, None, None, None, None), (101, "", "en", "s", 0), (102, long_, "en", "s", len(long_))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("class_id", F.lit(2)).withColumn("near", F.lit("n")).withColumn("spans", F.lit("s"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    folders = {}
    for name, d, l in (("odd", docs, labels), ("none", docs.limit(0), labels.limit(0))):
        folders[name] = f"{tmp_path}/{name}"
        d.write.parquet(f"{folders[name]}/documents.parquet")
        l.write.parquet(f"{folders[name]}/labels.parquet")
    for name, folder in folders.items():
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept, folder)
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(f"{folder}/stage{k}")
            kept = spark.read.parquet(f"{folder}/stage{k}")
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids == ({None, *range(40), 102} if name == "odd" else set())
        if name == "odd":
            assert spark.read.parquet(f"{folder}/stage2").filter("doc_id = 0").count() == 1
            assert sum(r["length"] for r in kept.filter("doc_id = 102").collect()) == kept.filter("doc_id = 102").first()["doc_tokens"] > 60_000
    assert corpus_pipeline.run(spark, folders["none"]).collect() == []
