"""Evaluation sets: contracts of questions and gold labels, labels by rule, frozen samples of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.hashing import sha_hex
from provena.operators.constraints import duplicates, has_text, query_only, union_all, unmatched, violations
from provena.operators.sampling import hash_quota

REVIEW_STATES = ("pending_engineer_review", "approved")
HUMAN, PROXY = "human_engineer_review", "ai_proxy"


def set_violations(items: DataFrame, excerpts: DataFrame, least: int = 50, least_unanswerable: int = 10) -> DataFrame:
    """Questions that break the contract of an evaluation set, and the set's size.

    items: id, dut_id, role, index_as_history, question, result, category, expected_status, review_status, source,
    first_line, last_line, excerpt_sha256. excerpts: id, excerpt_sha256 and n_lines of those lines now, one row where
    the source holds all of them.
    """
    now = excerpts.select("id", F.col("excerpt_sha256").alias("_sha"), F.col("n_lines").alias("_n"))
    rules = {
        "query_only": (query_only(F.col("role"), F.col("index_as_history")), "must stay out of the history"),
        "question": (has_text(F.col("question")) & (F.col("result") == "FAIL"), "needs a question and a failed test"),
        "path": (has_text(F.col("source")) & ~F.col("source").startswith("/") & ~F.concat(F.lit("/"), "source", F.lit("/")).contains("/../"), "source lies outside"),
        "lines": ((F.col("first_line") >= 1) & (F.col("first_line") <= F.col("last_line")) & (F.col("_n") == F.col("last_line") - F.col("first_line") + 1), "lines outside the source"),
        "excerpt": (F.col("_sha") == F.col("excerpt_sha256"), "excerpt has changed"),
        "unanswerable": ((F.col("category") != "no_answer") | (F.col("expected_status") == "refuse"), "must be refused"),
        "review": (F.col("review_status").isin(*REVIEW_STATES), "unknown state of review"),
    }
    sizes = items.agg(F.count("*").alias("n"), F.count_if(F.col("category") == "no_answer").alias("none")).withColumn("set", F.lit("set"))
    counts = violations(sizes, "set", {"size": (F.col("n") >= least, "too few questions"), "size-unanswerable": (F.col("none") >= least_unanswerable, "too few unanswerable questions")})
    return union_all([violations(items.join(now, "id", "left"), "id", rules), duplicates(items, ["id"], "id"), duplicates(items, ["dut_id"], "dut_id"), counts])


def gold_violations(gold: DataFrame, items: DataFrame, origin: str = HUMAN, allow_proxy: bool = False) -> DataFrame:
    """Labels (id, expected_status, acceptable_cause_ids, acceptable_check_ids, review_status, reviewer, labeler) that break their contract.

    Labels by rule must be asked for, name their maker and no reviewer; others need an approval and a reviewer.
    """
    causes, checks, status = F.col("acceptable_cause_ids"), F.col("acceptable_check_ids"), F.col("expected_status")
    by_rule = (F.col("review_status") == "proxy") & has_text(F.col("labeler")) & ~has_text(F.col("reviewer"))
    both, neither = (F.size(causes) > 0) & (F.size(checks) > 0), F.size(causes) + F.size(checks) == 0
    rules = {
        "origin": (F.lit(origin == HUMAN or (origin == PROXY and allow_proxy)), "labels of this origin are not allowed"),
        "review": (by_rule if origin == PROXY else (F.col("review_status") == "approved") & has_text(F.col("reviewer")), "review does not fit the origin"),
        "status": (status.isin("unconfirmed", "refuse"), "unknown status"),
        "texts": (F.forall(causes, has_text) & F.forall(checks, has_text), "ids must be texts"),
        "fits": (F.when(status == "refuse", neither).otherwise(both), "ids do not fit the status"),
    }
    return union_all([violations(gold, "id", rules), duplicates(gold, ["id"], "id"), unmatched(gold, items, ["id"], "covered")])


def rule_labels(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels by rule: id, expected_status, acceptable_cause_ids, acceptable_check_ids, review_status.

    items: id, category, test_number, pins, direction. rules: test_number, direction (null: any), needs (pins that must all
    be there), kind, item_id. Unanswerable items and those without a cause or a check are to be refused.
    """
    pins = F.transform("pins", lambda p: F.upper(p))
    r = rules.select("test_number", F.col("direction").alias("_side"), F.col("needs").alias("_needs"), "kind", "item_id")
    fits = (F.col("category") != "no_answer") & F.coalesce(F.col("_side") == F.col("direction"), F.col("_side").isNull()) & (F.size(F.array_except("_needs", pins)) == 0)
    found = items.join(r, "test_number", "left").withColumn("_ok", F.coalesce(fits, F.lit(False)))
    ids = lambda kind: F.array_sort(F.collect_set(F.when(F.col("_ok") & (F.col("kind") == kind), F.col("item_id"))))
    out = found.groupBy("id").agg(ids("cause").alias("c"), ids("check").alias("k"))
    full, none = (F.size("c") > 0) & (F.size("k") > 0), F.array().cast("array<string>")
    return out.select(
        "id", F.when(full, "unconfirmed").otherwise("refuse").alias("expected_status"), F.when(full, F.col("c")).otherwise(none).alias("acceptable_cause_ids"),
        F.when(full, F.col("k")).otherwise(none).alias("acceptable_check_ids"), F.lit("proxy").alias("review_status"),
    )


def label_totals(labels: DataFrame, options: DataFrame, n: int, refusals: int) -> DataFrame:
    """Violations of how many labels and refusals there must be, and labels that name an item which is no option (id, item_id)."""
    sizes = labels.agg(F.count("*").alias("n"), F.count_if(F.col("expected_status") == "refuse").alias("r")).withColumn("set", F.lit("labels"))
    counts = violations(sizes, "set", {"n": (F.col("n") == n, "another number of labels"), "refusals": (F.col("r") == refusals, "another number of refusals")})
    named = labels.select("id", F.explode(F.concat("acceptable_cause_ids", "acceptable_check_ids")).alias("item_id"))
    lost = named.join(options.select("id", "item_id").distinct(), ["id", "item_id"], "left_anti")
    return union_all([counts, lost.select(F.lit("option").alias("rule_id"), F.concat_ws("/", "id", "item_id").alias("entity_key"), F.lit("is no option").alias("message"))])


def frozen_sample(failures: DataFrame, bands: dict[str, tuple[int, int, int]], salt: str, test: str = "failed_test", key: str = "dut_id") -> DataFrame:
    """Failures in the order of a salted hash within their test, cut into named bands: category, rank and the failure's columns.

    bands: category -> (test, first rank, last rank).
    """
    last = max(b for _, _, b in bands.values())
    ranked = hash_quota(failures, [test], sha_hex(salt, F.col(key)), key, last)
    category = F.coalesce(*(F.when((F.col(test) == t) & F.col("rank").between(a, b), F.lit(name)) for name, (t, a, b) in bands.items()))
    return ranked.withColumn("category", category).filter("category is not null")


def review_sheet(template: DataFrame, items: DataFrame) -> DataFrame:
    """The template's rows with their questions; a row without one stays, with null."""
    return template.join(items.select("id", "question"), "id", "left")


def metrics_as_specified(results: DataFrame, by: list[str]) -> DataFrame:
    """Rates as a specification names them: over all questions n, answerable ones and answered ones; null where there are none.

    results: by, answerable, answered, correct (all boolean). acc: correct among answerable; far: wrong answers among all;
    answered_error: wrong among answered; coverage: answered among all; correct_refusal: refused among unanswerable.
    """
    a, s, c = F.col("answerable"), F.col("answered"), F.col("correct")
    share = lambda hit, among: F.try_divide(F.count_if(hit).cast("double"), F.count_if(among))
    every: Column = F.lit(True)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), share(a & s & c, a).alias("acc"), share(s & ~c, every).alias("far"), share(s & ~c, s).alias("answered_error"),
        share(s, every).alias("coverage"), share(~a & ~s, ~a).alias("correct_refusal"),
    )
