"""Audits of runs: saved answers against rows, citations, runtime responses, decode rates and power samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.constraints import duplicates, finite_positive, union_all, unmatched, violations

RUN_ID = "^[0-9a-f]{32}$"
MARGIN = 64  # tokens that stay free
RESPONSE = (
    "struct<choices:array<struct<finish_reason:string,message:struct<content:string>>>,usage:struct<prompt_tokens:long,completion_tokens:long>,"
    "metrics:struct<requested_max_tokens:long,effective_max_tokens:long,max_tokens_clamped_to_context:boolean,decode_tokens_per_second:double,"
    "context:struct<original_messages:int,effective_messages:int,dropped_messages:int,history_truncated:boolean,system_dropped:boolean,original_prompt_tokens:long,effective_prompt_tokens:long>,"
    "backend:struct<fallback_disabled:boolean,prefill_on_device:boolean,stages:array<string>>>>"
)


def run_violations(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Benchmark rows (id, run_id, status, cause_ids, check_ids) that repeat, or differ from the saved answers of their run.

    answers: run_id, status, cause_ids, check_ids. Ids must be equal in order; what is no answer may hold none.
    """
    # What one side alone tells is judged before the join; lists of ids go through it as one text that is equal where they are.
    listed = F.when(F.col("cause_ids").isNotNull() & F.col("check_ids").isNotNull(), F.to_json(F.array("cause_ids", "check_ids")))
    saved = answers.select("run_id", F.col("status").alias("_status"), listed.alias("_ids"))
    told = rows.select(
        "run_id", "id", "status", listed.alias("ids"), F.col("run_id").rlike(RUN_ID).alias("named"),
        ((F.col("status") == "unconfirmed") | (F.size("cause_ids") + F.size("check_ids") == 0)).alias("fits"),
    )
    both = told.join(saved, "run_id", "left")
    rules = {
        "run": (F.col("named"), "no run id"),
        "answer": (F.col("_status").isNotNull(), "no saved answer"),
        "status": (F.col("_status").eqNullSafe(F.col("status")), "status differs from the saved answer"),
        "ids": (F.col("_ids") == F.col("ids"), "ids differ from the saved answer"),
        "empty": (F.col("fits"), "no answer, but suggestions"),
    }
    return union_all([violations(both, "id", rules), duplicates(rows, ["id"], "repeated")])


def citation_audit(items: DataFrame, broken: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per run: citations, valid ones, and the ids that verification does not support, in order; nothing is repaired.

    items: run_id, item_id. broken: violations of citations with entity_key run_id/item_id. rejected: run_id, item_id.
    """
    key = F.concat_ws("/", "run_id", "item_id")
    bad = broken.select(F.col("entity_key").alias("_key")).distinct().withColumn("_bad", F.lit(True))
    unsupported = rejected.select("run_id", "item_id").distinct().withColumn("_unsupported", F.lit(True))
    rows = items.withColumn("_key", key).join(bad, "_key", "left").join(unsupported, ["run_id", "item_id"], "left")
    return rows.groupBy("run_id").agg(
        F.count("*").alias("citation_count"), F.count_if(F.col("_bad").isNull()).alias("valid_citation_count"),
        F.array_sort(F.collect_list(F.when(F.col("_unsupported"), F.col("item_id")))).alias("unsupported_ids"),
    )


def response_violations(responses: DataFrame, context: int, key: str = "run_id") -> DataFrame:
    """Responses (expected_input, output_tokens, response as RESPONSE) that are cut, changed, recounted, or made elsewhere than asked.

    What a response does not say counts as broken.
    """
    r = lambda path: F.col(f"response.{path}")
    kept = (r("metrics.context.original_messages") == 1) & (r("metrics.context.effective_messages") == 1) & (r("metrics.context.dropped_messages") == 0)
    used = r("metrics.context.effective_prompt_tokens")
    rules = {
        "one": (F.size(r("choices")) == 1, "needs one choice"),
        "finished": (F.get(r("choices"), 0)["finish_reason"] == "stop", "is cut"),
        "text": (F.trim(F.get(r("choices"), 0)["message"]["content"]) != "", "has no text"),
        "messages": (kept & ~r("metrics.context.history_truncated") & ~r("metrics.context.system_dropped"), "messages were changed"),
        "tokens": ((r("metrics.context.original_prompt_tokens") == F.col("expected_input")) & (used >= F.col("expected_input")) & (r("usage.prompt_tokens") == used), "tokens were counted otherwise"),
        "budget": (
            (r("metrics.requested_max_tokens") == F.col("output_tokens")) & (r("metrics.effective_max_tokens") == F.col("output_tokens"))
            & ~r("metrics.max_tokens_clamped_to_context") & (used + F.col("output_tokens") + MARGIN <= context), "the output budget was changed",
        ),
        "device": (r("metrics.backend.fallback_disabled") & r("metrics.backend.prefill_on_device") & F.forall(r("metrics.backend.stages"), lambda s: s.startswith("npu")), "was not made on the device"),
    }
    return violations(responses, key, rules)


def decode_rates(documents: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, seconds and samples over all attempts of a run; samples without a positive count and rate do not count.

    documents: by, n_tokens, tokens_per_second. Seconds are sums of tokens by rate, so that their quotient is the rate.
    """
    ok = finite_positive(F.col("n_tokens")) & finite_positive(F.col("tokens_per_second"))
    n = F.when(ok, F.col("n_tokens"))
    return documents.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("decode_tokens"), F.coalesce(F.sum(n / F.col("tokens_per_second")), F.lit(0.0)).alias("decode_seconds"), F.count(n).alias("decode_samples")
    )


def power_violations(samples: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Samples that are no positive number, and cases that only one side knows."""
    wrong = violations(samples, case, {"watts": (finite_positive(F.col("watts")), "no positive number")})
    return union_all([wrong, unmatched(samples, cases, [case], "covered")])


def attempts_of(selections: list[DataFrame]) -> DataFrame:
    """All attempts of all runs as rows, numbered from one; none is overwritten."""
    return union_all([s.withColumn("attempt", F.lit(i)) for i, s in enumerate(selections, 1)])


def source_changes(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Cited files (file, sha256) that are gone or have another hash now."""
    now = files.select(F.col("path").alias("file"), F.col("sha256").alias("_now"))
    both = cited.select("file", "sha256").distinct().join(now, "file", "left")
    return violations(both, "file", {"there": (F.col("_now").isNotNull(), "is gone"), "same": (F.coalesce(F.col("_now"), F.col("sha256")) == F.col("sha256"), "has changed")})


def prefix_violations(done: DataFrame, planned: DataFrame, by: str = "variant") -> DataFrame:
    """Completed items (by, pos, id) that are not the first planned ones (pos, id) in order."""
    both = done.join(planned.select("pos", F.col("id").alias("_id")), "pos", "left")
    last = done.groupBy(by).agg(F.max("pos").alias("last"), F.count("*").alias("n"))
    order = violations(both, F.concat_ws("/", by, F.col("pos").cast("string")), {"order": (F.col("id") == F.col("_id"), "not the planned item")})
    return union_all([order, violations(last, by, {"gap": (F.col("last") == F.col("n"), "items are missing before the last one")})])


def same_configuration(saved: Column, now: Column) -> Column:
    """Whether a run may be resumed: every part of the configuration is as it was."""
    return saved.eqNullSafe(now)
