"""Scoring of runs: exact percentiles, rates that are null where nothing was measured, energy and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(x: Column) -> Column:
    """Exact and interpolated."""
    return F.percentile(x, 0.5)


def nearest_rank(x: str, share: float = 0.95) -> Column:
    """The value at the nearest rank, never interpolated."""
    return F.expr(f"percentile_disc({share}) within group (order by {x})")


def rate(hit: Column, among: Column | None = None) -> Column:
    """Share of rows that hit among those named; null where there are none."""
    if among is None:
        return F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)))
    return F.try_divide(F.count_if(hit & among).cast("double"), F.count_if(among))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def accepted(status: Column, expected: Column, causes: Column, ok_causes: Column, checks: Column, ok_checks: Column) -> Column:
    """A refusal where one is expected, or an answer of some causes and checks, all of them acceptable."""
    answered = (status == "unconfirmed") & (expected == "unconfirmed") & (F.size(causes) > 0) & (F.size(checks) > 0)
    return ((status == "refuse") & (expected == "refuse")) | (answered & subset(causes, ok_causes) & subset(checks, ok_checks))


def hit_at(ids: Column, ok: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(ids, 1, k), ok)


def summarise(results: DataFrame, gold: DataFrame, by: list[str], proxy: bool = False) -> DataFrame:
    """One row per run of results joined with gold on id: latency, rates, and hit rates on answered questions.

    With proxy labels the agreement is reported as proxy_* and the columns of real accuracy are null.
    """
    rows = results.join(gold, "id")
    answered, gold_no = F.col("status") == "unconfirmed", F.col("expected_status") == "refuse"
    good = accepted(F.col("status"), F.col("expected_status"), F.col("cause_ids"), F.col("acceptable_cause_ids"), F.col("check_ids"), F.col("acceptable_check_ids"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), median(F.col("latency_seconds")).alias("latency_median"), nearest_rank("latency_seconds").alias("latency_p95"),
        F.count_if(answered).alias("answered"), F.count_if(F.col("status") == "refuse").alias("refused"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        rate(F.col("status") == "refuse", gold_no).alias("no_answer_refusal_rate"), rate(answered).alias("coverage"),
        rate(good).alias("accuracy"), rate(~good, answered).alias("false_answers_per_answered"),
        rate(hit_at(F.col("cause_ids"), F.col("acceptable_cause_ids"), 1), answered).alias("top1"),
        rate(hit_at(F.col("cause_ids"), F.col("acceptable_cause_ids"), 2), answered).alias("top2"), rate(hit_at(F.col("cause_ids"), F.col("acceptable_cause_ids"), 3), answered).alias("top3"),
    )
    for c in ("accuracy", "false_answers_per_answered", "top1", "top2", "top3"):
        out = out.withColumn(f"proxy_{c}", F.col(c) if proxy else F.lit(None).cast("double"))
        out = out.withColumn(c, F.lit(None).cast("double") if proxy else F.col(c))
    return out


def throughput(n: Column, per_second: Column) -> Column:
    """Things per second over all rows: their number by the time they took, not a mean of rates."""
    return F.try_divide(F.sum(n), F.sum(F.try_divide(n, per_second)))


def covered_mean(x: Column) -> Column:
    """The mean, but null unless every row has a value."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def case_energy(samples: DataFrame, latency: DataFrame, case: str, watts: str, seconds: str) -> DataFrame:
    """Mean and peak power of each case, and energy as mean power by latency."""
    power = samples.groupBy(case).agg(F.avg(watts).alias("mean_watts"), F.max(watts).alias("peak_watts"))
    return latency.join(power, case, "left").withColumn("energy_joules", F.col("mean_watts") * F.col(seconds))


def trapezoid_energy(samples: DataFrame, by: list[str], at: Column, watts: str) -> DataFrame:
    """Integral of power over time by trapezoids between neighbouring samples."""
    w = Window.partitionBy(*by).orderBy("_t")
    steps = samples.withColumn("_t", at).withColumn("_dt", F.col("_t") - F.lag("_t").over(w)).withColumn("_p", F.lag(watts).over(w))
    return steps.groupBy(*by).agg(F.coalesce(F.sum((F.col(watts) + F.col("_p")) / 2 * F.col("_dt")), F.lit(0.0)).alias("energy_joules"))


def cost_per_thousand(mean_joules: Column, per_kwh: float) -> Column:
    return mean_joules / 3.6e6 * 1000 * per_kwh
