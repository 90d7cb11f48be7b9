"""Scoring queries: exact percentiles, rates, hits, throughput, energy and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.operators.constraints import ContractError
from provena.operators.ordered import value_counts
from provena.operators.retrieval import nearest_in_blocks
from provena.operators.scoring import accepted, case_energy, cost_per_thousand, covered_mean, hit_at, rate, throughput, trapezoid_energy
from provena.sources.tables import table


def _micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def latency_median_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each event type from counts of its values, whatever share of all events it has."""
    c = value_counts(table(spark, sf_dir, "events"), ["event_type"], "value")
    return c.rows.groupBy("event_type").agg(F.sum("n").alias("n"), c.interpolated(0.5).alias("median"), c.nearest_rank(0.95).alias("p95"))


LATENCY_SQL = """
SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type
"""


def acceptance_and_false_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' labels as gold, a length rule as the answer: the acceptance ladder and its rates by language."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(g, "doc_id").select(
        "lang",
        F.when(F.col("n_chars") >= 400, "unconfirmed").otherwise("refuse").alias("status"),
        F.when(F.col("quality") == 1, "unconfirmed").otherwise("refuse").alias("expected"),
        F.array(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string"))).alias("causes"), F.array(F.lit("c0"), F.lit("c1")).alias("ok_causes"),
        F.array(F.lit("k1")).alias("checks"), F.array(F.lit("k1"), F.lit("k2")).alias("ok_checks"),
    )
    good = accepted(*(F.col(c) for c in ("status", "expected", "causes", "ok_causes", "checks", "ok_checks")))
    answered = F.col("status") == "unconfirmed"
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(rate(good), 6).alias("accuracy"), F.round(rate(~good, answered), 6).alias("false_per_answered"),
        F.round(rate(F.col("status") == "refuse", F.col("expected") == "refuse"), 6).alias("no_answer_refusal_rate"), F.round(rate(answered), 6).alias("coverage"),
    )


ACCEPTANCE_SQL = """
WITH r AS (
  SELECT lang, n_chars >= 400 AS ans, quality = 1 AS want, doc_id % 3 < 2 AS subset_ok FROM documents JOIN labels USING (doc_id)
), g AS (SELECT *, (NOT ans AND NOT want) OR (ans AND want AND subset_ok) AS good FROM r)
SELECT lang, count(*) AS n, round(avg(good::INTEGER), 6) AS accuracy,
       round(count(*) FILTER (ans AND NOT good)::DOUBLE / nullif(count(*) FILTER (ans), 0), 6) AS false_per_answered,
       round(count(*) FILTER (NOT ans AND NOT want)::DOUBLE / nullif(count(*) FILTER (NOT want), 0), 6) AS no_answer_refusal_rate,
       round(avg(ans::INTEGER), 6) AS coverage FROM g GROUP BY lang
"""


def topk_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nearest one, two or three vectors carry the query's label, by label."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    near = nearest_in_blocks(e.filter("id % 20 = 0"), e, 3, [])
    per = near.groupBy("q_id", "q_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vector_rank", "h_label"))), lambda x: x["h_label"]).alias("ids"))
    per = per.withColumn("ok", F.array("q_label"))
    return per.groupBy("q_label").agg(F.count("*").alias("n"), *(F.round(rate(hit_at(F.col("ids"), F.col("ok"), k)), 6).alias(f"top{k}") for k in (1, 2, 3)))


HITS_SQL = """
WITH n AS (
  SELECT q.vec_id AS q, q.label AS q_label, h.label,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, h.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), h.vec_id) AS rank
  FROM embeddings q JOIN embeddings h ON q.vec_id <> h.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 3
), p AS (
  SELECT q, q_label, max((label = q_label AND rank <= 1)::INTEGER) AS h1, max((label = q_label AND rank <= 2)::INTEGER) AS h2, max((label = q_label)::INTEGER) AS h3 FROM n GROUP BY ALL
)
SELECT q_label, count(*) AS n, round(avg(h1), 6) AS top1, round(avg(h2), 6) AS top2, round(avg(h3), 6) AS top3 FROM p GROUP BY q_label
"""


def harmonic_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(throughput(F.col("l_quantity"), F.nullif(F.col("l_discount"), F.lit(0.0))), 6).alias("per_second"))


THROUGHPUT_SQL = """
SELECT l_returnflag, round(sum(l_quantity) / sum(l_quantity / nullif(l_discount, 0)), 6) AS per_second FROM lineitem GROUP BY l_returnflag
"""


def energy_mean_x_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as power samples of users; a user's latency is the span of its events; energy, peak and cost."""
    e = table(spark, sf_dir, "events")
    span = e.groupBy("user_id").agg((_micros(F.max("ts")) - _micros(F.min("ts"))).alias("us")).select("user_id", (F.col("us") / 1e6).alias("seconds"))
    out = case_energy(e, span, "user_id", "value", "seconds")
    return out.select("user_id", F.round("mean_watts", 6).alias("mean_watts"), "peak_watts", F.round("energy_joules", 2).alias("energy_joules"), F.round(cost_per_thousand(F.col("energy_joules"), 0.5), 6).alias("cost_1000"))


ENERGY_SQL = """
WITH p AS (
  SELECT user_id, avg(value) AS w, max(value) AS peak, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY user_id
)
SELECT user_id, round(w, 6) AS mean_watts, peak AS peak_watts, round(w * s, 2) AS energy_joules, round(w * s / 3.6e6 * 1000 * 0.5, 6) AS cost_1000 FROM p
"""


def trapezoid_energy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = trapezoid_energy(e, ["user_id"], _micros(F.col("ts")) / 1e6, "value")
    return out.select("user_id", F.round("energy_joules", 2).alias("energy_joules"))


TRAPEZOID_SQL = """
WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, max(value) AS v FROM events GROUP BY user_id, ts),
d AS (SELECT user_id, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS j FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(coalesce(sum(j), 0), 2) AS energy_joules FROM d GROUP BY user_id
"""


def coverage_gated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label quality of each source, but null unless all its documents are labelled."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(g, "doc_id", "left").withColumn("part", F.floor(F.col("doc_id") / 4))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.round(covered_mean(F.col("quality")), 6).alias("quality"))


COVERAGE_SQL = """
SELECT floor(doc_id / 4)::BIGINT AS part, count(*) AS n, round(CASE WHEN count(quality) = count(*) THEN avg(quality) END, 6) AS quality
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
"""


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid citations by citations, summed before the division; null for a language without any."""
    c = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("total"), (F.col("n_chars") % 97).alias("valid"))
    return c.groupBy("lang").agg(F.round(F.try_divide(F.sum("valid"), F.sum("total")), 6).alias("validity"))


CITATION_SQL = "SELECT lang, round(sum(n_chars % 97)::DOUBLE / nullif(sum(n_chars), 0), 6) AS validity FROM documents GROUP BY lang"


MOST_VARIANTS = 64


def variant_pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as rows, the event types that there are as columns, unmeasured cells named so."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max(F.when(F.col("value") > 480, F.col("value"))).alias("above_480"))
    cells = per.unpivot("event_type", ["n", "mean", "above_480"], "metric", "value")
    kinds = [r[0] for r in e.select("event_type").filter("event_type is not null").distinct().orderBy("event_type").limit(MOST_VARIANTS + 1).collect()]
    if len(kinds) > MOST_VARIANTS:  # a report of that many columns is none
        raise ContractError(f"more than {MOST_VARIANTS} variants")
    wide = cells.groupBy("metric").pivot("event_type", kinds).agg(F.first("value"))
    return wide.select("metric", *(F.when(F.col(k).isNull(), "unmeasured").otherwise(F.format_string("%.2f", k)).alias(k) for k in kinds))


_CELL = "coalesce(printf('%.2f', max(value) FILTER (event_type = '{0}')), 'unmeasured') AS {0}"
PIVOT_SQL = f"""
WITH per AS (
  SELECT event_type, count(*)::DOUBLE AS n, round(avg(value), 4) AS mean, max(value) FILTER (value > 480) AS above_480 FROM events GROUP BY event_type
), cells AS (
  SELECT event_type, 'n' AS metric, n AS value FROM per UNION ALL SELECT event_type, 'mean', mean FROM per UNION ALL SELECT event_type, 'above_480', above_480 FROM per
)
SELECT metric, {', '.join(_CELL.format(k) for k in ('view', 'signup', 'click', 'purchase', 'error'))} FROM cells GROUP BY metric
"""


def chart_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar lengths by the largest count, one where all counts are missing or zero."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    most = F.coalesce(F.nullif(F.max("n").over(Window.partitionBy()), F.lit(0)), F.lit(1))
    return e.select("event_type", F.round(F.col("n") / most, 6).alias("length"))


SCALING_SQL = "SELECT event_type, round(count(*) / coalesce(nullif(max(count(*)) OVER (), 0), 1), 6) AS length FROM events GROUP BY event_type"


def reviewer_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents of each worksheet of fifty ids, collected in order by label."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = g.join(d, "doc_id").select(F.floor(F.col("doc_id") / 50).alias("sheet"), "quality", F.struct("doc_id", "source").alias("option"))
    return rows.groupBy("sheet", "quality").agg(F.to_json(F.array_sort(F.collect_list("option"))).alias("options"))


WORKSHEET_SQL = """
SELECT floor(doc_id / 50)::BIGINT AS sheet, quality, '[' || string_agg('{"doc_id":' || doc_id || ',"source":"' || source || '"}', ',' ORDER BY doc_id) || ']' AS options
FROM labels JOIN documents USING (doc_id) GROUP BY ALL
"""

QUERIES = {
    "latency_median_p95": latency_median_p95,
    "acceptance_and_false_rates": acceptance_and_false_rates,
    "topk_hit_rates": topk_hit_rates,
    "harmonic_throughput": harmonic_throughput,
    "energy_mean_x_latency": energy_mean_x_latency,
    "trapezoid_energy": trapezoid_energy_by_user,
    "coverage_gated_average": coverage_gated_average,
    "citation_validity": citation_validity,
    "variant_pivot_report": variant_pivot_report,
    "chart_scaling": chart_scaling,
    "reviewer_worksheet": reviewer_worksheet,
}

ORACLE_SQL = {
    "latency_median_p95": LATENCY_SQL,
    "acceptance_and_false_rates": ACCEPTANCE_SQL,
    "topk_hit_rates": HITS_SQL,
    "harmonic_throughput": THROUGHPUT_SQL,
    "energy_mean_x_latency": ENERGY_SQL,
    "trapezoid_energy": TRAPEZOID_SQL,
    "coverage_gated_average": COVERAGE_SQL,
    "citation_validity": CITATION_SQL,
    "variant_pivot_report": PIVOT_SQL,
    "chart_scaling": SCALING_SQL,
    "reviewer_worksheet": WORKSHEET_SQL,
}
