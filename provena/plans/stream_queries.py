"""Queries over tables read as streams, over files of lines, and over a generated dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import wafer_gen, wafer_parse
from provena.operators.constraints import enforce, union_all
from provena.operators.lines import number_lines
from provena.sources.files import json_line_violations, split_lines
from provena.sources.stored import new_path
from provena.sources.tables import table
from provena.streaming.power import attribute, windowed, write_once
from provena.streaming.turns import OUT as TURNS_OUT
from provena.streaming.turns import judged, keeping_state, lifecycle


def stream_power_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean and peak of each event type, by a streaming aggregation over all available files."""
    schema, at = table(spark, sf_dir, "events").schema, new_path(spark, "stream")
    samples = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    write_once(windowed(samples, "event_type", "value"), f"{at}/out", f"{at}/checkpoint", mode="complete")
    out = spark.read.parquet(f"{at}/out")
    return out.select(F.date_format("begun", "yyyy-MM-dd HH:mm").alias("begun"), "event_type", "n", F.round("mean", 6).alias("mean"), "peak")


STREAM_SQL = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS begun, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM events GROUP BY ALL
"""

_GRID = [(f"D{1 + 8 * y + x:03d}", x, y) for y in range(6) for x in range(8)]
PLAN = wafer_gen.WaferPlan(
    "provena-wafers-1", 7, "Chip_B", ["L01", "L02", "L03"], 3, _GRID, {"PASS": 372, "CONTINUITY_FAIL": 18, "IDD_STATIC_FAIL": 18, "SCAN_FAIL": 24},
    {"PASS": 1, "SCAN_FAIL": 2, "IDD_STATIC_FAIL": 3, "CONTINUITY_FAIL": 4}, {"PA": 11, "PB": 12, "PC": 13, "PD": 21, "PE": 22}, "2026-01-01 08:00:00",
)


def wafer_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generate a dataset, render its logs, read them back, and report counts by wafer and overall; stops on any violation."""
    devices = wafer_gen.devices(spark, PLAN)
    lines = number_lines(wafer_gen.logs(devices, PLAN), "text")
    parsed = wafer_parse.parse(lines, PLAN.product)
    header = {"tester": PLAN.tester, "program": PLAN.program, "station": PLAN.station, "site": PLAN.site}
    report = wafer_parse.report(parsed, list(PLAN.quotas))
    template = spark.createDataFrame(PLAN.coordinates, "device string, x int, y int")
    enforce(union_all([
        wafer_parse.device_violations(parsed, PLAN.bins, PLAN.pins, PLAN.lower, PLAN.upper, (PLAN.vector_min, PLAN.vector_max), header), wafer_parse.reconcile(parsed, devices),
        wafer_parse.wafer_violations(parsed, lines, template, PLAN.start), wafer_parse.total_violations(report, PLAN.quotas), wafer_parse.chunk_violations(wafer_parse.chunks(parsed, "v1"), PLAN.quotas),
    ]))
    return report


def stream_power_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a stream attributed to the cases whose span holds them: eight to twelve o'clock of each day and type."""
    events, at = table(spark, sf_dir, "events"), new_path(spark, "stream")
    samples = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("watts"))
    days = events.select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).distinct()
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    spans = days.select(F.date_format("d", "yyyy-MM-dd").alias("case_id"), (F.col("d") + hours(8)).alias("begun"), (F.col("d") + hours(12)).alias("ended"))
    write_once(attribute(samples, spans).select("case_id", "event_type", "watts"), f"{at}/out", f"{at}/checkpoint")
    out = spark.read.parquet(f"{at}/out").groupBy("case_id", "event_type")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("watts"), 6).alias("mean"), F.max("watts").alias("peak"))


CASES_SQL = """
SELECT strftime(ts, '%Y-%m-%d') AS case_id, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM events WHERE hour(ts) >= 8 AND hour(ts) < 12 GROUP BY ALL
"""


JSONL_SQL = """
WITH l AS (
  SELECT doc_id, 0 AS k, NULL AS rule_id FROM documents
  UNION ALL SELECT doc_id, 1, 'S03-blank' FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 2, 'S03-keys' FROM documents WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id, 3, 'S03-json' FROM documents WHERE doc_id % 13 = 0
), n AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS line_no FROM l)
SELECT line_no, doc_id, n_chars, lang, CASE WHEN rule_id IS NULL THEN md5(text) END AS text_md5, rule_id
FROM (SELECT line_no, rule_id, CASE WHEN k = 0 THEN doc_id END AS doc_id FROM n) LEFT JOIN documents USING (doc_id)
"""


def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines among blank ones, repeated keys and broken ones, read back with their numbers over all files and what is wrong with them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    key = F.col("doc_id").cast("string")
    whole = F.to_json(F.struct("doc_id", "n_chars", "lang", "text"))
    twice, broken = F.concat(F.lit('{"a":{"doc_id":'), key, F.lit(',"doc_id":'), key, F.lit("}}")), F.concat(F.lit('{"doc_id":'), key)
    more = [F.when(F.col("doc_id") % n == 0, F.struct(F.lit(k).alias("k"), t.alias("value"))) for k, n, t in ((1, 7, F.lit(" ")), (2, 11, twice), (3, 13, broken))]
    lines = d.select("doc_id", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("k"), whole.alias("value")), *more))).alias("l")).select("doc_id", "l.k", "l.value")
    path = new_path(spark, "jsonl")
    lines.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k").select("value").write.text(path)
    found = split_lines(spark, path, folder=True)
    bad = json_line_violations(spark, path, folder=True).select("line_no", "rule_id")
    read = F.from_json("line", "doc_id long, n_chars long, lang string, text string")
    rows = found.join(bad, "line_no", "left").select("line_no", "rule_id", F.when(F.col("rule_id").isNull(), read).alias("r"))
    return rows.select("line_no", "r.doc_id", "r.n_chars", "r.lang", F.md5("r.text").alias("text_md5"), "rule_id")



TURNS_SQL = """
WITH t AS (
  SELECT md5((conv_id // 8)::VARCHAR) AS run_id, conv_id * 100 + turn AS turn_no, conv_id * 7 + turn AS n, trim(text) AS q FROM conversations WHERE role <> 'system'
), r AS (
  SELECT *, length(q) BETWEEN 1 AND 700 AS valid, CASE n % 5 WHEN 0 THEN 'prose' WHEN 1 THEN 'references' END AS e1, CASE WHEN n % 3 = 0 THEN 'empty' END AS e2 FROM t
), o AS (
  SELECT *, CASE WHEN valid THEN count(*) FILTER (valid) OVER (PARTITION BY run_id ORDER BY turn_no) END AS ordinal FROM r
), a AS (
  SELECT *, valid AND ordinal <= 10 AS admitted, valid AND ordinal <= 10 AND (e1 IS NULL OR e2 IS NULL) AS answered FROM o
), h AS (
  SELECT *, coalesce(list(turn_no) FILTER (answered) OVER (PARTITION BY run_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM a
)
SELECT run_id, turn_no, CASE WHEN admitted THEN ordinal::INTEGER END AS ordinal,
       CASE WHEN NOT valid THEN 'invalid' WHEN NOT admitted THEN 'ended' WHEN answered THEN 'conversation' ELSE 'rejected' END AS scope,
       CASE WHEN answered THEN md5(CASE WHEN e1 IS NULL THEN q || ' [E1]' ELSE 'See [E2] on it: ' || q END) END AS text_md5,
       CASE WHEN NOT answered THEN '' WHEN e1 IS NULL THEN 'E1' ELSE 'E2' END AS items,
       CASE WHEN NOT valid THEN 'question' WHEN NOT admitted THEN 'the conversation has its ten turns' WHEN NOT answered THEN 'empty' END AS error,
       CASE WHEN NOT admitted THEN 0 WHEN e1 IS NULL THEN 1 ELSE 2 END AS generation_attempts,
       CASE WHEN admitted THEN array_to_string(before[-2:], ',') ELSE '' END AS history
FROM h
"""


def stream_turn_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of eight conversations at a time as questions to one run, with two replies each of which some break a rule."""
    schema, at = table(spark, sf_dir, "conversations").schema, new_path(spark, "stream")
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversation[s].parquet").filter("role <> 'system'")
    n, q = F.col("conv_id") * 7 + F.col("turn"), F.trim("text")
    first = F.when(n % 5 == 0, F.concat(F.lit("{"), q)).when(n % 5 == 1, F.concat(q, F.lit(" [E1, E9]"))).otherwise(F.concat(q, F.lit(" [E1]")))
    second = F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("See [E2] on it: "), q))
    asked = turns.select(F.md5(F.floor(F.col("conv_id") / 8).cast("string").cast("binary")).alias("run_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("turn_no"), F.col("text").alias("question"), F.array(first, second).alias("replies"))
    with keeping_state(spark):
        write_once(lifecycle(judged(asked, F.array(F.lit("E1"), F.lit("E2")), F.array(F.lit("Product_A-L01-W01-D100")))), f"{at}/out", f"{at}/checkpoint")
    out = spark.read.schema(TURNS_OUT).parquet(f"{at}/out")
    answer = F.when(F.col("scope") == "conversation", F.md5("text"))
    return out.select("run_id", "turn_no", "ordinal", "scope", answer.alias("text_md5"), F.array_join("items", ",").alias("items"), "error", "generation_attempts", F.array_join(F.transform("history", lambda t: t.cast("string")), ",").alias("history"))


QUERIES = {"stream_power_windows": stream_power_windows, "stream_power_cases": stream_power_cases, "wafer_log_report": wafer_log_report, "jsonl_line_numbers": jsonl_line_numbers, "stream_turn_lifecycle": stream_turn_lifecycle}
ORACLE_SQL = {"stream_power_windows": STREAM_SQL, "stream_power_cases": CASES_SQL, "jsonl_line_numbers": JSONL_SQL, "stream_turn_lifecycle": TURNS_SQL}
