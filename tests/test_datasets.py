"""Wafer logs, evidence files, investigations in batch, and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from provena.operators import wafer_gen, wafer_parse
from provena.operators.constraints import ContractError
from provena.operators.lines import number_lines
from provena.plans.investigate import investigate, offer, retrieve
from provena.sources import files, sinks
from provena.streaming import power
from pyspark.sql import functions as F

GRID = [(f"D{i:03d}", i % 4, i // 4) for i in range(1, 13)]
PLAN = dict(version="t-1", seed=3, product="Chip_T", lots=["L01", "L02"], wafers_per_lot=4, coordinates=GRID, quotas={"PASS": 72, "CONTINUITY_FAIL": 8, "IDD_STATIC_FAIL": 8, "SCAN_FAIL": 8},
            bins={"PASS": 1, "SCAN_FAIL": 2, "IDD_STATIC_FAIL": 3, "CONTINUITY_FAIL": 4}, pins={"PA": 1, "PB": 2, "PC": 3, "PD": 4}, start="2026-01-01 08:00:00")


@pytest.fixture(scope="module")
def dataset(spark):
    plan = wafer_gen.WaferPlan(**PLAN)
    devices = wafer_gen.devices(spark, plan).cache()
    logs = wafer_gen.logs(devices, plan).cache()
    return plan, devices, logs


def rules(df):
    return {r["rule_id"] for r in df.collect()}


def broken(dataset, change):
    """The rules that logs break after a change of their text."""
    plan, devices, logs = dataset
    parsed = wafer_parse.parse(number_lines(logs.withColumn("text", change(F.col("text"))), "text"), plan.product)
    return rules(wafer_parse.device_violations(parsed, plan.bins, plan.pins, plan.lower, plan.upper).unionByName(wafer_parse.reconcile(parsed, devices)))


def test_round_trip_keeps_quotas_and_breaks_no_rule(spark, dataset):
    plan, devices, logs = dataset
    assert {r["outcome"]: r["count"] for r in devices.groupBy("outcome").count().collect()} == plan.quotas
    lines = number_lines(logs, "text").cache()
    parsed = wafer_parse.parse(lines, plan.product).cache()
    template = spark.createDataFrame(plan.coordinates, "device string, x int, y int")
    assert rules(wafer_parse.device_violations(parsed, plan.bins, plan.pins, plan.lower, plan.upper)) == set()
    assert rules(wafer_parse.wafer_violations(parsed, lines, template)) == set() and rules(wafer_parse.reconcile(parsed, devices)) == set()
    total = wafer_parse.report(parsed, list(plan.quotas)).filter("lot is null").first()
    assert (total["dut_count"], total["pass"], total["test_100"], total["test_210"], total["test_606"]) == (96, 72, 96, 88, 80)
    assert wafer_parse.report(parsed, list(plan.quotas)).count() == 9
    for outcome, lot, wafer, names in map(tuple, wafer_gen.reservations(spark, plan).collect()):
        got = {r["device"]: r["outcome"] for r in parsed.filter((F.col("lot") == lot) & (F.col("wafer") == wafer)).collect()}
        assert all(got[d] == outcome for d in names)
    again = wafer_gen.logs(wafer_gen.devices(spark, wafer_gen.WaferPlan(**PLAN)), plan)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, logs.collect()))
    pieces = wafer_parse.chunks(parsed, "v1")
    assert pieces.select("chunk_id").distinct().count() == 96
    span = pieces.filter("failed_test = 606").first()
    source = [r["line"] for r in lines.filter((F.col("lot") == span["lot"]) & (F.col("wafer") == span["wafer"])).orderBy("line_no").collect()]
    assert [x for x in source[span["source_lines"]["start"] - 1 : span["source_lines"]["end"]] if x.strip()] == span["source_text"].split("\n")


@pytest.mark.parametrize(("pattern", "new", "rule"), [
    (r"Failing Pins:  (\d) \(F\)", "Failing Pins:  9 (F)", "C04-count"), (r"(ma <\s+)\d\d\.\d\d( ma     <)", "$199.99$2", "C05-flag"), (r"Wafer Coordinates: \( 1 ,", "Wafer Coordinates: ( 8 ,", "C09-x"),
    (r"Bin:  2", "Bin:  3", "C06-outcome"), (r" PA : 1 ", " PA : 7 ", "C04-names"), (r"Date: Thu", "Date: Fri", "C03-weekday"), (r"Lot: L01", "Lot: L09", "C03-lot"), (r"   210 IDD_Static[^\n]*\n", "", "C06-order"),
])
def test_tampering_is_found(dataset, pattern, new, rule):
    assert rule in broken(dataset, lambda t: F.regexp_replace(t, pattern, new))


def test_plans_are_checked():
    with pytest.raises(ContractError, match="quotas must sum"):
        wafer_gen.WaferPlan(**(PLAN | {"quotas": PLAN["quotas"] | {"PASS": 1}}))
    with pytest.raises(ContractError, match="pin numbers"):
        wafer_gen.WaferPlan(**(PLAN | {"pins": {"PA": 1, "PB": 1, "PC": 2}}))


def test_file_readers(spark, tmp_path):
    (tmp_path / "logs/L01").mkdir(parents=True)
    (tmp_path / "logs/L01/W01.txt").write_bytes("one\n\ntwo é\n".encode())
    (tmp_path / "logs/L01/W02.txt").write_bytes(b"a\r\nsimulated\n")
    lines = files.text_lines(spark, f"{tmp_path}/logs", "*.txt")
    lot, wafer = files.lot_and_wafer(F.col("path"))
    got = lines.select(lot.alias("lot"), wafer.alias("wafer"), "line_no", "line", "sha256").filter("wafer = 'W01'").orderBy("line_no").collect()
    assert [(r["lot"], r["line_no"], r["line"]) for r in got] == [("L01", 1, "one"), ("L01", 2, ""), ("L01", 3, "two é")]
    assert got[0]["sha256"] == hashlib.sha256("one\n\ntwo é\n".encode()).hexdigest()
    assert rules(files.log_violations(spark, f"{tmp_path}/logs", "*.txt")) == {"S04-cr", "S04-word"}
    below = files.relative(F.lit("/data/root/a/b.txt"), "/data/root")
    assert spark.range(1).select(below.alias("x"), files.relative(F.lit("/data/root/../c"), "/data/root").alias("y")).first() == ("a/b.txt", None)
    (tmp_path / "rows.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [tuple(r) for r in files.json_lines(spark, f"{tmp_path}/rows.jsonl", "a int").collect()] == [(1, 1), (3, 2)]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.json_lines(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    (tmp_path / "p.csv").write_text("case_id,watts\nx,1.5\n")
    assert files.csv_contract(spark, f"{tmp_path}/p.csv", "case_id string, watts double").first() == ("x", 1.5)
    with pytest.raises(Exception, match="(?i)header"):
        files.csv_contract(spark, f"{tmp_path}/p.csv", "case string, watts double").collect()
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": 1}}, indent=1))
    assert files.json_documents(spark, f"{tmp_path}/d.json", "a struct<b:int>").first()["a"]["b"] == 1
    assert spark.range(1).select(files.power_from_telemetry(F.lit("RAM 1 VDD_IN 7600mW/7000mW")).alias("w"), files.power_from_telemetry(F.lit("none")).alias("n")).first() == (7.6, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "é"), (1, "x", "y")], "id long, b string, a string")
    assert [r["j"] for r in df.select(sinks.canonical_json(df).alias("j")).collect()] == ['{"a":"é","b":null,"id":2}', '{"a":"y","b":"x","id":1}']
    sinks.write_bundle(df, f"{tmp_path}/bundle", ["id"])
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/bundle").collect())[0] == '{"a":"y","b":"x","id":1}'
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_bundle(df, f"{tmp_path}/bundle", ["id"])
    with pytest.raises(ContractError):
        sinks.outside("/data/in/out", "/data/in")
    with pytest.raises(ContractError):
        sinks.outside("/data/out/../in/x", "/data/in/")
    sinks.outside("/data/out", "/data/in")
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "bundle").glob("part-*")))
    assert sinks.bundle_hash(df, f"{tmp_path}/bundle") == hashlib.sha256(lines).hexdigest() and lines.decode().splitlines() == ['{"a":"y","b":"x","id":1}', '{"a":"é","b":null,"id":2}']
    assert sum(r["length"] for r in sinks.file_hashes(df, f"{tmp_path}/bundle").collect()) == len(lines)
    a, b = sinks.content_hash(df).first(), sinks.content_hash(df.repartition(3)).first()
    assert a == b and a["n"] == 2 and sinks.content_hash(df.withColumn("a", F.lit("z"))).first()["sha256"] != a["sha256"]
    sinks.append_audit(df.withColumn("run_id", F.lit("r1")), f"{tmp_path}/audit")
    sinks.append_audit(df.withColumn("run_id", F.lit("r2")), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").filter("run_id = 'r2'").count() == 2
    sinks.upsert_table(df, df.filter("id = 1").withColumn("b", F.lit("new")), "id", f"{tmp_path}/held")
    assert {r["b"] for r in spark.read.parquet(f"{tmp_path}/held").collect()} == {None, "new"}
    sinks.write_metrics_csv(df, f"{tmp_path}/m", ["id"])
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == ["id", "b", "a"]
    assert sinks.pretty_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'


INCIDENT = "query_id string, dut_id string, product string, test_number int, pins array<string>, observation string, question string, vector array<double>"
CASE = "case_id string, dut_id string, product string, failed_test int, pins array<string>, cause_text string, possible_causes array<string>, checks array<string>, text string, vector array<double>"


def incidents(spark, observation="210 IDD_Static curr 35.00 ma < 60.00 ma (F) < 55.00 ma", dut="D900"):
    rows = [("q1", dut, "P", 210, [], observation, "why high current", [0.0]), ("q2", "D901", "P", 100, ["PB"], "pins fail", "pins", [0.0]), ("q3", "D902", "P", 606, ["PB"], "scan", "scan", [0.0])]
    return spark.createDataFrame(rows, INCIDENT)


def history(spark):
    rows = [
        ("c1", "D001", "P", 210, [], "excessive static current", ["leakage path"], ["measure D001 again"], "high current leakage", [0.1]), ("c2", "D002", "P", 210, [], "low supply", ["open load"], ["check D002"], "low current", [0.2]),
        ("c3", "D003", "P", 100, ["PA", "PB"], "worn", ["pin PA worn", "dirty socket"], ["probe D003"], "pins fail", [0.3]), ("c4", "D004", "Q", 606, ["PB"], "scan", ["x"], ["y"], "scan", [0.0]),
    ]
    return spark.createDataFrame(rows, CASE)


def answers(out):
    return {r["query_id"]: r for r in out.answers.collect()}


def test_investigations_answer_verify_and_refuse(spark):
    out = investigate(incidents(spark), history(spark))
    got = answers(out)
    assert got["q1"]["status"] == "unconfirmed" and got["q1"]["cause_ids"] == ["c1-C1"] and got["q1"]["checks"][0]["display_text"] == "measure the current DUT (D900) again" and got["q1"]["checks"][0]["text"] == "measure D001 again"
    assert got["q2"]["cause_ids"] == ["c3-C2"] and got["q2"]["check_ids"] == ["c3-K1"] and got["q2"]["generation_attempts"] == 1 and len(got["q2"]["limitations"]) == 3
    assert got["q3"]["status"] == "refuse" and got["q3"]["cause_ids"] == [] and got["q3"]["generation_attempts"] == 0
    audit = {r["query_id"]: r for r in out.eligibility.collect()}
    assert audit["q1"]["retrieved_cases"] == ["c1", "c2"] and audit["q1"]["eligible_cases"] == ["c1"] and "q3" not in audit
    assert all(r["kept"] and r["enforced"] and r["refusal_enforced"] for r in out.verification.collect())
    low = answers(investigate(incidents(spark, "no measurement"), history(spark)))
    assert low["q1"]["status"] == "refuse"
    loose = answers(investigate(incidents(spark, "no measurement"), history(spark), variant="no_verifier"))
    assert loose["q1"]["status"] == "unconfirmed" and len(loose["q1"]["cause_ids"]) == 2 and loose["q2"]["cause_ids"] == ["c3-C1", "c3-C2"]
    forced = answers(investigate(incidents(spark, "no measurement"), history(spark), variant="no_refusal"))
    assert forced["q1"]["status"] == "unconfirmed" and {r["reason"] for r in forced["q1"]["rejected"]} == {"direction"}
    torn = answers(investigate(incidents(spark, "measured current: 60 mA, limits: 35-55 mA, below the lower limit"), history(spark)))
    assert torn["q1"]["status"] == "rejected" and torn["q1"]["error"] == "conflict" and torn["q2"]["status"] == "unconfirmed"
    with pytest.raises(ValueError, match="variant"):
        investigate(incidents(spark), history(spark), variant="odd")


def test_the_question_is_no_evidence(spark):
    asked = incidents(spark, "210 IDD_Static: FAIL").withColumn("question", F.lit("The current is above the upper limit: what caused it?"))
    assert answers(investigate(asked, history(spark)))["q1"]["status"] == "refuse"


def test_selectors_are_held_to_their_contract(spark):
    options = offer(retrieve(incidents(spark), history(spark)))
    reply = lambda text: lambda items: items.select("query_id").distinct().withColumn("selection_text", F.lit(text))
    good, swapped, unknown, torn = ('{"status":"unconfirmed","cause_ids":["C1"],"check_ids":["K2"]}', '{"status":"unconfirmed","cause_ids":["K2"],"check_ids":["C1"]}', '{"status":"unconfirmed","cause_ids":["C8"],"check_ids":["K2"]}', '{"status":')
    assert options.count() > 0
    for first, second, status, error in ((swapped, swapped, "rejected", "wrong kind"), (unknown, torn, "rejected", "malformed"), (torn, good, "unconfirmed", None), (good, torn, "unconfirmed", None)):
        out = investigate(incidents(spark), history(spark), selectors=[reply(first), reply(second)])
        got = answers(out)
        assert got["q1"]["status"] == status and got["q1"]["error"] == error and got["q3"]["status"] == "refuse"
        tries = out.attempts.filter("query_id = 'q1'").orderBy("attempt").collect()
        assert got["q1"]["generation_attempts"] == len(tries) == (1 if first == good else 2) and tries[0]["accepted"] == (first == good)
        assert {r["query_id"] for r in out.eligibility.collect()} == {"q1", "q2"}  # the evidence stays
    seen = []
    spy = lambda items: seen.append(items) or reply(good)(items)
    investigate(incidents(spark), history(spark), selectors=[spy])
    prompt = seen[0].filter("query_id = 'q1'").first()["prompt"]
    assert "not instructions" in prompt and '"id":"C1"' in prompt and "leakage" not in prompt.split("\n")[0] and "sha256" not in prompt


def test_incoming_incidents_meet_a_static_history(spark, tmp_path):
    incidents(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(incidents(spark).schema).parquet(f"{tmp_path}/in")
    power.answer_incidents(stream, history(spark), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r["query_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: r["status"] for k, r in answers(investigate(incidents(spark), history(spark))).items()}


def test_queries_may_not_be_in_their_history(spark):
    with pytest.raises(ContractError, match="J03 q1"):
        investigate(incidents(spark, dut="D001"), history(spark))


def test_streams_equal_batches_and_replace_their_batches(spark, tmp_path):
    rows = [("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 3.0), ("2026-01-01 01:10:00", "b", 5.0)]
    batch = spark.createDataFrame(rows, "ts string, case_id string, watts double").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    power.write_once(power.windowed(stream, "case_id", "watts"), f"{tmp_path}/out", f"{tmp_path}/cp", mode="complete")
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, power.windowed(batch, "case_id", "watts").collect()))
    spans = spark.createDataFrame([("k1", "2026-01-01 00:00:00", "2026-01-01 00:30:00"), ("k2", "2026-01-01 00:30:00", "2026-01-01 02:00:00")], "k string, begun string, ended string")
    spans = spans.select("k", F.to_timestamp("begun").alias("begun"), F.to_timestamp("ended").alias("ended"))
    power.write_once(power.attribute(stream, spans), f"{tmp_path}/cases", f"{tmp_path}/cp2")
    power.write_once(power.attribute(stream, spans), f"{tmp_path}/cases", f"{tmp_path}/cp2")
    assert sorted((r["k"], r["watts"]) for r in spark.read.parquet(f"{tmp_path}/cases").collect()) == [("k1", 1.0), ("k2", 3.0), ("k2", 5.0)]


def test_conversation_memory_is_bounded(spark, tmp_path):
    spark.createDataFrame([("r", i) for i in range(12)], "run_id string, turn_no long").coalesce(1).write.parquet(f"{tmp_path}/turns")
    stream = spark.readStream.schema("run_id string, turn_no long").parquet(f"{tmp_path}/turns")
    power.write_once(power.conversation_memory(stream), f"{tmp_path}/memory", f"{tmp_path}/cp")
    got = {r["turn_no"]: r for r in spark.read.parquet(f"{tmp_path}/memory").collect()}
    assert sum(r["admitted"] for r in got.values()) == 10 and not got[11]["admitted"] and got[3]["remembers"] == "1,2" and got[11]["remembers"] == "8,9"


def test_dataset_contracts(spark, dataset):
    plan, devices, logs = dataset
    parsed = wafer_parse.parse(number_lines(logs, "text"), plan.product).cache()
    report, chunks = wafer_parse.report(parsed, list(plan.quotas)), wafer_parse.chunks(parsed, "v1")
    assert rules(wafer_parse.total_violations(report, plan.quotas)) == set() == rules(wafer_parse.chunk_violations(chunks, plan.quotas)) == rules(wafer_parse.report_violations(report, report, ["lot", "wafer"]))
    other = plan.quotas | {"PASS": 71, "SCAN_FAIL": 9}
    assert rules(wafer_parse.total_violations(report, other)) == {"C10-PASS", "C10-SCAN_FAIL"} and rules(wafer_parse.chunk_violations(chunks, other)) == {"C13-quota"}
    assert rules(wafer_parse.chunk_violations(chunks.withColumn("source_text", F.repeat(F.lit("x"), 2001)).withColumn("failed_test", F.lit(100)), plan.quotas)) >= {"C13-text", "C13-last"}
    assert rules(wafer_parse.report_violations(report.withColumn("pass", F.col("pass") + 1), report, ["lot", "wafer"])) == {"C12-report"}
    one = wafer_parse.one_failure(parsed)
    assert one.count() == 24 and {r["failed_test"] for r in one.collect()} == {100, 210, 606}
    template = spark.createDataFrame(plan.coordinates, "device string, x int, y int")
    lines = number_lines(logs, "text")
    assert rules(wafer_parse.wafer_violations(parsed, lines, template, plan.start)) == set() and rules(wafer_parse.wafer_violations(parsed, lines, template, "2026-01-01 09:00:00")) == {"C07-first"}
    assert rules(wafer_parse.device_violations(parsed, plan.bins, plan.pins, plan.lower, plan.upper, (1, 2), {"tester": "other", "site": 0})) == {"C04-vector", "C03-tester"}
    files_ = spark.createDataFrame([("a.txt", "1"), ("b.txt", "2")], "path string, sha256 string")
    listed = spark.createDataFrame([("a.txt", "1"), ("b.txt", "9"), ("../c", "3"), ("a.txt", "1")], "path string, sha256 string")
    assert rules(wafer_parse.manifest_violations(files_, files_)) == set() and rules(wafer_parse.manifest_violations(listed, files_)) == {"C11-hash", "C11-path", "C11-unique", "C11-files"}
    assert wafer_parse.scenario_sources(spark.createDataFrame([(parsed.first()["dut_id"],), ("gone",)], "dut_id string"), chunks).filter("chunk_id is null").count() == 1
