"""What spans steps of a job: turns over batches, published parts, evidence that changes, and the second reading of logs."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from provena.functions.phrases import holds, token_line
from provena.operators import wafer_gen, wafer_parse
from provena.operators.chat import overclaims
from provena.operators.constraints import ContractError
from provena.operators.lines import number_lines
from provena.plans.investigate import Sources, investigate
from provena.sources import files
from provena.sources.collection import Collection
from provena.sources.commits import Store
from provena.sources.log_parser import parse_by_line
from provena.streaming import turns
from provena.streaming.power import write_once
from pyspark.sql import functions as F

from tests.test_datasets import GRID, PLAN, history, incidents

RUN = "a" * 32


def test_turns_over_batches(spark, tmp_path):
    asked = "run_id string, turn_no long, question string, replies array<string>"
    good, bad = "See [E1].", "See [E9]."
    first = [(RUN, 3, "third", [good]), (RUN, 1, "first", [bad, good]), (RUN, 2, "second", [bad, "{"]), ("b" * 32, 1, "other", [good]), ("short", 1, "x", [good]), (RUN, 9, " ", [good])]
    second = [(RUN, n, f"q{n}", [f"{n} is fine"]) for n in range(12, 3, -1)] + [(RUN, 13, "x" * 701, [good]), ("b" * 32, 2, "none", None), ("b" * 32, 3, "last", [good])]
    schema = spark.createDataFrame([], asked).schema
    known, devices = F.array(F.lit("E1")), F.array(F.lit("P-D001"))
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, asked).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        with turns.keeping_state(spark):
            write_once(turns.lifecycle(turns.judged(stream, known, devices)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert spark.read.schema(turns.OUT).parquet(f"{tmp_path}/out").count() == (len(first), len(first) + len(second))[n]
    rows = spark.read.schema(turns.OUT).parquet(f"{tmp_path}/out").collect()
    got = {(r["run_id"][0], r["turn_no"], r["scope"]): r for r in rows}
    told = {(k[1], k[2]): (r["ordinal"], r["error"], r["generation_attempts"], r["history"]) for k, r in got.items() if k[0] == "a"}
    want = {(1, "conversation"): (1, None, 2, []), (2, "rejected"): (2, "prose", 2, [1]), (3, "conversation"): (3, None, 1, [1]), (9, "invalid"): (None, "question", 0, []), (13, "invalid"): (None, "question", 0, [])}
    want |= {(n, "conversation"): (n, None, 1, [1, 3] if n == 4 else [3, 4] if n == 5 else [n - 2, n - 1]) for n in range(4, 11)}
    want |= {(n, "ended"): (None, turns.ENDED, 0, []) for n in (11, 12)}
    assert told == want
    assert got["a", 1, "conversation"]["items"] == ["E1"] and got["a", 4, "conversation"]["citation_status"] == "no_explicit_references" and got["a", 2, "rejected"]["text"] == turns.APOLOGY
    assert got["s", 1, "invalid"]["error"] == "run" and got["b", 2, "rejected"]["error"] == "no reply" and got["b", 3, "conversation"]["history"] == [1]


def test_a_sentence_is_read_once_for_all_phrases(spark):
    """The line in which phrases are looked for is made once for a sentence, not again for each phrase; what is found is the same."""
    told = ["This indicates a leakage.", "The result clearly proves an internal short", "This indicates nothing", "A leakage this indicates", "In a previous case this indicates leakage", "", None]
    rows = spark.createDataFrame([(x,) for x in told], "s string")
    found = rows.select(overclaims(F.col("s")).alias("o"), holds(token_line(F.col("s")), ["leakage", "internal short"]).alias("h"), holds(F.col("s"), ["x"]).alias("n"))
    assert [(r["o"], r["h"]) for r in found.collect()] == [(True, True), (True, True), (False, False), (False, True), (False, True), (False, False), (False, False)]
    assert [r["n"] for r in found.collect()] == [False] * 6 + [None]
    plan = rows.select(overclaims(F.col("s")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.index("transform(array(") < plan.index("lower(") < plan.index("exists(")


def test_a_suite_resumes_where_its_markers_end(spark, tmp_path):
    configuration = {"manifest": "m1", "variants": ["full", "no_keyword", "no_verifier"]}
    part = lambda name: spark.range(20).select("id", F.lit(name).alias("variant"), (F.col("id") * len(name)).alias("value"))
    schema = "id long, variant string, value long"
    whole = Store(spark, f"{tmp_path}/whole", configuration)
    for name in whole.resume(configuration["variants"]):
        whole.publish(name, whole.stage(part(name), name))

    broken = Store(spark, f"{tmp_path}/broken", configuration)
    broken.publish("full", broken.stage(part("full"), "full"))
    broken.stage(part("no_keyword").limit(3), "no_keyword")  # the run ends here, before the marker
    again = Store(spark, f"{tmp_path}/broken", dict(reversed(configuration.items())))
    assert again.resume(configuration["variants"]) == ["no_keyword", "no_verifier"] and again.results(schema).count() == 20
    for name in again.resume(configuration["variants"]):
        again.publish(name, again.stage(part(name), name))
    rows = lambda store: sorted(map(tuple, store.results(schema).collect()))
    assert rows(again) == rows(whole) and len(rows(whole)) == 60

    with pytest.raises(ContractError, match="another configuration: manifest"):
        Store(spark, f"{tmp_path}/broken", configuration | {"manifest": "m2"})
    with pytest.raises(ContractError, match="already"):
        again.publish("full", again.stage(part("full"), "full"))
    with pytest.raises(ContractError, match="already"):
        again._publish("markers/000001.json", "{}")  # two runs that end at once: the second one finds the marker
    with pytest.raises(ContractError, match="first planned"):
        again.resume(["full", "no_verifier"])
    part("full").limit(2).write.mode("append").parquet(again.published()[0]["table"])
    with pytest.raises(ContractError, match="has changed"):
        again.results(schema)


def test_evidence_that_changes_between_attempts_is_rejected(spark, tmp_path):
    for case in ("c1", "c2", "c3"):
        (tmp_path / f"{case}.txt").write_text(f"evidence of {case}\n")
    read = lambda: files.whole_files(spark, str(tmp_path), "*.txt").select(F.substring_index("path", "/", -1).alias("path"), "sha256")
    cited = spark.createDataFrame([(r["path"][:2], r["path"], r["sha256"]) for r in read().collect()], "case_id string, path string, sha256 string")
    reply = lambda text: lambda items: items.select("query_id").distinct().withColumn("selection_text", F.lit(text))
    good = '{"status":"unconfirmed","cause_ids":["C1"],"check_ids":["K2"]}'

    def change(items):
        (tmp_path / "c2.txt").write_text("another text\n")
        return reply('{"status":')(items)

    before = investigate(incidents(spark), history(spark), selectors=[reply(good)], sources=Sources(cited, read))
    assert {r["query_id"]: r["status"] for r in before.answers.collect()} == {"q1": "unconfirmed", "q2": "unconfirmed", "q3": "refuse"} and before.changed.isEmpty()
    out = investigate(incidents(spark), history(spark), selectors=[change, reply(good)], sources=Sources(cited, read), audit_path=f"{tmp_path}/audit", run_id="r1")
    got = {r["query_id"]: (r["status"], r["error"], r["generation_attempts"]) for r in out.answers.collect()}
    assert got == {"q1": ("rejected", "a source has changed", 1), "q2": ("unconfirmed", None, 2), "q3": ("refuse", None, 0)}  # q1 retrieved c2; it is not tried again
    assert {(r["query_id"], r["stage"], r["path"]) for r in out.changed.collect()} == {("q1", "attempt 1", "c2.txt"), ("q1", "attempt 2", "c2.txt")}
    held = {name: spark.read.parquet(f"{tmp_path}/audit/{name}").filter("run_id = 'r1'").count() for name in out._fields}
    assert held == {"answers": 3, "attempts": 3, "eligibility": 2, "verification": 2, "changed": 2}
    with pytest.raises(ContractError, match="r1"):
        investigate(incidents(spark), history(spark), audit_path=f"{tmp_path}/audit", run_id="r1")
    investigate(incidents(spark), history(spark), audit_path=f"{tmp_path}/audit", run_id="r2")
    assert spark.read.parquet(f"{tmp_path}/audit/answers").groupBy("run_id").count().count() == 2


def test_two_readings_of_logs_agree(spark):
    plan = wafer_gen.WaferPlan(**PLAN)
    logs = wafer_gen.logs(wafer_gen.devices(spark, plan), plan).cache()

    def both(text):
        lines = number_lines(logs.withColumn("text", text), "text")
        tests = F.transform("tests", lambda t: F.struct(t["number"].alias("number"), t["status"].alias("status"), t["current"].alias("current"), F.transform(t["failing_pins"], lambda p: F.concat(p["name"], F.lit(":"), p["number"].cast("string"))).alias("pins"), t["halt_vector"].alias("halt_vector")))
        names = ["lot", "wafer", "device", "x", "y", "bin", "first_line", "last_line", "outcome"]
        a = wafer_parse.parse(lines, plan.product).select(*names, tests.alias("tests"))
        b = parse_by_line(lines).select(*names, "tests")
        return sorted(map(str, a.collect())), sorted(map(str, b.collect()))

    a, b = both(F.col("text"))
    assert a == b and len(a) == 96 and sum("FAIL'" in r for r in a) >= 24
    for pattern, new in ((r"Bin: +1\b", "Bin:  7"), (r"\(F\)", ""), (r"\d\d\.\d\d ma \(F\)", "44.44 ma (F)"), (r"Device: 003", "Device: 103"), (r"Wafer Coordinates: \( (\d)", "Wafer Coordinates: ( 1$1"), (r"Halt Vector: +[1-9]", "Halt Vector:  77")):
        a, changed = both(F.regexp_replace("text", pattern, new))
        assert a == changed and a != b, pattern


def test_a_collection_shows_published_versions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, t string")
    held = Collection(spark, f"{tmp_path}/c", "notes")
    assert held.records() is None and held.count() == 0
    held.upsert(rows((1, "a"), (2, "b")))
    held.upsert(rows((2, "new"), (3, None)))
    held.store.stage(rows((9, "unpublished")), "version-000002")
    again = Collection(spark, f"{tmp_path}/c", "notes")
    assert sorted(map(tuple, again.records().collect())) == [(1, "a"), (2, "new"), (3, None)] and again.count() == 3
    asked = rows((3, ""), (2, ""), (2, ""), (7, ""), (None, ""))
    assert sorted(r["id"] for r in again.get(asked).collect()) == [2, 3] and {r["id"] for r in again.missing(asked).collect()} == {7, None}
    for bad in (rows((5, "x"), (5, "y")), rows((None, "x"))):
        with pytest.raises(ContractError, match="S10"):
            again.upsert(bad)
    with pytest.raises(ContractError, match="another configuration"):
        Collection(spark, f"{tmp_path}/c", "others")


def test_chunks_are_summarised(spark):
    plan = wafer_gen.WaferPlan(**PLAN)
    logs = wafer_gen.logs(wafer_gen.devices(spark, plan), plan)
    chunks = wafer_parse.chunks(wafer_parse.parse(number_lines(logs, "text"), plan.product), "v1").cache()
    got = {(r["outcome"], r["failed_test"]): r for r in wafer_parse.chunk_summary(chunks).collect()}
    assert {k: r["n"] for k, r in got.items()} == {("PASS", None): 72, ("CONTINUITY_FAIL", 100): 8, ("IDD_STATIC_FAIL", 210): 8, ("SCAN_FAIL", 606): 8, (None, None): 96}
    assert got[None, None]["devices"] == 96 and got[None, None]["files"] == 8 and got[None, None]["longest_text"] == max(len(r["retrieval_text"]) for r in chunks.collect())


def write_published(folder, **changed):
    config = {
        "seed": 3, "product": "Chip_T", "lots": ["L01", "L02"], "wafers_per_lot": 4, "devices_per_wafer": 12, "start_time": "2026-01-01T08:00:00+08:00", "timezone": "Asia/Kuala_Lumpur", "outcome_quotas": PLAN["quotas"],
        "outcome_bins": PLAN["bins"], "pin_map": PLAN["pins"], "tester": "t", "program": "p", "sequencer": "s", "station": 1, "site": 0, "first_device_delay_seconds": 10, "device_interval_seconds": 3, "wafer_gap_seconds": 60,
        "idd_static": {"lower_mA": "35.00", "upper_mA": "55.00"}, "scan_vector_min": 1, "scan_vector_max": 8191,
    } | changed
    texts = {"config": json.dumps(config), "coordinate_template": json.dumps({"coordinates": [{"device": d, "x": x, "y": y} for d, x, y in GRID]})}
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    hashes = {f"{name}_sha256": hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    (folder / "manifest.json").write_text(json.dumps(hashes | {"files": []}))


def test_a_published_plan_is_held_to_its_manifest(spark, tmp_path):
    write_published(tmp_path)
    plan, manifest = wafer_gen.published_plan(spark, str(tmp_path), "t-1")
    assert plan.start == "2026-01-01 08:00:00" and plan.coordinates == GRID and manifest.isEmpty()
    for changed, message in (({"start_time": "2026-01-01T08:00:00+07:00"}, "offset"), ({"start_time": "2026-01-01T08:00:00"}, "offset"), ({"devices_per_wafer": 13}, "number of devices")):
        write_published(tmp_path, **changed)
        with pytest.raises(ContractError, match=message):
            wafer_gen.published_plan(spark, str(tmp_path), "t-1")
    write_published(tmp_path)
    (tmp_path / "config.json").write_text((tmp_path / "config.json").read_text() + "\n")
    with pytest.raises(ContractError, match="another hash"):
        wafer_gen.published_plan(spark, str(tmp_path), "t-1")


@pytest.mark.skipif("PROVENA_PUBLISHED" not in os.environ, reason="PROVENA_PUBLISHED names no folder of a published dataset")
def test_a_published_dataset_is_made_again_byte_by_byte(spark):
    """Every rendered log has the hash that the manifest names; PROVENA_PUBLISHED is the folder, PROVENA_PUBLISHED_VERSION the generator's version."""
    plan, manifest = wafer_gen.published_plan(spark, os.environ["PROVENA_PUBLISHED"], os.environ["PROVENA_PUBLISHED_VERSION"])
    devices = wafer_gen.devices(spark, plan).cache()
    logs = wafer_gen.logs(devices, plan).cache()
    made = logs.select(F.concat(F.lit("logs/"), "lot", F.lit("/"), "wafer", F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"))
    published = manifest.filter("path like 'logs/%'")
    assert made.count() == published.count() == 35 and wafer_parse.manifest_violations(published, made).isEmpty()
    report = wafer_parse.report(wafer_parse.parse(number_lines(logs, "text"), plan.product), list(plan.quotas))
    assert wafer_parse.total_violations(report, plan.quotas).isEmpty()
    total = report.filter("lot is null").first()
    assert (total["dut_count"], total["pass"], total["scan_fail"], total["idd_static_fail"], total["continuity_fail"]) == (3920, 3528, 196, 98, 98)
    assert (total["test_100"], total["test_210"], total["test_606"]) == (3920, 3822, 3724)
