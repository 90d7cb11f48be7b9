"""Independent read-back of wafer logs: blocks, fields, violations, reconciliation, reports and text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.hashing import content_id
from provena.functions.text import pin_list, pin_residue
from provena.operators.constraints import duplicates, union_all, unmatched, violations
from provena.operators.lines import segment

# The labels of the line format. A value follows its label and a colon; currents are given in ma.
WAFER, END, LOT, TESTER, PROGRAM, DEVICE, STATION, SITE, DATE, BIN, PLACE = (
    "Wafer", "End of Wafer", "Lot", "Tester", "Program", "Device", "Station", "Site", "Date", "Bin", "Wafer Coordinates",
)
START, COUNT, FINISH, VECTOR, CYCLE, PINS, LISTED = "Start Time", "Part Count", "Finish Time", "Halt Vector", "Halt Cycle", "Failing Pins", "Failed Pins"
PIN_TESTS, CURRENT_TEST, FLAG = {100: "Open/Short-", 606: "SCAN Test"}, "IDD_Static", "(F)"
OUTCOMES = {100: "CONTINUITY_FAIL", 210: "IDD_STATIC_FAIL", 606: "SCAN_FAIL"}


def log_time(text: Column) -> Column:
    """A zone-less log time; the weekday is left to a constraint."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(text, r"^\w{3}\s+", ""), r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy"))


def after(text: Column, label: str, kind: str = r"\S+") -> Column:
    """The value of this kind after a label that stands at a line's or a word's start; null without."""
    return F.nullif(F.regexp_extract(text, rf"(?m)(?:^|\s){label}:[^\S\n]*({kind})", 1), F.lit(""))


def whole_number(text: Column, label: str) -> Column:
    return after(text, label).try_cast("int")


def time_text(text: Column, label: str) -> Column:
    """The time after a label, which goes on to the end of its line."""
    return F.trim(after(text, label, r"[^\n]+"))


def test_part(block: Column, name: str) -> Column:
    """What a block says of a test: from its name to the next numbered test or the bin; null where it does not run."""
    numbered = F.regexp_replace(block, r"\n\s*(?=\d{3} [A-Z])|\n\s*(?=Bin:)", "\u0001")
    return F.get(F.filter(F.split(numbered, "\u0001"), lambda p: p.rlike(rf"^\d{{3}} {name}")), 0)


def blocks(lines: DataFrame) -> DataFrame:
    """Device blocks of the logs' lines (lot, wafer, line_no, line): first_line to the bin line, and their text."""
    kept = lines.filter(F.trim("line") != "").select("lot", "wafer", "line_no", "line")
    head = F.trim(F.substring_index("line", ":", 1))
    return segment(kept.filter(~head.isin(WAFER, END)), ["lot", "wafer"], head == LOT)


def _fields(**given: Column) -> Column:
    """A test's struct; what a kind of test lacks is null or empty."""
    empty = {"failing_pins": pin_list(F.lit("")), "residue": F.lit(""), "n_pins": F.lit(0)} | {c: F.lit(None).cast("int") for c in ("halt_vector", "halt_cycle")} | {c: F.lit(None).cast("string") for c in ("lower", "current", "upper")}
    cells = empty | given
    return F.struct(*(cells[c].alias(c) for c in ("number", "status", "failing_pins", "residue", "halt_vector", "halt_cycle", "n_pins", "lower", "current", "upper")))


def _status(part: Column) -> Column:
    return F.when(F.contains(part, F.lit(FLAG)), "FAIL").otherwise("PASS")


def _pin_test(b: Column, name: str, number: int) -> Column:
    part = test_part(b, name)
    listed = F.coalesce(F.get(F.split(part, f"{LISTED}:"), 1), F.lit(""))
    found = _fields(number=F.lit(number), status=_status(part), failing_pins=pin_list(listed), residue=pin_residue(listed), halt_vector=whole_number(part, VECTOR), halt_cycle=whole_number(part, CYCLE), n_pins=whole_number(part, PINS))
    return F.when(part.isNotNull() & whole_number(part, PINS).isNotNull(), found)


def _current_test(b: Column) -> Column:
    part = test_part(b, CURRENT_TEST)
    amounts = F.regexp_extract_all(part, F.lit(r"(\S+) ma\b"), F.lit(1))
    as_written = lambda k: F.when(F.get(amounts, k).rlike(r"^-?\d+\.\d\d$"), F.get(amounts, k))
    found = _fields(number=F.lit(210), status=_status(part), lower=as_written(0), current=as_written(1), upper=as_written(2))
    return F.when(F.size(amounts) == 3, found)


def parse(lines: DataFrame, product: str) -> DataFrame:
    """One row per device block with its fields and tests; what the grammar does not find is null."""
    b = F.col("block_text")
    every = F.array(_pin_test(b, PIN_TESTS[100], 100), _current_test(b), _pin_test(b, PIN_TESTS[606], 606))
    got = blocks(lines).withColumn("tests", F.filter(every, lambda t: t.isNotNull()))
    failed = F.filter("tests", lambda t: t["status"] == "FAIL")
    outcome = F.coalesce(*(F.when(F.get(failed, 0)["number"] == k, v) for k, v in OUTCOMES.items()), F.lit("PASS"))
    device = F.concat(F.lit("D"), after(b, DEVICE))
    place = F.transform(F.split(after(b, PLACE, r"\([^)\n]*\)"), ","), lambda x: F.regexp_replace(x, r"[()\s]", "").try_cast("int"))
    return got.select(
        "lot", "wafer", device.alias("device"), F.concat_ws("-", F.lit(product), "lot", "wafer", device).alias("dut_id"), after(b, LOT).alias("lot_named"),
        after(b, TESTER).alias("tester"), after(b, PROGRAM).alias("program"), whole_number(b, STATION).alias("station"), whole_number(b, SITE).alias("site"),
        log_time(time_text(b, DATE)).alias("device_time"), time_text(b, DATE).alias("device_time_text"),
        whole_number(b, BIN).alias("bin"), F.get(place, 0).alias("x"), F.get(place, 1).alias("y"), F.size(F.regexp_extract_all(b, F.lit(rf"(?m)^\s*{BIN}:"), F.lit(0))).alias("n_bins"),
        "tests", F.size(failed).alias("n_failed"), outcome.alias("outcome"), "first_line", "last_line", "block_text",
    )


def device_violations(parsed: DataFrame, bins: dict[str, int], pins: dict[str, int], lower: str, upper: str, vectors: tuple[int, int] | None = None, header: dict[str, object] | None = None) -> DataFrame:
    """Blocks that break the grammar's meaning: flags, counts, limits, order of tests, one failure at the end, the bin.

    vectors: least and most halt vector of a scan failure. header: what tester, program, station and site must be.
    """
    fails = lambda t: t["status"] == "FAIL"
    known = F.create_map(*(F.lit(x) for kv in pins.items() for x in kv))
    number, dec = F.transform("tests", lambda t: t["number"]), lambda c: c.try_cast("decimal(6,2)")
    is_current = lambda t: t["number"] == 210
    strictly = lambda t: (dec(t["current"]) > dec(t["lower"])) & (dec(t["current"]) < dec(t["upper"]))
    bin_of = F.create_map(*(F.lit(x) for kv in bins.items() for x in kv))
    rules = {
        "C02-bin": (F.col("n_bins") == 1, "needs one bin line"),
        "C03-lot": (F.col("lot_named") == F.col("lot"), "lot differs from its folder"),
        "C03-weekday": (F.date_format("device_time", "EEE") == F.substring("device_time_text", 1, 3), "weekday differs from the date"),
        "C04-flag": (F.forall("tests", lambda t: is_current(t) | (fails(t) == (t["n_pins"] > 0))), "failing pins and flag disagree"),
        "C04-count": (F.forall("tests", lambda t: is_current(t) | (t["n_pins"] == F.size(t["failing_pins"]))), "pin count differs from the list"),
        "C04-list": (F.forall("tests", lambda t: t["residue"] == ""), "pin list is malformed"),
        "C04-halt": (F.forall("tests", lambda t: is_current(t) | (fails(t) == t["halt_vector"].isNotNull())), "halt fields and flag disagree"),
        "C04-names": (F.forall("tests", lambda t: F.forall(t["failing_pins"], lambda p: F.try_element_at(known, p["name"]).eqNullSafe(p["number"]))), "pin is not in the map"),
        "C04-unique": (F.forall("tests", lambda t: F.size(F.array_distinct(t["failing_pins"])) == F.size(t["failing_pins"])), "pin is listed twice"),
        "C05-limits": (F.forall("tests", lambda t: ~is_current(t) | ((t["lower"] == lower) & (t["upper"] == upper))), "limits differ from the plan"),
        "C05-flag": (F.forall("tests", lambda t: ~is_current(t) | (fails(t) != strictly(t))), "flag and limits disagree"),
        "C06-order": (number == F.slice(F.array(F.lit(100), F.lit(210), F.lit(606)), F.lit(1), F.size("tests")), "tests are out of order"),
        "C06-stop": ((F.col("n_failed") <= 1) & F.forall(F.slice("tests", F.lit(1), F.greatest(F.size("tests") - 1, F.lit(0))), lambda t: ~fails(t)), "goes on after a failure"),
        "C06-complete": ((F.col("n_failed") == 1) | (F.size("tests") == 3), "stops without a failure"),
        "C06-outcome": (F.try_element_at(bin_of, F.col("outcome")) == F.col("bin"), "bin differs from the outcome"),
    }
    if vectors:
        inside = lambda t: (t["number"] != 606) | t["halt_vector"].isNull() | t["halt_vector"].between(*vectors)
        rules["C04-vector"] = (F.forall("tests", inside), "halt vector out of range")
    for field, value in (header or {}).items():
        rules[f"C03-{field}"] = (F.col(field) == value, f"{field} differs from the plan")
    return violations(parsed, "dut_id", rules)


def wafer_violations(parsed: DataFrame, lines: DataFrame, template: DataFrame, start: str | None = None) -> DataFrame:
    """Wafers without header or footer, with a wrong part count, times out of order, or devices unlike the template.

    start: when the first wafer must begin. A wafer's time is compared with that of the one before it, which is found by
    its rank among wafers; wafers are ranked within their lot, lots by their first wafer.
    """
    head, line = F.trim(F.substring_index("line", ":", 1)), F.col("line")
    at = lambda mark: head == mark
    marks = lines.groupBy("lot", "wafer").agg(
        F.max(F.when(at(WAFER), log_time(time_text(line, START)))).alias("start"), F.max(F.when(at(END), log_time(time_text(line, FINISH)))).alias("finish"),
        F.max(F.when(at(END), whole_number(line, COUNT))).alias("parts"), F.max(F.when(F.trim("line") != "", F.col("line_no"))).alias("_at"), F.max(F.when(at(END), F.col("line_no"))).alias("_end"),
    )
    n = parsed.groupBy("lot", "wafer").agg(F.count("*").alias("n"), F.min("device_time").alias("first"), F.max("device_time").alias("last"))
    both = marks.join(n, ["lot", "wafer"], "left").withColumn("key", F.concat_ws("/", "lot", "wafer"))
    within = Window.partitionBy("lot").orderBy("start")  # a row per wafer, not per line
    lots = both.groupBy("lot").agg(F.min("start").alias("_from"), F.max("finish").alias("_to"))
    before = lots.alias("a").join(lots.alias("b"), F.col("b._from") < F.col("a._from"), "left").groupBy("a.lot").agg(F.max_by("b._to", "b._from").alias("_earlier"))  # a row per lot
    both = both.withColumn("before", F.lag("finish").over(within)).join(before, "lot").withColumn("before", F.coalesce("before", "_earlier"))
    a = violations(both, "key", {
        "C02-header": (F.col("start").isNotNull(), "no header"), "C02-footer": (F.col("_end") == F.col("_at"), "no footer at the end"), "C08-parts": (F.col("parts") == F.col("n"), "part count differs"),
        "C07-times": ((F.col("first") > F.col("start")) & (F.col("finish") >= F.col("last")), "times out of order"), "C07-wafers": (F.col("before").isNull() | (F.col("start") >= F.col("before")), "starts before the last one ends"),
        "C07-first": (F.col("before").isNotNull() | F.lit(start is None) | (F.col("start") == F.lit(start).cast("timestamp_ntz")), "first wafer starts at another time"),
    })
    w = Window.partitionBy("lot", "wafer").orderBy("first_line")
    late = parsed.withColumn("p", F.lag("device_time").over(w)).filter("device_time < p")
    b = late.select(F.lit("C07-devices").alias("rule_id"), F.col("dut_id").alias("entity_key"), F.lit("earlier than the device before").alias("message"))
    placed = parsed.join(template.select("device", F.col("x").alias("tx"), F.col("y").alias("ty")), "device", "left")
    c = violations(placed, "dut_id", {"C08-place": ((F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty")), "position differs from the template")})
    return union_all([a, b, c, duplicates(parsed, ["dut_id"], "C08-unique")])


def reconcile(parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """Devices that only one side has, and fields that differ: outcome, bin, place, time and every test."""
    m = metadata.select("dut_id", *(F.col(c).alias(f"m_{c}") for c in ("outcome", "bin", "x", "y", "device_time", "tests")))
    both = parsed.join(m, "dut_id")
    same = lambda t, u: (t["number"] == u["number"]) & (t["status"] == u["status"]) & (t["failing_pins"] == u["failing_pins"]) & t["halt_vector"].eqNullSafe(u["halt_vector"]) & t["current"].eqNullSafe(u["current"])
    rules = {f"C09-{c}": (F.col(c).eqNullSafe(F.col(f"m_{c}")), f"{c} differs") for c in ("outcome", "bin", "x", "y", "device_time")}
    rules["C09-tests"] = ((F.size("tests") == F.size("m_tests")) & F.forall(F.zip_with("tests", "m_tests", same), lambda ok: ok), "tests differ")
    return unmatched(parsed, metadata, ["dut_id"], "C09-devices").unionByName(violations(both, "dut_id", rules))


def report(parsed: DataFrame, outcomes: list[str]) -> DataFrame:
    """Counts per wafer and overall (null lot and wafer), zeros included: devices, outcomes, executions of each test."""
    ran = lambda k: F.count_if(F.exists("tests", lambda t: t["number"] == k)).alias(f"test_{k}")
    cells = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in outcomes] + [ran(k) for k in OUTCOMES]
    per = parsed.groupBy("lot", "wafer").agg(F.count("*").alias("dut_count"), *cells)
    names = [c for c in per.columns if c not in ("lot", "wafer")]
    total = per.agg(*(F.sum(c).alias(c) for c in names)).select(F.lit(None).cast("string").alias("lot"), F.lit(None).cast("string").alias("wafer"), *names)
    return per.unionByName(total)


def chunks(parsed: DataFrame, version: str, prefix: str = "ck-") -> DataFrame:
    """Source-linked text chunks: id by content, line span, retrieval text, the test that failed."""
    failed = F.get(F.filter("tests", lambda t: t["status"] == "FAIL"), 0)["number"]
    ran = F.transform("tests", lambda t: F.concat_ws(" ", t["number"].cast("string"), t["status"]))
    about = F.format_string("Device %s in lot %s, wafer %s. Outcome %s, bin %d. Tests: %s.", "device", "lot", "wafer", "outcome", "bin", F.array_join(ran, ", "))
    return parsed.select(
        content_id(prefix, version, F.col("dut_id"), F.sha2("block_text", 256)).alias("chunk_id"), "dut_id", "lot", "wafer", "device", "outcome", "bin", failed.alias("failed_test"),
        F.transform("tests", lambda t: t["number"]).alias("executed_tests"), F.struct(F.col("first_line").alias("start"), F.col("last_line").alias("end")).alias("source_lines"), F.col("block_text").alias("source_text"),
        F.concat(about, F.lit("\n"), "block_text").alias("retrieval_text"),
    )


def one_failure(parsed: DataFrame) -> DataFrame:
    """Devices with exactly one failing test, as excerpts of their logs: test, pins, lines and the excerpt's hash."""
    failed = F.get(F.filter("tests", lambda t: t["status"] == "FAIL"), 0)
    text = F.trim(F.regexp_replace("block_text", r"^\s+|\s+$", ""))
    return parsed.filter("n_failed = 1").select("dut_id", "lot", "wafer", failed["number"].alias("failed_test"), F.transform(failed["failing_pins"], lambda p: p["name"]).alias("pins"), "first_line", "last_line", F.sha2(text, 256).alias("excerpt_sha256"))


def total_violations(report_: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Totals that differ from the plan: outcomes by quota, and executions by what the tests before let through."""
    n, fails = sum(quotas.values()), lambda *kinds: sum(quotas[k] for k in kinds)
    rules = {k: (F.col(k.lower()) == v, f"{k} differs from its quota") for k, v in quotas.items()}
    rules |= {"devices": (F.col("dut_count") == n, "another number of devices")}
    through = {100: n, 210: n - fails("CONTINUITY_FAIL"), 606: n - fails("CONTINUITY_FAIL", "IDD_STATIC_FAIL")}
    rules |= {f"test_{k}": (F.col(f"test_{k}") == v, "another number of executions") for k, v in through.items()}
    return violations(report_.filter("lot is null and wafer is null").withColumn("scope", F.lit("overall")), "scope", {f"C10-{k}": v for k, v in rules.items()})


def manifest_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) that repeat, lie outside, or differ from the files (path, sha256) there are, both ways."""
    now = files.select("path", F.col("sha256").alias("_now"))
    safe = ~F.col("path").startswith("/") & ~F.concat(F.lit("/"), "path", F.lit("/")).contains("/../")
    rules = {"C11-path": (safe, "lies outside"), "C11-hash": (F.coalesce(F.col("_now"), F.col("sha256")) == F.col("sha256"), "has another hash")}
    return union_all([violations(manifest.join(now, "path", "left"), "path", rules), duplicates(manifest, ["path"], "C11-unique"), unmatched(manifest, files, ["path"], "C11-files")])


def report_violations(stored: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a stored report that are not, field by field, those computed again; both ways."""
    names = [c for c in computed.columns if c not in key]
    row = lambda df, name: df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("overall")).alias(c) for c in key), F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}).alias(name))
    both = row(stored, "_stored").join(row(computed, "_made"), key, "full_outer")
    return violations(both, F.concat_ws("/", *key), {"C12-report": (F.col("_stored") == F.col("_made"), "differs from the report computed again")})


def chunk_violations(chunks_: DataFrame, quotas: dict[str, int], most: int = 2000) -> DataFrame:
    """Chunks that are too long or repeat, whose last test disagrees with their outcome, and counts unlike the quotas."""
    last = F.element_at("executed_tests", -1)
    fits = F.when(F.col("failed_test").isNull(), (F.col("outcome") == "PASS") & (last == 606)).otherwise(last == F.col("failed_test"))
    a = violations(chunks_, "chunk_id", {"C13-text": ((F.length("source_text") <= most) & (F.length("retrieval_text") <= most), "is too long"), "C13-last": (fits, "last test and outcome disagree")})
    counts = chunks_.groupBy("outcome").agg(F.count("*").alias("n"))
    wanted = F.coalesce(*(F.when(F.col("outcome") == k, v) for k, v in quotas.items()))
    return union_all([a, duplicates(chunks_, ["chunk_id"], "C13-unique"), violations(counts, "outcome", {"C13-quota": (F.col("n") == wanted, "another number of chunks")})])


def chunk_summary(chunks_: DataFrame) -> DataFrame:
    """One row for each outcome and failed test, and one for all (null outcome): chunks, devices, files, and the longest texts."""
    cells = [
        F.count("*").alias("n"), F.count_distinct("dut_id").alias("devices"), F.count_distinct("lot", "wafer").alias("files"),
        F.max(F.length("source_text")).alias("longest_source"), F.max(F.length("retrieval_text")).alias("longest_text"),
    ]
    per = chunks_.groupBy("outcome", "failed_test").agg(*cells)
    return per.unionByName(chunks_.agg(*cells).select(F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("int").alias("failed_test"), "n", "devices", "files", "longest_source", "longest_text"))


def scenario_sources(scenarios: DataFrame, chunks_: DataFrame) -> DataFrame:
    """Scenarios (dut_id, ...) with the chunk and source lines that each rests on; one without a chunk stays, with nulls."""
    return scenarios.join(chunks_.select("dut_id", "chunk_id", "source_lines", "outcome", "failed_test"), "dut_id", "left")
