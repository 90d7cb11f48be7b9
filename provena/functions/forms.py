"""Incident forms: hints of a free text log, and a form with its log as one incident; conflicts and ambiguity are errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.phrases import holds, parts_after, token_line

# The product, its tests, their names in logs, the marks of a failure, and limits of what is entered.
PRODUCT = "Product_A"
TESTS = {100: "Continuity / Open\u2013Short", 210: "IDD_Static", 606: "Scan"}
TEST_NAMES = ("open/short-", "open/short", "continuity", "idd_static", "scan")
FAILURE_WORDS, FAILURE_SIGN, PINS_LABEL = ("fail", "failed"), "(f)", "failing pins:"
MOST_TEXT, MOST_NAME, MOST_QUESTION = 12_000, 100, 1_000
NAME_CHARS = "[A-Za-z0-9_.-]"
NOTICE = "No log or observation was supplied: measurements and results of checks are unknown."

NAME_MARK, NUMBER_MARK = "\u0001", "\u0002"  # stand for a name and a number while a line is read


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def _mentions(part: Column) -> Column:
    """array<struct<number, said>> of the tests that a part of a line names with their number, and what is said up to the next one.

    The number stands before the name, after white space, or behind it in brackets; a name alone is a word like others.
    """
    marked = F.translate(F.lower(part), NAME_MARK + NUMBER_MARK, "  ")
    for name in TEST_NAMES:
        marked = F.replace(marked, F.lit(name), F.lit(NAME_MARK))
    chunks = F.split(marked, NAME_MARK)
    ahead = lambda c: F.regexp_extract(c, r"(?<![\p{L}\p{N}_])([0-9]{2,4})\s+$", 1)
    behind = lambda c: F.regexp_extract(c, r"^\s*\(([0-9]{2,4})\)", 1)

    def told(i: Column) -> Column:
        here, last = F.get(chunks, i), i == F.size(chunks) - 1
        own = F.when(last, here).otherwise(F.regexp_replace(here, r"(?<![\p{L}\p{N}_])[0-9]{2,4}\s+$", ""))  # the next one's number
        before, after = ahead(F.get(chunks, i - 1)), behind(here)
        return F.when(before != "", F.concat(F.lit(NUMBER_MARK), before, F.lit(NAME_MARK), own)).when(after != "", F.concat(F.lit(NUMBER_MARK), after, F.lit(NAME_MARK), F.substring_index(own, ")", -1))).otherwise(own)

    joined = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.size(chunks)), 2, F.size(chunks) - 1), told), " ")
    found = F.slice(F.split(joined, NUMBER_MARK), 2, 1 << 30)
    return F.transform(found, lambda m: F.struct(F.substring_index(m, NAME_MARK, 1).cast("int").alias("number"), F.substring_index(m, NAME_MARK, -1).alias("said")))


def _says_failed(said: Column) -> Column:
    pins = F.exists(parts_after(said, F.lit(PINS_LABEL)), lambda r: F.regexp_replace(r, r"^\s+", "").rlike("^[1-9]"))
    return holds(token_line(said), FAILURE_WORDS) | F.contains(said, F.lit(FAILURE_SIGN)) | pins


def failed_tests(text: Column) -> Column:
    """Distinct numbers of the tests that a log calls failed: each mention is judged by what follows on its line, up to a semicolon or the next one."""
    told = F.flatten(F.transform(F.split(text, "[\n;]"), _mentions))
    return F.array_distinct(F.transform(F.filter(told, lambda m: _says_failed(m["said"])), lambda m: m["number"]))


def log_hints(text: Column) -> Column:
    """struct<dut_id, product, tester, program, failed_test, error>: what a log says of itself; null where it says nothing.

    error names the first of: text (too long), dut_id, tester, program, failed_test (more than one of them), test
    (a number that no test has). A null text says nothing.
    """
    t = F.coalesce(text, F.lit(""))
    duts = F.array_distinct(F.concat(_all(t, rf"\b{PRODUCT}-L\d+-W\d+-D\d+\b", 0), _all(t, rf"(?im)^\s*DUT\s*:\s*({NAME_CHARS}+)", 1)))
    tester, program = (_all(t, rf"\b{label}:\s*({NAME_CHARS}+)", 1) for label in ("Tester", "Program"))
    failed = failed_tests(t)
    many = {"dut_id": duts, "tester": tester, "program": program, "failed_test": failed}
    error = F.coalesce(
        F.when(F.length(t) > MOST_TEXT, F.lit("text")), *(F.when(F.size(v) > 1, F.lit(k)) for k, v in many.items()),
        F.when((F.size(failed) == 1) & ~F.get(failed, 0).isin(*TESTS), F.lit("test")),
    )
    product = F.when(F.contains(t, F.lit(PRODUCT)), PRODUCT)
    return F.struct(F.get(duts, 0).alias("dut_id"), product.alias("product"), F.get(tester, 0).alias("tester"), F.get(program, 0).alias("program"), F.get(failed, 0).alias("failed_test"), error.alias("error"))


def incidents(forms: DataFrame, key: str = "form_id") -> DataFrame:
    """Every form (observation, product, failed_test, dut_id, tester, program, pins, question, synthetic; all but the last strings) as an incident, and error.

    What is entered wins over the log's hints and may not contradict them. error names the first broken rule, and the
    incident's fields then say nothing reliable: log-..., product, test, ...-conflict, ...-form, question, pins. A device
    that is not named gets an id from the form's key.
    """
    entered = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    f = forms.select("*", entered("observation").alias("_text")).withColumn("_h", log_hints(F.col("_text")))
    given = {c: entered(c) for c in ("product", "dut_id", "tester", "program")}
    value = {c: F.coalesce(F.nullif(v, F.lit("")), F.col(f"_h.{c}"), F.lit("")) for c, v in given.items()}
    test = F.coalesce(F.when(entered("failed_test") != "", F.coalesce(entered("failed_test").try_cast("int"), F.lit(-1))), F.col("_h.failed_test"), F.lit(0))
    pins = F.filter(F.transform(F.split(entered("pins"), ","), lambda p: F.trim(p)), lambda p: p != "")
    question = entered("question")
    conflict = lambda c: (given[c] != "") & (F.col(f"_h.{c}") != given[c])
    rules = {
        "product": value["product"] != PRODUCT, "test": ~test.isin(*TESTS), "failed_test-conflict": F.col("_h.failed_test") != test,
        **{f"{c}-conflict": conflict(c) for c in ("dut_id", "tester", "program")},
        "dut_id-form": (value["dut_id"] != "") & ~value["dut_id"].rlike(f"^{NAME_CHARS}{{1,120}}$"),
        "names-form": (F.length(value["tester"]) > MOST_NAME) | (F.length(value["program"]) > MOST_NAME),
        "question": ~F.length(question).between(1, MOST_QUESTION), "pins": F.exists(pins, lambda p: ~p.rlike("^[A-Za-z0-9_+-]{1,40}$")),
    }
    log_error = F.when(F.col("_h.error").isNotNull(), F.concat(F.lit("log-"), F.col("_h.error")))
    error = F.coalesce(log_error, *(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()))
    known = lambda x, other: F.when(x == "", other).otherwise(x)
    notice = F.when(F.col("_text") == "", NOTICE).otherwise("")
    test_name = F.create_map(*(F.lit(x) for kv in TESTS.items() for x in kv))[test]
    told = F.concat(
        known(value["dut_id"], "DUT unspecified"), F.lit("; "), value["product"], F.lit("; tester "), known(value["tester"], "unknown"), F.lit("; program "), known(value["program"], "unknown"),
        F.lit("; failed test "), test.cast("string"), F.lit(" "), test_name, F.lit("; pins "), known(F.array_join(pins, ", "), "unknown"), F.lit(". "), known(F.col("_text"), notice),
    )
    return f.select(
        key, F.coalesce(F.nullif(value["dut_id"], F.lit("")), F.concat(F.lit("query-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 32))).alias("dut_id"), (value["dut_id"] != "").alias("dut_id_provided"),
        F.lit("query_only").alias("role"), F.lit(False).alias("index_as_history"), value["product"].alias("product"), value["tester"].alias("tester"), value["program"].alias("program"),
        test.alias("test_number"), pins.alias("pins"), F.col("_text").alias("observation"), notice.alias("input_notice"), told.alias("retrieval_text"), question.alias("question"),
        F.coalesce(F.col("synthetic"), F.lit(False)).alias("synthetic"), error.alias("error"),
    )
