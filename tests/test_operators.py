"""Relational operators: constraints, retrieval, cases, selections, scoring, conversations, suites."""

from __future__ import annotations

import json

import pytest
from provena.functions import forms, phrases, text, vectors
from provena.functions.hashing import content_id, hash_number, unit_interval
from provena.operators import cases, chat, scoring, suite
from provena.operators.constraints import ContractError, duplicates, enforce, unmatched, violations
from provena.operators.lines import excerpt_hash, number_lines, segment
from provena.operators.retrieval import answer_or_refuse, fresh, fuse, nearest, scoped_pairs, upsert
from provena.operators.sampling import adjacent_triples, first_k_by_hash, hash_quota
from pyspark.sql import functions as F


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_violations_count_null_as_broken_and_enforce_raises(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id long, n long")
    found = violations(df, "id", {"R1": (F.col("n") > 0, "not positive"), "R2": (F.col("id") < 3, "id too large")})
    assert values(found, "rule_id", "entity_key") == [("R1", "2"), ("R1", "3"), ("R2", "3")]
    with pytest.raises(ContractError, match="R1 2: not positive"):
        enforce(found)
    enforce(found.limit(0))
    assert values(duplicates(df.union(df.limit(1)), ["id"], "D"), "entity_key") == [("1",)]
    assert values(unmatched(df, spark.createDataFrame([(3,), (4,)], "id long"), ["id"], "U"), "entity_key", "message") == [("1", "missing on the right"), ("2", "missing on the right"), ("4", "missing on the left")]


def test_hashes_follow_sha256(spark):
    import hashlib

    digest = hashlib.sha256(b"v|7|a").hexdigest()
    assert int(one(spark, hash_number("v", 7, "a"))) == int(digest[:16], 16)
    assert one(spark, unit_interval("v", 7, "a")) == int(digest[:16], 16) / 2**64
    assert one(spark, content_id("p-", "v", 7, "a")) == "p-" + digest[:24]


def test_tokens_hints_pins_references_sentences(spark):
    t = "The Chip_A-L01-W02-D003 pin XCKP at 45 of the_pin; A é"
    assert one(spark, text.tokens(F.lit(t))) == ["the", "pin", "xckp", "the_pin"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.only_hint(F.lit("lot L01 and L01"), r"(L\d+)")) == "L01" and one(spark, text.only_hint(F.lit("L01 L02"), r"(L\d+)")) is None
    assert one(spark, text.is_ambiguous(F.lit("L01 L02"), r"(L\d+)"))
    pins = one(spark, text.pin_list(F.lit("  PA : 1    PB:22\n PC : 3")))
    assert [tuple(p) for p in pins] == [("PA", 1), ("PB", 22), ("PC", 3)] and one(spark, text.pin_residue(F.lit("PA : 1, PB : 2"))) == ","
    assert one(spark, text.references(F.lit("as [E1, E2] and [E2] but not E9 [X]"))) == ["E1", "E2"] and one(spark, text.references(F.lit("[see E1; E2] [E3\nE4] [E5x]"))) == ["E1", "E2"]
    assert one(spark, text.sentences(F.lit("One. Two!  Three?\nfour"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, text.replace_identifier(F.lit("D005 D0050 xD005 D005. P-D005"), F.lit("D005"), F.lit("D$9\\"))) == "D$9\\ D0050 xD005 D$9\\. P-D005"
    told = lambda current: one(spark, text.adapt_procedure(F.lit("probe P-L01-D005, then D005 and D0051"), F.lit("P-L01-D005"), F.lit(current).cast("string")))
    assert told("N1") == "probe the current DUT (N1), then the current DUT (N1) and D0051" and told(None) == told("") == "probe the current DUT, then the current DUT and D0051"
    assert one(spark, text.squeeze(F.lit("  a \n b "))) == "a b" and "<|" not in one(spark, text.escape_markers(F.lit("<|user|>")))


DIRECTIONS = [
    ("210 IDD_Static         curr         12.50 ma <    41.07 ma (F) <  20.00 ma", "high", None), ("x (210 IDD_Static curr 12.50 mA < 3.25 mA (F) < 20.00 mA) y", "low", None),
    ("210 IDD_Static curr 20.00 ma < 25.00 ma (F) < 12.50 ma", None, "limits"), ("210 IDD_Static curr 12.50 ma < 14.00 ma < 20.00 ma", None, None), ("1210 IDD_Static 1 ma < 9 ma (F) < 2 ma", None, None),
    ("606 Scan\n210 IDD_Static a 1.5 ma < 2 ma\n210 IDD_Static b 1.5 ma < 9 ma (F) < 2.5 ma", "high", None),
    ("Measured static current: 27.30 mA. Limits: 12.00–20.00 mA", "high", None), ("Measured static current: 4.81 mA\nAllowed range: 12.00–20.00 mA", "low", None),
    ("measured current: 20 mA; limits: 12-20 mA", None, None), ("measured current: 12.00 mA; limit: 12-20 mA", None, None), ("measured current about 27 mA; limits: 12-20 mA", None, None),
    ("measured current: none; measured current: 27 mA; limits: wide, limits : 12 - 20 mA", "high", None), ("measured current: 1e3 mA; limits: 12-20 mA", None, None),
    ("measured current: 24 mA, limits: 12 - 20 mA, below the lower limit", None, "conflict"), ("measured current: 15 mA, limits: 12 - 20 mA, below the lower limit", None, None), ("measured current: 24 mA, limits: 20-12 mA", None, "limits"),
    ("Current exceeds the upper limit.", "high", None), ("The maximum was exceeded", "high", None), ("reading under the minimum", "low", None), ("It is low.", None, None), ("above the limit and below the limit", None, None), ("nothing", None, None), (None, None, None),
    ("above" + "." * 35 + "limit", "high", None), ("above" + "." * 36 + "limit", None, None), ("above\nlimit", None, None), ("aboveboard limit, overlimit", None, None), ("over, over, far beyond what was its limit", "high", None), ("high, failing; low, failures", None, None), ("low, failures", "low", None),
]


def test_an_observation_is_composed_once(spark):
    """However often its reading names the text, what it is composed of is worked out once."""
    rows = spark.createDataFrame([("mA\nlimits: 35-55 mA",)], "o string")
    read = rows.select(text.read_direction(F.concat(F.lit("Measured current: 60 "), F.reverse(F.reverse("o")))).alias("d"))
    assert read.first()["d"].asDict() == {"direction": "high", "error": None}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1


def test_directions(spark):
    rows = spark.createDataFrame([(i, o) for i, (o, _, _) in enumerate(DIRECTIONS)], "i int, o string")
    got = {r["i"]: (r["d"]["direction"], r["d"]["error"]) for r in rows.select("i", text.read_direction(F.col("o")).alias("d")).collect()}
    assert {DIRECTIONS[i][0]: v for i, v in got.items()} == {o: (d, e) for o, d, e in DIRECTIONS}


def test_cause_directions_and_applicability(spark):
    sides = {"Excessive static current path": "high", "high load": "high", "a low supply": "low", "high or low": None, "leakage path": None, "open line": None}
    assert {k: one(spark, text.cause_direction(F.lit(k))) for k in sides} == sides
    for number, a, b, want in ((210, "high", "high", True), (210, "high", "low", False), (210, None, "low", False), (210, None, None, False), (100, None, None, True)):
        assert one(spark, cases.applicable(F.lit(number), F.lit(a).cast("string"), F.lit(b).cast("string"))) is want


def test_similarity_round_trip(spark):
    d = vectors.squared_l2(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0)))
    assert one(spark, d) == 5.0 and round(one(spark, vectors.distance_of(vectors.similarity(d))), 9) == 5.0
    assert one(spark, vectors.distance_of(F.lit(0.0))) is None and one(spark, vectors.distance_of(F.lit(1.5))) is None


def test_fusion_flips_the_vector_order_and_refuses_without_scope(spark):
    rows = [("q", "s", [0.0], ["alpha", "beta"]), ("a", "s", [0.1], ["gamma"]), ("b", "s", [0.2], ["alpha", "beta"]), ("lone", "t", [0.0], ["alpha"])]
    every = spark.createDataFrame(rows, "id string, scope string, vector array<double>, tokens array<string>")
    queries = every.filter("id in ('q', 'lone')")
    near = nearest(scoped_pairs(queries, every, ["scope"]), k=2)
    order = lambda mode: [r["h_id"] for r in fuse(near, mode).filter("q_id = 'q'").orderBy("rank").collect()]
    assert order("vector") == ["a", "b"] and order("hybrid") == ["b", "a"]
    out = answer_or_refuse(queries, fuse(near))
    assert values(out, "q_id", "h_id", "status") == [("lone", None, "refuse"), ("q", "a", "unconfirmed"), ("q", "b", "unconfirmed")]


def test_index_freshness_and_upsert(spark):
    held = spark.createDataFrame([(1, "a"), (2, "old")], "id long, t string")
    source = spark.createDataFrame([(1, "a"), (2, "new"), (3, None)], "id long, t string")
    assert values(fresh(held, source, "id", "t"), "entity_key", "message") == [("2", "text differs"), ("3", "not indexed")]
    assert values(upsert(held, source.filter("id > 1"), "id"), "id", "t") == [(1, "a"), (2, "new"), (3, None)]


def test_lines_blocks_and_excerpts(spark):
    files = spark.createDataFrame([("f", "S one\nx\nS two\n"), ("g", "")], "path string, text string")
    lines = number_lines(files, "text")
    assert values(lines, "path", "line_no", "line") == [("f", 1, "S one"), ("f", 2, "x"), ("f", 3, "S two"), ("g", 1, "")]
    assert values(segment(lines, ["path"], F.col("line").startswith("S")), "first_line", "last_line", "block_text") == [(1, 2, "S one\nx"), (3, 3, "S two")]
    got = excerpt_hash(lines, spark.createDataFrame([("f", 2, 9), ("g", 5, 6)], "path string, first_line int, last_line int"), "path").first()
    import hashlib

    assert got["excerpt_sha256"] == hashlib.sha256(b"x\nS two").hexdigest() and got["n_lines"] == 2


def test_sampling(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, g long")
    picked = hash_quota(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id", 3)
    assert picked.count() == 6
    assert one(spark, first_k_by_hash(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x: F.sha2(x, 256), F.lit(2))) == ["c", "b"]
    grid = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (9, 1), (10, 1)], "x int, y int")
    assert values(adjacent_triples(grid), "x", "y") == [(0, 0), (1, 0)]


RECORDS = [("c1", f"r{i}", "d1", "o1", s, "historical", True, False) for i, s in enumerate(cases.STAGES)]
RECORD = "case_id string, record_id string, dut_id string, observation_id string, stage string, role string, synthetic boolean, physical_test_performed boolean"


def test_linked_stages(spark):
    assert cases.link_violations(spark.createDataFrame(RECORDS, RECORD)).count() == 0
    broken = [(*RECORDS[0][:2], "d2", *RECORDS[0][3:]), *RECORDS[1:3], (*RECORDS[3][:6], None, False)]
    assert values(cases.link_violations(spark.createDataFrame(broken, RECORD)), "rule_id") == [("device",), ("synthetic",)]
    assert values(cases.link_violations(spark.createDataFrame(RECORDS[:3], RECORD)), "rule_id") == [("stages",)]
    pivot = cases.stage_pivot(spark.createDataFrame(RECORDS[:3], RECORD), ["case_id"], "record_id").first()
    assert pivot["action"] == "r2" and pivot["retest"] is None and not pivot["complete"]


def test_catalog_pins_aliases_and_facts(spark):
    matches = spark.createDataFrame(
        [("q", 1, "c1", "d1", ["pin PA worn", "dirty socket"], ["probe PA"], ["PA", "PB"], ["PB"]), ("q", 2, "c2", "d2", ["PB bent"], ["clean it"], ["PB"], ["PB"])],
        "query_id string, rank int, case_id string, dut_id string, possible_causes array<string>, checks array<string>, case_pins array<string>, pins array<string>",
    )
    items = cases.catalog(matches).join(matches.select("query_id", "case_id", "pins", "case_pins"), ["query_id", "case_id"])
    kept = cases.without_foreign_pins(items, F.col("case_pins"), F.col("pins"))
    named = cases.alias_catalog(kept, ["query_id"], ["rank", F.col("kind") == "check", "ordinal"])
    assert [(r["alias"], r["item_id"]) for r in named.orderBy("pos").collect()] == [("C1", "c1-C2"), ("K2", "c1-K1"), ("C3", "c2-C1"), ("K4", "c2-K1")]
    picks = spark.createDataFrame([("q", ["K4", "C9"])], "query_id string, ids array<string>")
    assert values(cases.resolve_aliases(picks, named, "query_id", "ids"), "pos", "alias", "item_id", "known") == [(1, "K4", "c2-K1", True), (2, "C9", None, False)]
    chosen = json.loads(cases.select_by_rule(named, ["query_id"]).first()["selection_text"])
    assert chosen == {"cause_ids": ["C1", "C3"], "check_ids": ["K2", "K4"], "status": "unconfirmed"}
    case = spark.createDataFrame([("c", ["x"], [("look", "ok")], "as", None, "co", "li")], "case_id string, possible_causes array<string>, check_results array<struct<check:string,result:string>>, assessment string, action_taken string, conclusion string, limitation string")
    assert [(r["alias"], r["text"]) for r in cases.facts(case).orderBy("pos").collect()] == [("E1", "x"), ("E2", "look: ok"), ("E3", "as"), ("E4", "co"), ("E5", "li")]
    pins = cases.foreign_pin_mentions(F.lit("pa and PB_x and p+ worn"), F.array(F.lit("PA"), F.lit("PB"), F.lit("P+"), F.lit("(")), F.array(F.lit("PC")))
    assert one(spark, pins) == ["PA", "P+"]


@pytest.mark.parametrize(("text_", "error"), [
    ('{"status":"unconfirmed","cause_ids":["C1"],"check_ids":["K2"]}', None), ('{"status":"refuse","cause_ids":[],"check_ids":[]}', None), ('{"status":"unconfirmed","cause_ids":["C1"]', "malformed"),
    ('{"status":"refuse","status":"refuse","cause_ids":[],"check_ids":[]}', "repeated key"), ('{"status":"refuse","cause_ids":[],"check_ids":[],"note":1}', "keys"), ('{"status":"sure","cause_ids":[],"check_ids":[]}', "status"),
    ('{"status":"unconfirmed","cause_ids":"C1","check_ids":["K2"]}', "lists of strings"), ('{"status":"unconfirmed","cause_ids":["C1","C2","C3"],"check_ids":["K2"]}', "too many"),
    ('{"status":"unconfirmed","cause_ids":["C1","C1"],"check_ids":["K2"]}', "repeated id"), ('{"status":"unconfirmed","cause_ids":[],"check_ids":["K2"]}', "answer without items"), ('{"status":"refuse","cause_ids":["C1"],"check_ids":[]}', "refusal with items"),
])
def test_selection_contract(spark, text_, error):
    got = cases.check_selection(spark.createDataFrame([(text_,)], "t string"), "t").first()
    assert got["error"] == error and got["accepted"] is (error is None)


@pytest.mark.parametrize(("causes", "checks", "status", "error"), [
    ('["C1"]', '["K2"]', "unconfirmed", None), ('["K1"]', '["C9"]', "unconfirmed", "unknown id"), ('["K2"]', '["K2"]', "unconfirmed", "wrong kind"), ('["C1"]', '["C1"]', "unconfirmed", "wrong kind"), ("[]", "[]", "refuse", None),
])
def test_selections_are_held_to_their_options(spark, causes, checks, status, error):
    rows = spark.createDataFrame([("q", f'{{"status":"{status}","cause_ids":{causes},"check_ids":{checks}}}'), ("none", '{"status":"unconfirmed","cause_ids":["C1"],"check_ids":["K2"]}')], "query_id string, t string")
    options = spark.createDataFrame([("q", "C1", "cause"), ("q", "K2", "check")], "query_id string, alias string, kind string")
    got = {r["query_id"]: r for r in cases.check_selection(rows, "t", options=options).collect()}
    assert got["q"]["error"] == error and got["none"]["error"] == "unknown id"
    forced = {r["query_id"]: r["error"] for r in cases.check_selection(rows, "t", options=options, forced=True).collect()}
    assert forced["q"] == (error or ("refusal where an answer is asked for" if status == "refuse" else None))


def test_verification_decides(spark):
    items = spark.createDataFrame([("q", "cause", True), ("q", "check", True), ("r", "cause", None), ("r", "check", True)], "query_id string, kind string, ok boolean")
    verified = cases.verify_items(items, {"citation": F.col("ok")})
    assert values(cases.decide(verified, ["query_id"]), "query_id", "status") == [("q", "unconfirmed"), ("r", "refuse")]
    cited = spark.createDataFrame([("i", "f", "h", 1, 2, "t"), ("j", "f", "x", 0, 9, "u"), ("k", "g", "h", 1, 1, "t")], "item_id string, file string, sha256 string, first_line int, last_line int, text string")
    source = spark.createDataFrame([("f", "h", 3, ["t"])], "file string, sha256 string, n_lines int, texts array<string>")
    assert {r["entity_key"] for r in cases.citation_violations(cited, source).collect()} == {"j", "k"}


RESULT = "variant string, id string, status string, latency_seconds double, cause_ids array<string>, check_ids array<string>"
GOLD = "id string, expected_status string, acceptable_cause_ids array<string>, acceptable_check_ids array<string>"


def test_scoring_is_null_where_nothing_was_measured(spark):
    rows = [("full", "1", "unconfirmed", 1.0, ["a"], ["k"]), ("full", "2", "unconfirmed", 3.0, ["x", "a"], ["k"]), ("full", "3", "refuse", 10.0, [], []), ("none", "3", "refuse", 2.0, [], [])]
    gold = [("1", "unconfirmed", ["a"], ["k"]), ("2", "unconfirmed", ["a"], ["k"]), ("3", "refuse", [], [])]
    got = {r["variant"]: r for r in scoring.summarise(spark.createDataFrame(rows, RESULT), spark.createDataFrame(gold, GOLD), ["variant"]).collect()}
    f, n = got["full"], got["none"]
    assert (f["latency_median"], f["latency_p95"], f["answered"]) == (3.0, 10.0, 2) and round(f["accuracy"], 6) == round(2 / 3, 6)
    assert f["false_answers_per_answered"] == 0.5 and (f["top1"], f["top2"]) == (0.5, 1.0) and f["no_answer_refusal_rate"] == 1.0 and f["proxy_accuracy"] is None
    assert n["false_answers_per_answered"] is None and n["top1"] is None and n["coverage"] == 0.0
    proxy = scoring.summarise(spark.createDataFrame(rows, RESULT), spark.createDataFrame(gold, GOLD), ["variant"], proxy=True).filter("variant = 'full'").first()
    assert proxy["accuracy"] is None and round(proxy["proxy_accuracy"], 6) == round(2 / 3, 6)


def test_energy_and_throughput(spark):
    s = spark.createDataFrame([("a", 0.0, 4.0), ("a", 2.0, 6.0), ("b", 0.0, 5.0)], "case_id string, t double, watts double")
    lat = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "case_id string, seconds double")
    assert values(scoring.case_energy(s, lat, "case_id", "watts", "seconds"), "case_id", "energy_joules") == [("a", 10.0), ("b", 5.0), ("c", None)]
    assert values(scoring.trapezoid_energy(s, ["case_id"], F.col("t"), "watts"), "case_id", "energy_joules") == [("a", 10.0), ("b", 0.0)]
    rates = spark.createDataFrame([(10, 5.0), (30, 10.0), (7, None)], "n long, r double").agg(scoring.throughput(F.col("n"), F.col("r")).alias("x"), scoring.covered_mean(F.col("r")).alias("m")).first()
    assert rates["x"] == 47 / 5 and rates["m"] is None
    assert one(spark, scoring.cost_per_thousand(F.lit(3600.0), 0.5)) == 0.5


def test_conversation_rules(spark):
    turns = spark.createDataFrame([("r", i, "t") for i in range(12)], "run_id string, turn_no long, text string")
    assert values(chat.last_turns(turns, "run_id", "turn_no", 2), "turn_no") == [(10,), (11,)]
    assert values(chat.turn_cap(turns, "run_id"), "entity_key") == [("r",)]
    sizes = spark.createDataFrame([("p", 1, 3000), ("p", 2, 900), ("p", 3, 10), ("q", 1, 5000)], "id string, pos int, n int")
    assert values(chat.first_fit(sizes, "id", "pos", "n", 2000, 160, 2048, 64), "id", "pos") == [("p", 2)]
    lost = chat.unfit(sizes, chat.first_fit(sizes, "id", "pos", "n", 2000, 160, 2048, 64), "id")
    assert values(lost, "entity_key") == [("q",)]
    replies = [
        "It was found open [E1].", "Hold D005 for analysis.", "This confirms the leakage.", "No source, and none is needed.", "Odd [E9].", "", '{"a":1}', "The engineer should check P-D005 first.", "P-D0051 should wait; D005 was replaced.",
        "The historical result indicates a DUT-related fault. This may indicate leakage.", "```\ncode", "We can see. D005 needs to be cleaned.", None,
    ]
    table = spark.createDataFrame(list(enumerate(replies, 1)), "id long, t string")
    bad = chat.reply_violations(table, "id", "t", F.array(F.lit("E1"), F.lit("E2")), F.array(F.lit("P-D005")))
    got = values(bad.filter("entity_key <> '13'"), "entity_key", "rule_id")
    assert got == sorted([("2", "device"), ("3", "claims"), ("5", "references"), ("6", "empty"), ("7", "prose"), ("8", "device"), ("11", "prose"), ("12", "device")], key=str)
    assert values(bad.filter("entity_key = '13'"), "rule_id")[0] == ("claims",)
    assert one(spark, chat.citation_status(F.lit("x [E1]"))) == "references_checked" and one(spark, chat.citation_status(F.lit("x"))) == "no_explicit_references"
    asked = spark.createDataFrame([(1, "a" * 32, "why?"), (2, "../x", "why?"), (3, "b" * 32, "x" * 701), (4, "c" * 32, None)], "id long, run string, q string")
    assert values(chat.question_violations(asked, "id", "run", "q"), "entity_key", "rule_id") == [("2", "run"), ("3", "question"), ("4", "question")]


def test_suites_resume_compare_and_report(spark):
    items = spark.createDataFrame([("1",), ("2",)], "id string")
    done = spark.createDataFrame([("full", "1"), ("no_refusal", "2")], "variant string, id string")
    assert suite.remaining(items, done, "id").count() == 6 and suite.variants(spark).count() == 4
    a = spark.createDataFrame([("full", "h1", 50)], "variant string, sha string, n int")
    b = spark.createDataFrame([("full", "h2", 50)], "variant string, sha string, n int")
    assert values(suite.comparable(a, b, ["sha", "n"]), "entity_key", "message") == [("full", "sha")]
    table = spark.createDataFrame([("energy", 1.5, None), ("n", 50.0, 2.0)], "metric string, a double, b double")
    assert "| energy | 1.5 | unmeasured |" in suite.as_markdown(table, "metric") and "<rect" in suite.bar_chart_svg(table, "metric", "a")
    many = spark.range(1500).select(F.format_string("m%04d", "id").alias("metric"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert suite.as_markdown(many, "metric").count("\n") == 1502 and suite.bar_chart_svg(many, "metric", "a").count("<rect") == 1500
    assert suite.scatter_svg(table, "metric", "a", "b").count("<circle") == 1


def test_tokens_and_phrases(spark):
    line = phrases.token_line(F.lit("Then: you\n SHOULD hold-off (now)!"))
    assert one(spark, line) == " then : you should hold - off ( now ) ! "
    assert one(spark, phrases.holds(line, ["we must", "you should"])) and not one(spark, phrases.holds(line, ["then you", "hold off"]))
    assert one(spark, phrases.leads_to(line, ["should hold"], ["- of"])) and not one(spark, phrases.leads_to(line, ["should hold"], ["off"]))
    assert [one(spark, phrases.plain_number(F.lit(x))) for x in (" 12.50 ", "7", "1e3", ".5", "5.", "-1", "", "1.2.3", "NaN")] == [12.5, 7.0] + [None] * 7
    assert one(spark, phrases.labelled(F.lit("Limit: 1; limits :2, limits 3"), ("limits", "limit"))) == [" 1; ", "2, "]


def test_sentences_that_tell_to_act_or_claim(spark):
    d = F.lit("P-L01-D005")
    acts = ["You should retest D005.", "- 2) Hold P-L01-D005 now", "3. inspect d005 and D005", "The next step is D005", "D005 needs to rest", "the engineer need to see P-L01-D005"]
    idle = ["You should retest it.", "D0051: you should hold", "D005 was held; they checked", "Holding D005 helped", "D005 may be one", "Recommended for D005"]
    assert [one(spark, chat.instructs(F.lit(s), d)) for s in acts + idle] == [True] * len(acts) + [False] * len(idle)
    claims = ["This clearly confirms a DUT-related fault", "the measured current  indicates leakages", "So the result proves the internal short.", "This establishes device related harm"]
    fair = ["This may indicate leakage", "In a historical run this confirms leakage", "this does not prove leakage", "This confirms the plan", "A simulated case: the failure proves leakage", "this, confirms leakage"]
    assert [one(spark, chat.overclaims(F.lit(s))) for s in claims + fair] == [True] * len(claims) + [False] * len(fair)


def test_failed_tests_of_a_log(spark):
    logs = {
        "100 Continuity pass; 210 IDD_Static FAIL": [210], "Scan (606) FAILED\n100 Open/Short- ok": [606], "210 IDD_Static ok 606 Scan failed": [606], "210 IDD_Static; FAIL": [], "210 IDD_Static\nFAIL": [],
        "606 Scan chain Scan (F)": [606], "606 Scan Failing Pins: 3\n606 Scan Failing Pins: 0": [606], "1606x Scan FAIL": [], "606 scan failure": [], "99 Scan fail, 100 Continuity fail": [99, 100], "606 Scan (210) fail": [606], "Scan FAIL": [], "": [],
    }
    assert {t: one(spark, forms.failed_tests(F.lit(t))) for t in logs} == logs
