"""Queries over evidence made from the driver tables: directions, forms, selections, investigations, audits, contracts, baselines.

Texts and records are composed by a row's number, so that every rule is met and broken by many rows; the SQL states what
each of them must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions.forms import incidents
from provena.functions.text import cause_direction, read_direction
from provena.operators import audit, baselines, cases, evaluation
from provena.operators.cases import check_selection
from provena.operators.chat import reply_violations
from provena.operators.retrieval import result_violations
from provena.operators.scoring import summarise
from provena.plans.investigate import investigate
from provena.sources.collection import Collection
from provena.sources.stored import new_path
from provena.sources.tables import table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its name with its DuckDB SQL."""

    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def by_number(n: Column, values: list) -> Column:
    """The value at the place n; later places repeat the last one."""
    kinds = [v if isinstance(v, Column) else F.lit(v) for v in values]
    out = kinds[-1]
    for i in range(len(kinds) - 2, -1, -1):
        out = F.when(n == i, kinds[i]).otherwise(out)
    return out


@query("""
WITH e AS (
  SELECT event_id, event_id % 8 AS kind, (event_id * 37) % 9000 / 100.0 AS v,
         CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'low' END AS cause_direction FROM events
), d AS (
  SELECT *, CASE WHEN v > 55 THEN 'high' WHEN v < 35 THEN 'low' END AS side FROM e
), r AS (
  SELECT event_id, cause_direction, CASE WHEN kind = 6 THEN 'limits' WHEN kind = 2 AND side = 'high' THEN 'conflict' END AS error,
         CASE WHEN kind IN (0, 1) OR kind = 2 AND side = 'low' THEN side WHEN kind = 3 THEN 'high' END AS direction FROM d
)
SELECT event_id, direction, error, cause_direction, coalesce(direction = cause_direction, false) AS applicable FROM r
""")
def current_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of measured currents from tester lines, labelled values and words, with contradictions, against the causes' sides."""
    c = (F.col("event_id") * 37) % 9000
    v = F.format_string("%d.%02d", F.floor(c / 100), c % 100)
    told = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = by_number(F.col("event_id") % 8, [
        told("210 IDD_Static         curr         35.00 ma < ", F.lpad(v, 8, " "), " ma (F) <  55.00 ma"), told("Measured static current: ", v, " mA\nAllowed range: 35.00–55.00 mA"),
        told("Measured current: ", v, " mA. Limits: 35.00-55.00 mA; it lies below the lower limit"), "The current exceeds the upper limit", "under the minimum and above the maximum", "Nothing was measured",
        told("Measured current: ", v, " mA, limits: 55.00-35.00 mA"), "high and low are words",
    ])
    kinds = {"error": "excessive static current path", "signup": "a low supply", "view": "high or low supply"}
    cause = F.coalesce(*(F.when(F.col("event_type") == k, t) for k, t in kinds.items()), F.lit("worn contact"))
    e = table(spark, sf_dir, "events").select("event_id", read_direction(text).alias("r"), cause_direction(cause).alias("cause_direction"))
    agree = F.coalesce(F.col("r.direction") == F.col("cause_direction"), F.lit(False))
    return e.select("event_id", "r.direction", "r.error", "cause_direction", agree.alias("applicable"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS n FROM orders)
SELECT o_orderkey, CASE n WHEN 2 THEN 'log-dut_id' WHEN 3 THEN 'log-tester' WHEN 4 THEN 'log-failed_test' WHEN 5 THEN 'log-test' WHEN 6 THEN 'failed_test-conflict'
                          WHEN 7 THEN 'tester-conflict' WHEN 8 THEN 'product' WHEN 9 THEN 'question' WHEN 10 THEN 'pins' END AS error,
       CASE WHEN n IN (0, 7, 8, 9, 10) THEN 100 WHEN n IN (1, 6) THEN 210 WHEN n = 11 THEN 606 END AS test_number,
       CASE WHEN n = 1 THEN 'X-1' WHEN n IN (2, 3, 4, 5) THEN NULL ELSE 'query-' || substr(sha256(o_orderkey::VARCHAR), 1, 32) END AS dut_id,
       n = 11 AS without_log, CASE n WHEN 1 THEN 't1|p1' WHEN 7 THEN 'x|' ELSE '|' END AS named,
       CASE WHEN n = 0 THEN 'DUT unspecified; Product_A; tester unknown; program unknown; failed test 100 Continuity / Open–Short; pins PA, PB. 100 Open/Short- Failing Pins: 2 (F)' END AS told FROM o
""")
def incident_form_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with logs as incidents: hints, ambiguity, conflicts and limits."""
    n = F.col("o_orderkey") % 12
    text = by_number(n, [
        "100 Open/Short- Failing Pins: 2 (F)", "DUT: X-1\nTester: t1\nProgram: p1\n210 IDD_Static FAIL\n606 Scan passed", "Product_A-L01-W01-D001 and Product_A-L01-W01-D002", "Tester: a\nTester: b",
        "100 Continuity FAIL; 606 Scan FAILED", "999 Scan FAIL", "606 Scan: FAIL", "Tester: y", "100 Continuity FAIL", "100 Continuity FAIL", "100 Continuity FAIL", "",
    ])
    test = by_number(n, ["", "", "100", "100", "", "", "210", "100", "", "", "", "606"])
    forms = table(spark, sf_dir, "orders").select(
        "o_orderkey", text.alias("observation"), F.when(n == 8, "Product_B").otherwise("Product_A").alias("product"), test.alias("failed_test"), F.lit("").alias("dut_id"),
        F.when(n == 7, "x").otherwise("").alias("tester"), F.lit(None).cast("string").alias("program"), F.when(n == 10, "A B").otherwise("PA, PB").alias("pins"),
        F.when(n == 9, "  ").otherwise("why?").alias("question"), F.lit(True).alias("synthetic"),
    )
    i = incidents(forms, "o_orderkey").withColumn("n", n)
    unclear = F.col("n").isin(2, 3, 4, 5)
    return i.select(
        "o_orderkey", "error", F.when(~unclear, F.col("test_number")).alias("test_number"), F.when(~unclear, F.col("dut_id")).alias("dut_id"), (F.col("input_notice") != "").alias("without_log"),
        F.when(unclear, "|").otherwise(F.concat_ws("|", "tester", "program")).alias("named"), F.when(F.col("n") == 0, F.col("retrieval_text")).alias("told"),
    )


@query("""
SELECT conv_id || '/' || turn AS entity_key, CASE (conv_id * 7 + turn) % 8 WHEN 1 THEN 'references' WHEN 2 THEN 'prose' WHEN 3 THEN 'empty' WHEN 4 THEN 'device' WHEN 5 THEN 'claims' WHEN 7 THEN 'device' END AS rule_id
FROM conversations WHERE (conv_id * 7 + turn) % 8 NOT IN (0, 6)
""")
def reply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are empty, structured, cite unknown facts, aim at a historical device or claim a cause."""
    text = by_number((F.col("conv_id") * 7 + F.col("turn")) % 8, [
        "Compare a reference. [E1, note E2]", "See [E1] and [E9].", '{"scope": 1}', "  ", "The engineer should hold D100 for analysis.", "This clearly indicates a DUT-related condition.",
        "In the historical record this indicates a DUT-related condition. D100 was replaced, D1000 should wait.", "Measure the current device.\nProduct_A-L01-W01-D100 must be seen again.",
    ])
    replies = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), text.alias("t"))
    known, devices = F.array(F.lit("E1"), F.lit("E2")), F.array(F.lit("Product_A-L01-W01-D100"))
    return reply_violations(replies, "key", "t", known, devices).select("entity_key", "rule_id")


_ERRORS = ["malformed", "repeated key", "keys", "status", "lists of strings", "too many", "repeated id", "unknown id", "wrong kind", "refusal with items", "answer without items"]


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 13 {' '.join(f"WHEN {i + 2} THEN '{e}'" for i, e in enumerate(_ERRORS))} END AS error, o_orderkey % 13 < 2 AS accepted FROM orders
""")
def selection_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections held to their contract and to the options that they may pick from."""
    doc = lambda status, causes, checks: f'{{"status":"{status}","cause_ids":{causes},"check_ids":{checks}}}'
    texts = [
        doc("unconfirmed", '["C1","C2"]', '["K3"]'), doc("refuse", "[]", "[]"), '{"status":"refuse","cause_ids":[', '{"status":"refuse","status":"refuse","cause_ids":[],"check_ids":[]}',
        '{"status":"refuse","cause_ids":[],"check_ids":[],"note":"x"}', doc("sure", "[]", "[]"), doc("unconfirmed", '"C1"', '["K3"]'), doc("unconfirmed", '["C1","C2","C9"]', '["K3"]'),
        doc("unconfirmed", '["C1","C1"]', '["K3"]'), doc("unconfirmed", '["C9"]', '["K3"]'), doc("unconfirmed", '["K3"]', '["K3"]'), doc("refuse", '["C1"]', "[]"), doc("unconfirmed", "[]", '["K3"]'),
    ]
    o = table(spark, sf_dir, "orders").select("o_orderkey", by_number(F.col("o_orderkey") % 13, texts).alias("t"))
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(k).alias("kind")) for a, k in (("C1", "cause"), ("C2", "cause"), ("K3", "check"))))
    options = o.select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.alias", "p.kind")
    return check_selection(o, "t", options=options, key="o_orderkey").select("o_orderkey", "error", "accepted")


_INVESTIGATED = """
h AS (
  SELECT vec_id, 'c' || vec_id AS cid, lang, label % 3 AS t, embedding, ['PA is worn', CASE WHEN vec_id % 2 = 0 THEN 'high path' ELSE 'low supply' END] AS causes, ['probe D' || vec_id || ' again', 'look'] AS checks
  FROM embeddings JOIN documents ON doc_id = vec_id
), q AS (
  SELECT *, CASE vec_id // 20 % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS side, vec_id % 40 = 0 AS has_pa FROM h WHERE vec_id % 20 = 0
), near AS (
  SELECT q.vec_id AS q, q.t, q.side, q.has_pa, h.*, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, h.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), h.cid) AS vr
  FROM q JOIN h ON h.lang = q.lang AND h.t = q.t AND h.vec_id % 20 <> 0 QUALIFY vr <= 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY cid) AS kr FROM near
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY 1.0::DOUBLE / (60 + vr) + 2.0::DOUBLE / (60 + kr) DESC, vr) AS r, t <> 1 OR coalesce(side = CASE WHEN vec_id % 2 = 0 THEN 'high' ELSE 'low' END, false) AS fits FROM ranked
), items AS (
  SELECT q, r, 0 AS k, i, cid || '-C' || i AS id, causes[i] AS text FROM placed, range(1, 3) g(i) WHERE fits AND (i = 2 OR has_pa)
  UNION ALL SELECT q, r, 1, i, cid || '-K' || i, CASE WHEN i = 1 THEN 'probe the current DUT (Q-' || q || ') again' ELSE 'look' END FROM placed, range(1, 3) g(i) WHERE fits
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY r, i) AS n FROM items QUALIFY n <= 2
), told AS (
  SELECT q, string_agg(id, ',' ORDER BY n) FILTER (k = 0) AS causes, string_agg(id, ',' ORDER BY n) FILTER (k = 1) AS checks, min(text) FILTER (k = 1 AND n = 1) AS first_check FROM picked GROUP BY q
)"""


@query(f"""
WITH {_INVESTIGATED}
SELECT 'q' || vec_id AS query_id, CASE WHEN t.causes IS NULL OR t.checks IS NULL THEN 'refuse' ELSE 'unconfirmed' END AS status, coalesce(t.causes, '') AS cause_ids, coalesce(t.checks, '') AS check_ids,
       first_check, (t.causes IS NOT NULL)::INTEGER AS generation_attempts FROM q LEFT JOIN told t ON t.q = q.vec_id
""")
def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents against case histories: retrieval, eligibility, options, selection by rule, verification, told answers."""
    out = investigate(*_incidents_and_cases(spark, sf_dir)).answers
    return out.select("query_id", "status", F.array_join("cause_ids", ",").alias("cause_ids"), F.array_join("check_ids", ",").alias("check_ids"), F.get("checks", 0)["display_text"].alias("first_check"), "generation_attempts")


def _incidents_and_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    rows = e.join(d, e["vec_id"] == d["doc_id"]).withColumn("test", by_number(F.col("label") % 3, [100, 210, 606]))
    n = F.col("vec_id")
    side = by_number(F.floor(n / 20) % 3, ["210 IDD_Static curr 35.00 ma < 60.00 ma (F) < 55.00 ma", "210 IDD_Static curr 35.00 ma < 30.00 ma (F) < 55.00 ma", "not measured"])
    pins = F.when(n % 40 == 0, F.array(F.lit("PA"), F.lit("PB"))).otherwise(F.array(F.lit("PB")))
    asked = rows.filter(n % 20 == 0).select(
        F.concat(F.lit("q"), n.cast("string")).alias("query_id"), F.concat(F.lit("Q-"), n.cast("string")).alias("dut_id"), F.col("lang").alias("product"), F.col("test").alias("test_number"),
        pins.alias("pins"), side.alias("observation"), F.lit("").alias("question"), F.col("embedding").alias("vector"),
    )
    causes = F.array(F.lit("PA is worn"), F.when(n % 2 == 0, "high path").otherwise("low supply"))
    held = rows.filter(n % 20 != 0).select(
        F.concat(F.lit("c"), n.cast("string")).alias("case_id"), F.concat(F.lit("H-D"), n.cast("string")).alias("dut_id"), F.col("lang").alias("product"), F.col("test").alias("failed_test"),
        F.array(F.lit("PA"), F.lit("PB")).alias("pins"), F.array_join(causes, " ").alias("cause_text"), causes.alias("possible_causes"),
        F.array(F.concat(F.lit("probe D"), n.cast("string"), F.lit(" again")), F.lit("look")).alias("checks"), F.lit("").alias("text"), F.col("embedding").alias("vector"),
    )
    return asked, held


@query(f"""
WITH {_INVESTIGATED}, a AS (SELECT v.variant, q.vec_id FROM q, (VALUES ('full'), ('no_keyword'), ('no_verifier'), ('no_refusal')) v(variant)),
n AS (SELECT q, count(*) AS retrieved, count(*) FILTER (fits) AS fitting FROM placed GROUP BY q)
SELECT variant, count(*) AS n, coalesce(sum(retrieved), 0)::BIGINT AS retrieved, coalesce(sum(CASE WHEN variant IN ('full', 'no_keyword') THEN fitting ELSE retrieved END), 0)::BIGINT AS eligible FROM a LEFT JOIN n ON n.q = a.vec_id GROUP BY variant
""")
def ablation_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variant of an ablation retrieves and lets answer."""
    asked, held = _incidents_and_cases(spark, sf_dir)
    parts = []
    for variant in ("full", "no_keyword", "no_verifier", "no_refusal"):
        out = investigate(asked, held, variant=variant)
        rows = out.answers.select("query_id").join(out.eligibility, "query_id", "left")
        parts.append(rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("retrieved_cases")), F.lit(0)).alias("retrieved"), F.coalesce(F.sum(F.size("eligible_cases")), F.lit(0)).alias("eligible")).withColumn("variant", F.lit(variant)))
    from provena.operators.constraints import union_all

    return union_all(parts)


@query("""
WITH r AS (
  SELECT lang, n_chars, n_chars >= 400 AS ans, quality = 1 AS want, doc_id % 3 AS a, 3 - doc_id % 4 AS b FROM documents JOIN labels USING (doc_id)
), g AS (SELECT *, (NOT ans AND NOT want) OR (ans AND want AND a < 2 AND b < 2 AND a <> b OR ans AND want AND a = b AND a < 2) AS good FROM r)
SELECT lang, count(*) AS n, quantile_cont(n_chars / 100.0::DOUBLE, 0.5) AS latency_median, quantile_disc(n_chars / 100.0::DOUBLE, 0.95) AS latency_p95, count(*) FILTER (ans) AS answered, count(*) FILTER (NOT ans) AS refused,
       round(avg(good::INTEGER), 6) AS accuracy, round(count(*) FILTER (ans AND NOT good)::DOUBLE / nullif(count(*) FILTER (ans), 0), 6) AS false_answers_per_answered,
       round(avg((a < 2)::INTEGER) FILTER (ans), 6) AS top1, round(avg((a < 2 OR b < 2)::INTEGER) FILTER (ans), 6) AS top2, round(avg(1) FILTER (ans), 6) AS top3,
       round(count(*) FILTER (NOT ans AND NOT want)::DOUBLE / nullif(count(*) FILTER (NOT want), 0), 6) AS no_answer_refusal_rate, round(avg(ans::INTEGER), 6) AS coverage FROM g GROUP BY lang
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs scored against gold labels: latency, rates, hits at one, two and three."""
    d, g = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    ids = F.array_distinct(F.array(name(F.col("doc_id") % 3), name(3 - F.col("doc_id") % 4)))
    results = d.select(
        "lang", F.col("doc_id").alias("id"), F.when(F.col("n_chars") >= 400, "unconfirmed").otherwise("refuse").alias("status"), (F.col("n_chars") / F.lit(100.0)).alias("latency_seconds"),
        ids.alias("cause_ids"), F.array(F.lit("k")).alias("check_ids"),
    )
    gold = g.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "unconfirmed").otherwise("refuse").alias("expected_status"), F.array(F.lit("c0"), F.lit("c1")).alias("acceptable_cause_ids"), F.array(F.lit("k")).alias("acceptable_check_ids"))
    s = summarise(results.withColumn("cause_ids", F.concat("cause_ids", F.array(F.lit("c0")))).withColumn("_all", F.lit(0)), gold, ["lang"])
    plain = summarise(results, gold, ["lang"])
    rounded = lambda c: F.round(c, 6).alias(c)
    return plain.join(s.select("lang", F.col("top3").alias("_top3")), "lang").select(
        "lang", "n", "latency_median", "latency_p95", "answered", "refused", rounded("accuracy"), rounded("false_answers_per_answered"), rounded("top1"), rounded("top2"), F.round("_top3", 6).alias("top3"),
        rounded("no_answer_refusal_rate"), rounded("coverage"),
    )


_SET_RULES = ["query_only", "question", "path", "lines", "excerpt", "unanswerable", "review"]


@query(f"""
SELECT rule_id, doc_id::VARCHAR AS entity_key FROM (SELECT doc_id, CASE doc_id % 20 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_SET_RULES))} END AS rule_id FROM documents) WHERE rule_id IS NOT NULL
UNION ALL SELECT 'dut_id', 'd7' FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 20 = 7) WHERE n > 1
""")
def evaluation_set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions of an evaluation set, each rule broken by one row in twenty."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 20
    sha = F.sha2("text", 256)
    items = d.select(
        F.col("doc_id").alias("id"), F.when(n == 7, "d7").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("x"))).alias("dut_id"), F.lit("query_only").alias("role"), (n == 0).alias("index_as_history"),
        F.when(n == 1, " ").otherwise("why?").alias("question"), F.lit("FAIL").alias("result"), F.when((n == 5) | (n == 9), "no_answer").otherwise("scan").alias("category"),
        F.when(n == 9, "refuse").alias("expected_status"), F.when(n == 6, "done").otherwise("approved").alias("review_status"), F.when(n == 2, "a/../../b").otherwise("logs/a.txt").alias("source"),
        F.lit(1).alias("first_line"), F.when(n == 3, 4).otherwise(3).alias("last_line"), F.when(n == 4, "0").otherwise(sha).alias("excerpt_sha256"),
    )
    now = d.select(F.col("doc_id").alias("id"), sha.alias("excerpt_sha256"), F.lit(3).alias("n_lines"))
    return evaluation.set_violations(items, now).select("rule_id", "entity_key")


@query("""
SELECT rule_id, doc_id::VARCHAR AS entity_key FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'review' WHEN 1 THEN 'status' WHEN 2 THEN 'fits' WHEN 3 THEN 'texts' WHEN 4 THEN 'fits' WHEN 5 THEN 'covered' END AS rule_id FROM labels) WHERE rule_id IS NOT NULL
""")
def gold_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold entries, each rule broken by one row in eleven."""
    g, n = table(spark, sf_dir, "labels"), F.col("doc_id") % 11
    some = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    refuse = n.isin(4, 6)
    gold = g.filter(n != 5).select(
        F.col("doc_id").alias("id"), F.when(n == 1, "sure").when(refuse, "refuse").otherwise("unconfirmed").alias("expected_status"),
        F.when((n == 2) | (n == 6), some()).when(n == 3, some("a", "")).otherwise(some("a")).alias("acceptable_cause_ids"), F.when(n == 6, some()).otherwise(some("k")).alias("acceptable_check_ids"),
        F.lit("approved").alias("review_status"), F.when(n == 0, "").otherwise("ann").alias("reviewer"), F.lit("").alias("labeler"),
    )
    return evaluation.gold_violations(gold, g.select(F.col("doc_id").alias("id"))).select("rule_id", "entity_key")


@query("""
WITH i AS (SELECT p_partkey, p_size % 3 AS t, p_partkey % 5 = 0 AS none, p_partkey % 2 = 0 AS has_a, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS side FROM part),
c AS (SELECT p_partkey, none, list_sort(list_filter([CASE WHEN t = 0 AND has_a THEN 'c-a' END, CASE WHEN t = 0 THEN 'c-all' END, CASE WHEN t = 1 AND side = 'high' THEN 'c-high' END], lambda x: x IS NOT NULL)) AS causes,
             CASE WHEN t < 2 THEN ['k'] ELSE []::VARCHAR[] END AS checks FROM i)
SELECT p_partkey, CASE WHEN none OR len(causes) = 0 OR len(checks) = 0 THEN 'refuse' ELSE 'unconfirmed' END AS expected_status,
       CASE WHEN none OR len(causes) = 0 OR len(checks) = 0 THEN '' ELSE array_to_string(causes, ',') END AS causes FROM c
""")
def labels_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from rules on test, pins and direction; what no rule answers is refused."""
    n = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(
        n.alias("id"), F.when(n % 5 == 0, "no_answer").otherwise("x").alias("category"), by_number(F.col("p_size") % 3, [100, 210, 606]).alias("test_number"),
        F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("pins"), F.when(n % 3 == 0, "high").when(n % 3 == 1, "low").alias("direction"),
    )
    made = [(100, None, ["A"], "cause", "c-a"), (100, None, [], "cause", "c-all"), (100, None, [], "check", "k"), (210, "high", [], "cause", "c-high"), (210, None, [], "check", "k")]
    rules = spark.createDataFrame(made, "test_number int, direction string, needs array<string>, kind string, item_id string")
    return evaluation.rule_labels(items, rules).select(F.col("id").alias("p_partkey"), "expected_status", F.array_join("acceptable_cause_ids", ",").alias("causes"))


@query("""
WITH r AS (SELECT p_partkey, p_size % 3 AS t, row_number() OVER (PARTITION BY p_size % 3 ORDER BY sha256('frozen-1|' || p_partkey), p_partkey) AS rank FROM part)
SELECT p_partkey, rank::INTEGER AS rank, CASE WHEN t = 0 THEN 'continuity' WHEN t = 2 THEN 'scan' WHEN rank <= 14 THEN 'idd_static' ELSE 'no_answer' END AS category FROM r
WHERE t = 0 AND rank <= 12 OR t = 2 AND rank <= 14 OR t = 1 AND rank <= 24
""")
def frozen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in bands of their salted hash order: the frozen questions of an evaluation."""
    p = table(spark, sf_dir, "part").select("p_partkey", by_number(F.col("p_size") % 3, [100, 210, 606]).alias("failed_test"))
    bands = {"continuity": (100, 1, 12), "idd_static": (210, 1, 14), "no_answer": (210, 15, 24), "scan": (606, 1, 14)}
    return evaluation.frozen_sample(p, bands, "frozen-1", key="p_partkey").select("p_partkey", "rank", "category")


_RESPONSE_RULES = ["one", "finished", "text", "messages", "tokens", "budget", "device"]


@query(f"""
SELECT event_id::VARCHAR AS entity_key, rule_id FROM (
  SELECT event_id, CASE event_id % 9 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RESPONSE_RULES))} END AS rule_id FROM events
  UNION ALL SELECT event_id, unnest(['finished', 'text']) FROM events WHERE event_id % 9 = 0
) WHERE rule_id IS NOT NULL
""")
def response_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime responses that are cut, changed, recounted, clamped or made elsewhere; a response without a choice has no text either."""
    n = F.col("event_id") % 9
    lit = F.lit
    choice = F.struct(F.when(n == 1, "length").otherwise("stop").alias("finish_reason"), F.struct(F.when(n == 2, " ").otherwise("ok").alias("content")).alias("message"))
    context = F.struct(
        lit(1).alias("original_messages"), lit(1).alias("effective_messages"), F.when(n == 3, 1).otherwise(0).alias("dropped_messages"), lit(False).alias("history_truncated"), lit(False).alias("system_dropped"),
        lit(100).cast("long").alias("original_prompt_tokens"), lit(102).cast("long").alias("effective_prompt_tokens"),
    )
    metrics = F.struct(
        lit(160).cast("long").alias("requested_max_tokens"), lit(160).cast("long").alias("effective_max_tokens"), (n == 5).alias("max_tokens_clamped_to_context"), lit(6.5).alias("decode_tokens_per_second"), context.alias("context"),
        F.struct(lit(True).alias("fallback_disabled"), lit(True).alias("prefill_on_device"), F.array(lit("npu_a"), F.when(n == 6, "cpu").otherwise("npu_b")).alias("stages")).alias("backend"),
    )
    usage = F.struct(F.when(n == 4, 99).otherwise(102).cast("long").alias("prompt_tokens"), lit(20).cast("long").alias("completion_tokens"))
    response = F.struct(F.when(n == 0, F.array().cast("array<struct<finish_reason:string,message:struct<content:string>>>")).otherwise(F.array(choice)).alias("choices"), usage.alias("usage"), metrics.alias("metrics"))
    rows = table(spark, sf_dir, "events").select("event_id", response.alias("response"), lit(100).alias("expected_input"), lit(160).alias("output_tokens"))
    return audit.response_violations(rows, 2048, key="event_id").select("entity_key", "rule_id")


@query("""
SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (l_discount > 0), 0) AS decode_tokens, round(coalesce(sum(l_quantity / l_discount) FILTER (l_discount > 0), 0), 4) AS decode_seconds, count(*) FILTER (l_discount > 0) AS decode_samples
FROM lineitem GROUP BY l_orderkey
""")
def decode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and seconds over the attempts of each run; attempts without a rate do not count."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("n_tokens"), F.col("l_discount").alias("tokens_per_second"))
    return audit.decode_rates(li, ["l_orderkey"]).withColumn("decode_seconds", F.round("decode_seconds", 4))


@query("""
SELECT o_orderkey::VARCHAR AS entity_key, rule_id FROM (
  SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'run' WHEN 1 THEN 'status' WHEN 2 THEN 'ids' WHEN 3 THEN 'empty' WHEN 4 THEN 'answer' END AS rule_id FROM orders
  UNION ALL SELECT o_orderkey, unnest(['status', 'ids']) FROM orders WHERE o_orderkey % 10 = 4
) WHERE rule_id IS NOT NULL
""")
def run_audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows against the saved answers of their runs."""
    n = F.col("o_orderkey") % 10
    run = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    run = F.when(n == 0, F.concat(run, F.lit("x"))).otherwise(run)
    o = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), run.alias("run_id"))
    status = F.when((F.col("n") == 3) | (F.col("n") == 5), "refuse").otherwise("unconfirmed")
    ids = F.when(F.col("n") == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("c2"), F.lit("c1")))
    rows = o.select(F.col("o_orderkey").alias("id"), "run_id", status.alias("status"), ids.alias("cause_ids"), ids.alias("check_ids"))
    saved = o.filter("n <> 4").select("run_id", F.when(F.col("n") == 1, "rejected").otherwise(status).alias("status"), F.when(F.col("n") == 2, F.array_sort(ids)).otherwise(ids).alias("cause_ids"), ids.alias("check_ids"))
    return audit.run_violations(rows, saved).select("entity_key", "rule_id")


@query("""
SELECT 'r' || o_custkey AS run_id, count(*) AS citation_count, count(*) FILTER (o_orderkey % 3 <> 0) AS valid_citation_count,
       coalesce(string_agg('i' || o_orderkey, ',' ORDER BY 'i' || o_orderkey) FILTER (o_orderkey % 4 = 0), '') AS unsupported FROM orders GROUP BY o_custkey
""")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each run, valid ones, and what verification does not support."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", name("r", "o_custkey").alias("run_id"), name("i", "o_orderkey").alias("item_id"))
    broken = o.filter("o_orderkey % 3 = 0").select(F.concat_ws("/", "run_id", "item_id").alias("entity_key"))
    rejected = o.filter("o_orderkey % 4 = 0").select("run_id", "item_id")
    return audit.citation_audit(o.select("run_id", "item_id"), broken, rejected).select("run_id", "citation_count", "valid_citation_count", F.array_join("unsupported_ids", ",").alias("unsupported"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 6 AS n, len(string_split(text, chr(10))) AS lines FROM documents)
SELECT rule_id, doc_id::VARCHAR AS entity_key FROM (
  SELECT doc_id, CASE n WHEN 0 THEN 'file' WHEN 1 THEN 'hash' WHEN 2 THEN 'lines' WHEN 3 THEN 'text' END AS rule_id FROM d
  UNION ALL SELECT doc_id, unnest(['hash', 'lines', 'text']) FROM d WHERE n = 0
) WHERE rule_id IS NOT NULL
""")
def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of documents by hash, lines and text, each broken by some rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("all", F.split("text", "\n"))
    n, name = F.col("doc_id") % 6, F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    cited = d.select(
        F.col("doc_id").alias("item_id"), F.when(n == 0, "gone").otherwise(name).alias("file"), F.when(n == 1, "0").otherwise(F.sha2("text", 256)).alias("sha256"), F.lit(1).alias("first_line"),
        F.when(n == 2, F.size("all") + 1).otherwise(F.size("all")).alias("last_line"), F.when(n == 3, F.concat("text", F.lit("\n"))).otherwise(F.get("all", 0)).alias("text"),
    )
    sources = d.select(name.alias("file"), F.sha2("text", 256).alias("sha256"), F.size("all").alias("n_lines"), F.col("all").alias("texts"))
    return cases.citation_violations(cited, sources).select("rule_id", "entity_key")


@query("""
WITH c AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS stages, count(DISTINCT l_suppkey % 2) AS duts, bool_and(l_quantity < 48) AS synthetic FROM lineitem GROUP BY 1)
SELECT k::VARCHAR AS entity_key, rule_id FROM (
  SELECT k, 'stages' AS rule_id FROM c WHERE NOT (n = 4 AND stages = 4) UNION ALL SELECT k, 'device' FROM c WHERE duts <> 1 UNION ALL SELECT k, 'synthetic' FROM c WHERE NOT synthetic
  UNION ALL SELECT k, 'record' FROM c WHERE n <> stages
)
""")
def case_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage records of cases that disagree on their device, lack a stage or have others, or are not told as synthetic."""
    stage = F.when(F.col("l_linenumber") <= 4, by_number(F.col("l_linenumber"), [F.lit(None).cast("string"), *cases.STAGES])).otherwise(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    li = table(spark, sf_dir, "lineitem")
    records = li.select(
        F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), (F.col("l_suppkey") % 2).cast("string").alias("dut_id"), F.lit("o").alias("observation_id"),
        stage.alias("stage"), F.lit("historical").alias("role"), (F.col("l_quantity") < 48).alias("synthetic"), F.lit(False).alias("physical_test_performed"),
    )
    return cases.link_violations(records).select("entity_key", "rule_id")


@query("""
WITH m AS (SELECT o_custkey AS query_id, o_orderkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 2),
i AS (SELECT m.*, l_linenumber AS stage_no, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS citation_id FROM m JOIN lineitem ON l_orderkey = case_id WHERE l_linenumber <= 4),
v AS (SELECT query_id, case_id, count(stage_no) AS n, count(DISTINCT stage_no) AS kinds FROM m LEFT JOIN i USING (query_id, case_id) GROUP BY ALL)
SELECT i.query_id, i.rank::INTEGER AS rank, i.case_id, ((i.rank - 1) * 4 + stage_no)::INTEGER AS position, ['observation', 'investigation', 'action', 'retest'][stage_no] AS stage, citation_id, NOT (n = 4 AND kinds = 4) AS broken
FROM i JOIN v USING (query_id, case_id)
""")
def ranked_stage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of each customer as matches, expanded to their stage items in order, with matches that lack a stage told."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    matches = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("case_id"), best.alias("rank")).filter("rank <= 2")
    stage = F.when(F.col("l_linenumber") <= 4, by_number(F.col("l_linenumber"), [F.lit(None).cast("string"), *cases.STAGES])).otherwise("other")
    records = li.select(F.col("l_orderkey").alias("case_id"), stage.alias("stage"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("record_id"))
    items = cases.stage_items(matches, records)
    broken = cases.stage_item_violations(matches, items).select(F.col("entity_key").alias("key"), F.lit(True).alias("_broken")).distinct()
    out = items.withColumn("key", F.concat_ws("/", "query_id", "case_id")).join(broken, "key", "left")
    return out.select("query_id", "rank", "case_id", "position", "stage", "citation_id", F.coalesce("_broken", F.lit(False)).alias("broken"))


@query("""
WITH r AS (SELECT l_orderkey AS q, l_partkey % 400 AS h, l_linenumber AS rank, CASE WHEN l_discount > 0.09 THEN NULL WHEN l_tax > 0.07 THEN -l_extendedprice ELSE round(l_extendedprice / 40000) * l_linenumber END AS d, l_quantity FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber % 2 = 1),
w AS (SELECT *, lag(d) OVER (PARTITION BY q ORDER BY rank, d NULLS FIRST, h) AS p, row_number() OVER (PARTITION BY q ORDER BY rank, d NULLS FIRST, h) AS i, max((l_quantity > 2)::INTEGER) OVER (PARTITION BY q, h) AS known FROM r),
g AS (SELECT q, count(*) AS n, count(DISTINCT h) AS hs, bool_and(known = 1) AS known, bool_and(coalesce(d >= 0, false)) AS finite, bool_and(coalesce(d >= p, true)) AS rising, bool_and(rank = i) AS ranks FROM w GROUP BY q)
SELECT q::VARCHAR AS entity_key, unnest(list_filter([CASE WHEN n > 4 THEN 'C17-most' END, CASE WHEN hs <> n THEN 'C17-distinct' END, CASE WHEN NOT known THEN 'C17-eligible' END, CASE WHEN NOT finite THEN 'C17-finite' END,
       CASE WHEN NOT rising THEN 'C17-rising' END, CASE WHEN NOT ranks THEN 'C17-ranks' END], lambda x: x IS NOT NULL)) AS rule_id FROM g
""")
def search_result_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as results of searches, held to what results of four nearest must be."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R' or l_linenumber % 2 = 1")
    distance = F.when(F.col("l_discount") > 0.09, F.lit(None)).when(F.col("l_tax") > 0.07, -F.col("l_extendedprice")).otherwise(F.round(F.col("l_extendedprice") / 40000) * F.col("l_linenumber"))
    results = li.select(F.col("l_orderkey").alias("q_id"), (F.col("l_partkey") % 400).alias("h_id"), F.col("l_linenumber").alias("rank"), distance.alias("distance"), "l_quantity")
    return result_violations(results.drop("l_quantity"), results.filter("l_quantity > 2"), k=4).select("entity_key", "rule_id")


@query("""
WITH c AS (SELECT p_partkey AS id, p_name, CASE WHEN p_size > 30 THEN p_size + 100 ELSE p_size END::INTEGER AS size FROM part WHERE p_partkey % 10 <> 0),
a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT a.id, p_name, size, c.id IS NOT NULL AS held, (SELECT count(*) FROM c) AS n FROM a LEFT JOIN c USING (id)
""")
def collection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of parts, upserted twice, looked up by the parts of large orders; ids that it lacks are told, and its size."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_size").alias("size"))
    held = Collection(spark, new_path(spark, "collection"), "parts")
    held.upsert(p.filter("size <= 40"))
    held.upsert(p.filter("size > 30").withColumn("size", F.col("size") + 100))
    asked = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    found = held.get(asked).withColumn("held", F.lit(True))
    gone = held.missing(asked).select("id", F.lit(None).cast("string").alias("p_name"), F.lit(None).cast("int").alias("size"), F.lit(False).alias("held"))
    return found.unionByName(gone).withColumn("n", F.lit(held.count()).cast("long"))


@query("""
WITH d AS (SELECT doc_id, string_split(text, ' ')[1:2] AS w, lang, n_chars FROM documents),
f AS (SELECT doc_id, 0 AS g, i, 'cause' AS kind, w[i] AS text FROM d, range(1, 3) r(i) WHERE i <= len(w)
      UNION ALL SELECT doc_id, 1, i, 'check', w[i] || ': ' || lang FROM d, range(1, 3) r(i) WHERE i <= len(w)
      UNION ALL SELECT doc_id, 2, 1, 'assessment', lang FROM d UNION ALL SELECT doc_id, 2, 3, 'conclusion', n_chars::VARCHAR FROM d WHERE n_chars % 2 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, i)::INTEGER AS pos, 'E' || row_number() OVER (PARTITION BY doc_id ORDER BY g, i) AS alias, kind, text FROM f
""")
def fact_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each case in order, with aliases by one counter; missing fields have none."""
    w = F.slice(F.split("text", " "), 1, 2)
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), w.alias("possible_causes"), F.transform(w, lambda x: F.struct(x.alias("check"), F.col("lang").alias("result"))).alias("check_results"), F.col("lang").alias("assessment"),
        F.lit(None).cast("string").alias("action_taken"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).alias("conclusion"), F.lit(None).cast("string").alias("limitation"),
    )
    return cases.facts(d).select(F.col("case_id").alias("doc_id"), "pos", "alias", "kind", "text")


@query("""
WITH o AS (SELECT o_custkey AS variant, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
SELECT 'order' AS rule_id, variant || '/' || pos AS entity_key FROM o WHERE id % 5 = 0 AND pos <> 2
UNION ALL SELECT 'gap', variant::VARCHAR FROM (SELECT variant, max(pos) AS m, count(*) AS n FROM o WHERE pos <> 2 GROUP BY 1) WHERE m <> n
""")
def resume_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed items of runs that are not the first planned ones in order, and runs with a gap."""
    o = table(spark, sf_dir, "orders").withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    done = o.filter("pos <> 2").select(F.col("o_custkey").alias("variant"), F.concat_ws("/", "o_custkey", "pos").alias("at"), F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.col("o_orderkey")).alias("id"), "pos")
    planned = o.select(F.concat_ws("/", "o_custkey", "pos").alias("pos"), F.col("o_orderkey").alias("id"))
    wrong = done.withColumnRenamed("pos", "k").withColumnRenamed("at", "pos").join(planned.withColumnRenamed("id", "_id"), "pos").filter("id <> _id").select(F.lit("order").alias("rule_id"), F.col("pos").alias("entity_key"))
    gaps = audit.prefix_violations(done.select("variant", "pos", "id"), done.select("pos", "id").limit(0)).filter("rule_id = 'gap'").select("rule_id", "entity_key")
    return wrong.unionByName(gaps)


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), a AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
q AS (SELECT item_id, unnest(list_filter(list_distinct({_WORDS}), lambda x: length(x) > 2)) AS word FROM benchmark),
i AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
f AS (SELECT word, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM i, a GROUP BY word, n),
s AS (SELECT item_id, doc_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM q JOIN i USING (word) JOIN f USING (word), a GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most with each benchmark item by BM25."""
    out = baselines.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 256 AS bucket, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL),
x AS (SELECT doc_id, bucket, tf * ln((SELECT count(*) + 1 FROM documents) / (count(*) OVER (PARTITION BY bucket) + 1)) AS x FROM c),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id)
SELECT doc_id, count(*) AS n_buckets, round(max(x / norm), 6) AS heaviest, round(sum(x / norm), 4) AS total FROM x JOIN n USING (doc_id) WHERE norm > 0 GROUP BY doc_id
""")
def hashed_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed TF-IDF vectors of the documents in 256 buckets, summed up."""
    v = baselines.tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 4).alias("total"))


@query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS lens FROM documents)
SELECT doc_id, doc_id % 7 <> 0 AS lines_ok, doc_id % 5 <> 0 AS size_ok FROM l
""")
def nested_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded nested arrays against those of the text, element by element: a changed element, and one too many."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n"), F.array(F.md5(x.cast("binary"))).alias("h")))
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("made"))
    changed = F.transform("made", lambda x, i: F.struct(F.when((i == 0) & (F.col("doc_id") % 7 == 0), x["n"] + 1).otherwise(x["n"]).alias("n"), x["h"].alias("h")))
    d = d.withColumn("told", F.when(F.col("doc_id") % 5 == 0, F.concat(changed, F.slice("made", 1, 1))).otherwise(changed))
    first = F.slice("told", F.lit(1), F.size("made"))
    same = F.forall(F.zip_with("made", first, lambda a, b: a.eqNullSafe(b)), lambda ok: ok)
    return d.select("doc_id", same.alias("lines_ok"), (F.size("made") == F.size("told")).alias("size_ok"))


QUERIES = {name: f for name, (f, _) in Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql}
