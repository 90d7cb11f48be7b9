"""Relational queries: scans, parsing, joins, windows, sets and constraints over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions.hashing import hash_number, sha_hex
from provena.functions.text import cause_direction, is_ambiguous, only_hint, pin_list, references, sentences, tokens
from provena.operators.cases import alias_catalog, anti_leak, resolve_aliases, stage_pivot, verify_items
from provena.operators.chat import first_fit, last_turns
from provena.operators.constraints import duplicates, union_all, unmatched, violations
from provena.operators.lines import excerpt_hash, number_lines, segment
from provena.operators.ordered import place, previous, row_numbers, running_sum, value_counts
from provena.operators.sampling import adjacent_triples, first_k_by_hash, hash_quota, running_clock, slots
from provena.operators.suite import remaining
from provena.sources.tables import table

Q: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its name with its DuckDB SQL."""

    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query("""
SELECT doc_id, i AS line_no, sha256(x) AS line_sha256
FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(x) <> ''
""")
def numbered_lines_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-based line numbers of non-blank lines with their hashes."""
    lines = number_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter(F.trim("line") != "")
    return lines.select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query("""
WITH l AS (
  SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), b AS (SELECT *, sum((i = 1 OR regexp_matches(x, '^The '))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l)
SELECT doc_id, block::BIGINT AS block, min(i)::INTEGER AS first_line, max(i)::INTEGER AS last_line, md5(string_agg(x, chr(10) ORDER BY i)) AS block_md5 FROM b GROUP BY doc_id, block
""")
def block_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines from one start marker to the line before the next."""
    lines = number_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    blocks = segment(lines, ["doc_id"], F.col("line").rlike("^The ") | (F.col("line_no") == 1))
    return blocks.select("doc_id", "block", "first_line", "last_line", F.md5("block_text").alias("block_md5"))


@query("""
WITH r AS (SELECT doc_id, 1 + doc_id % 3 AS a, 3 + doc_id % 3 AS b, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l[a:b], chr(10))) AS excerpt_sha256, len(l[a:b])::INTEGER AS n_lines FROM r WHERE len(l) >= a
""")
def line_range_excerpt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of an inclusive line range of each document; ranges that begin beyond the end give no row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranges = d.select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("first_line"), (3 + F.col("doc_id") % 3).cast("int").alias("last_line"))
    return excerpt_hash(number_lines(d, "text"), ranges, "doc_id")


@query(r"""
SELECT page_id, CASE WHEN n = 1 THEN host END AS host_hint, CASE WHEN m = 1 THEN lang END AS lang_hint, n > 1 AS host_ambiguous
FROM (SELECT page_id, len(list_distinct(h)) AS n, list_distinct(h)[1] AS host, len(list_distinct(g)) AS m, list_distinct(g)[1] AS lang
      FROM (SELECT page_id, regexp_extract_all(html, 'href="https?://([^/"]+)', 1) AS h, regexp_extract_all(html, 'lang="([a-z]+)"', 1) AS g FROM pages))
""")
def form_hint_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that a page gives about itself; more than one distinct hint is ambiguous and gives none."""
    p, host, lang = table(spark, sf_dir, "pages"), r'href="https?://([^/"]+)', r'lang="([a-z]+)"'
    return p.select("page_id", only_hint(F.col("html"), host).alias("host_hint"), only_hint(F.col("html"), lang).alias("lang_hint"), is_ambiguous(F.col("html"), host).alias("host_ambiguous"))


@query("""
SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, len(json_keys(props))::INTEGER AS n_keys,
       len(json_keys(props)) = 1 AND json_extract_string(props, '$.k') IS NOT NULL AS accepted FROM events
""")
def kv_extract_json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys of a JSON document: no other, none twice."""
    e = table(spark, sf_dir, "events").withColumn("keys", F.json_object_keys("props"))
    ok = (F.size("keys") == 1) & F.from_json("props", "k int")["k"].isNotNull()
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.size("keys").alias("n_keys"), ok.alias("accepted"))


@query(r"""
SELECT p_partkey, len(n)::INTEGER AS n_pins, n[1] AS first_pin, k[1]::INTEGER AS first_number
FROM (SELECT p_partkey, regexp_extract_all(t, '([A-Za-z][A-Za-z0-9_]*)\s*:\s*(\d+)', 1) AS n, regexp_extract_all(t, '([A-Za-z][A-Za-z0-9_]*)\s*:\s*(\d+)', 2) AS k
      FROM (SELECT p_partkey, replace(p_name, ' ', ' : ' || p_size || '   ') || ' : ' || p_partkey AS t FROM part))
""")
def pin_list_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAME : NUMBER entries of a composed pin line."""
    line = F.concat(F.replace("p_name", F.lit(" "), F.concat(F.lit(" : "), F.col("p_size"), F.lit("   "))), F.lit(" : "), F.col("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", pin_list(line).alias("pins"))
    return p.select("p_partkey", F.size("pins").alias("n_pins"), F.get("pins", 0)["name"].alias("first_pin"), F.get("pins", 0)["number"].alias("first_number"))


@query("""
WITH l AS (SELECT event_type, quantile_disc(value, 0.25) AS lo, quantile_disc(value, 0.75) AS hi FROM events GROUP BY event_type),
s AS (SELECT event_id, CASE WHEN value <= lo THEN 'low' WHEN value >= hi THEN 'high' END AS d,
             CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'low' END AS h FROM events JOIN l USING (event_type))
SELECT event_id, d AS direction, h AS cause_direction, d IS NOT NULL AND h IS NOT NULL AND d = h AS applicable FROM s
""")
def direction_case_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side of a value outside its type's limits, the side a cause speaks for, and whether they agree."""
    e = table(spark, sf_dir, "events")
    c = value_counts(e, ["event_type"], "value")
    lim = c.rows.groupBy("event_type").agg(c.nearest_rank(0.25).alias("lo"), c.nearest_rank(0.75).alias("hi"))
    cause = F.when(F.col("event_type") == "error", "excessive static current").when(F.col("event_type") == "signup", "a low supply")
    out = e.join(lim, "event_type").select("event_id", F.when(F.col("value") <= F.col("lo"), "low").when(F.col("value") >= F.col("hi"), "high").alias("direction"), cause_direction(cause).alias("cause_direction"))
    return out.withColumn("applicable", F.coalesce(F.col("direction") == F.col("cause_direction"), F.lit(False)))


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount::DECIMAL(6,2) > 0.02 AND l_discount::DECIMAL(6,2) < 0.07) AS inside FROM lineitem GROUP BY 1
""")
def open_interval_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values strictly between two limits, compared as decimals."""
    x = F.col("l_discount").cast("decimal(6,2)")
    inside = (x > F.lit("0.02").cast("decimal(6,2)")) & (x < F.lit("0.07").cast("decimal(6,2)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


@query("""
WITH s AS (SELECT *, coalesce(sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT user_id, count(*) AS executed, max((event_type = 'error')::INTEGER)::INTEGER AS failed FROM s WHERE before = 0 GROUP BY user_id
""")
def stop_at_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user up to and with its first error."""
    e = place(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").cast("int").alias("failed")), ["user_id"], ["ts", "event_id"])
    seen = running_sum(e, F.col("failed"), "seen", own=False).filter("seen = 0")
    return seen.groupBy("user_id").agg(F.count("*").alias("executed"), F.max("failed").alias("failed"))


@query("""
WITH f AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c FROM events GROUP BY user_id)
SELECT count(*) AS entered, count(*) FILTER (a) AS viewed, count(*) FILTER (a AND b) AS clicked, count(*) FILTER (a AND b AND c) AS bought FROM f
""")
def execution_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda k, c: F.bool_or(F.col("event_type") == k).alias(c)
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(has("view", "a"), has("click", "b"), has("purchase", "c"))
    return f.agg(F.count("*").alias("entered"), F.count_if("a").alias("viewed"), F.count_if(F.col("a") & F.col("b")).alias("clicked"), F.count_if(F.col("a") & F.col("b") & F.col("c")).alias("bought"))


_STATUS = ["F", "O", "P"]


@query("""
SELECT o_orderpriority AS priority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
       count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def wafer_rollup_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per group and overall, with a zero in every category of a fixed list."""
    o = table(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("priority"))
    return o.agg(F.count("*").alias("total"), *(F.count_if(F.col("o_orderstatus") == s).alias(s) for s in [*_STATUS, "X"]))


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('v1|42|sample|' || doc_id), doc_id) AS rank FROM documents)
SELECT lang, doc_id, rank::INTEGER AS rank FROM r WHERE rank <= 12
""")
def quota_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of documents of each language, by the rank of a salted hash."""
    d = table(spark, sf_dir, "documents")
    return hash_quota(d, ["lang"], sha_hex("v1", 42, "sample", F.col("doc_id")), "doc_id", 12).select("lang", "doc_id", "rank")


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('v1|42|pin|' || p_partkey || '|' || x)) AS rank FROM w)
SELECT p_partkey, string_agg(x, ',' ORDER BY rank) AS picked FROM r
WHERE rank <= 1 + (('0x' || substr(sha256('v1|42|pin-count|' || p_partkey), 1, 16))::UBIGINT % 3) GROUP BY p_partkey
""")
def k_of_n_hash_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first k words of each name by hash, k from one to three by another hash."""
    p = table(spark, sf_dir, "part")
    k = (1 + hash_number("v1", 42, "pin-count", F.col("p_partkey")) % 3).cast("int")
    order = lambda x: sha_hex("v1", 42, "pin", F.col("p_partkey"), x)
    return p.select("p_partkey", F.array_join(first_k_by_hash(F.split("p_name", " "), order, k), ",").alias("picked"))


@query("""
WITH g AS (SELECT DISTINCT p_size AS x, p_type AS y FROM part)
SELECT a.x, a.y FROM g a JOIN g b ON b.y = a.y AND b.x = a.x + 1 JOIN g c ON c.y = a.y AND c.x = a.x + 2
""")
def adjacent_triples_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.col("p_type").alias("y")).distinct()
    return adjacent_triples(g)


@query("SELECT r_regionkey, n_nationkey, r_name || '-' || n_name AS slot FROM region, nation")
def slot_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region with every nation: two tables of fixed size."""
    return slots(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).select("r_regionkey", "n_nationkey", F.concat_ws("-", "r_name", "n_name").alias("slot"))


@query("""
SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS observation, max(l_quantity) FILTER (l_linenumber = 2) AS investigation,
       max(l_quantity) FILTER (l_linenumber = 3) AS action, max(l_quantity) FILTER (l_linenumber = 4) AS retest,
       count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4) = 4 AS complete
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey
""")
def case_stage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stage records of a case in one row by one grouping, and whether all are there."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    names = {1: "observation", 2: "investigation", 3: "action", 4: "retest"}
    stage = F.coalesce(*(F.when(F.col("l_linenumber") == k, v) for k, v in names.items()))
    cases = stage_pivot(li.withColumn("stage", stage), ["l_orderkey"], "l_quantity")  # before the join, which then moves a row a case
    return cases.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("""
SELECT 'J01-order' AS rule_id, l_orderkey::VARCHAR AS entity_key, 'no such order' AS message FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'C14-customer', o_orderkey::VARCHAR, 'no such customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'C14-quantity', l_orderkey::VARCHAR, 'quantity out of bounds' FROM lineitem WHERE NOT (l_quantity > 0 AND l_quantity < 50)
""")
def broken_link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    a = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("J01-order").alias("rule_id"), F.col("l_orderkey").cast("string").alias("entity_key"), F.lit("no such order").alias("message"))
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("C14-customer").alias("rule_id"), F.col("o_orderkey").cast("string").alias("entity_key"), F.lit("no such customer").alias("message"))
    q = violations(li, "l_orderkey", {"C14-quantity": ((F.col("l_quantity") > 0) & (F.col("l_quantity") < 50), "quantity out of bounds")})
    return union_all([a, b, q])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def leakage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label has seen."""
    return anti_leak(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("""
SELECT 'J06' AS rule_id, coalesce(d.k, l.k)::VARCHAR AS entity_key, CASE WHEN l.k IS NULL THEN 'missing on the right' ELSE 'missing on the left' END AS message
FROM (SELECT DISTINCT doc_id AS k FROM documents) d FULL JOIN (SELECT DISTINCT vec_id AS k FROM embeddings) l ON d.k = l.k WHERE d.k IS NULL OR l.k IS NULL
""")
def full_outer_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return unmatched(table(spark, sf_dir, "documents"), e, ["doc_id"], "J06")


@query("""
SELECT doc_id, n_chars = length(text) AS n_chars_ok, lang IN ('en','fr','de','es') AS lang_ok, regexp_matches(source, '^src[0-9]+$') AS source_ok FROM documents
""")
def deep_compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded fields against what the text shows, field by field and null-safe."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("n_chars").eqNullSafe(F.length("text").cast("long")).alias("n_chars_ok"), F.col("lang").isin("en", "fr", "de", "es").alias("lang_ok"), F.col("source").rlike("^src[0-9]+$").alias("source_ok"))


@query("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 30 DAY ELSE ts END AS ts FROM events)
SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) WHERE ts < p
""")
def chronology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events earlier than their user's event of the id before, with every seventh set back by thirty days."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, F.col("ts") - F.expr("interval 30 days")).otherwise(F.col("ts")).alias("ts"))
    return previous(place(e, ["user_id"], ["event_id"]), before="ts").filter("ts < before").select("event_id", "user_id")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, i::INTEGER AS idx, TIMESTAMP '2026-01-01 08:00:00' + to_seconds(i * (10 + 112 * 3 + 60)) AS started FROM o
""")
def running_clock_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each unit in a sequence without gaps, in closed form."""
    o = row_numbers(place(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]), "n").withColumn("idx", (F.col("n") - 1).cast("int"))
    return o.select("o_orderkey", "idx", running_clock(F.lit("2026-01-01 08:00:00").cast("timestamp_ntz"), F.col("idx"), 10, 112, 3, 60).alias("started"))


@query("""
WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS pos FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, pos::INTEGER AS pos, CASE WHEN role = 'assistant' THEN 'K' ELSE 'C' END || pos AS alias FROM c
""")
def catalog_alias_shared_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases C and K numbered by one counter over the catalog's order."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    order = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    kind = F.when(F.col("role") == "assistant", "check").otherwise("cause")
    return alias_catalog(c.withColumn("kind", kind).withColumn("at", order), ["conv_id"], ["at", "turn"]).select("conv_id", "turn", "pos", "alias")


@query("""
WITH s AS (SELECT o_orderkey, [1, 3, 9] AS ids FROM orders), e AS (SELECT o_orderkey, unnest(ids) AS n, generate_subscripts(ids, 1) AS i FROM s)
SELECT e.o_orderkey, e.i::INTEGER AS pos, min(l_partkey) AS l_partkey, min(l_partkey) IS NOT NULL AS known
FROM e LEFT JOIN lineitem ON l_orderkey = e.o_orderkey AND l_linenumber = e.n GROUP BY e.o_orderkey, e.i
""")
def ordered_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of aliases looked up in order; unknown ones stay as unknown rows."""
    picks = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit(1), F.lit(3), F.lit(9)).alias("ids"))
    catalog = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("alias")).agg(F.min("l_partkey").alias("l_partkey"))
    return resolve_aliases(picks, catalog, "o_orderkey", "ids").select("o_orderkey", "pos", "l_partkey", "known")


@query("""
WITH i AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'cause' ELSE 'check' END AS kind, lang = 'en' AS dir_ok, n_chars >= 200 AS cited FROM labels JOIN documents USING (doc_id))
SELECT doc_id, kind, CASE WHEN NOT cited THEN 'citation' WHEN kind = 'cause' AND NOT dir_ok THEN 'direction' END AS reason, cited AND (kind = 'check' OR dir_ok) AS kept FROM i
""")
def selection_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected items with the first reason to reject them, checks free of the direction rule."""
    i = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    i = i.select("doc_id", F.when(F.col("quality") == 1, "cause").otherwise("check").alias("kind"), (F.col("lang") == "en").alias("dir_ok"), (F.col("n_chars") >= 200).alias("cited"))
    return verify_items(i, {"citation": F.col("cited"), "direction": (F.col("kind") == "check") | F.col("dir_ok")}).select("doc_id", "kind", "reason", "kept")


@query("""
SELECT rule_id, entity_key, message FROM (
  SELECT 'A19-documents' AS rule_id, doc_id::VARCHAR AS entity_key, count(*) || ' rows share a key' AS message, count(*) AS n FROM documents GROUP BY doc_id
  UNION ALL SELECT 'A19-lineitem', l_orderkey || '|' || l_linenumber, count(*) || ' rows share a key', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT 'A19-pages', url, count(*) || ' rows share a key', count(*) FROM pages GROUP BY url
) WHERE n > 1
""")
def uniqueness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"documents": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber"], "pages": ["url"]}
    return union_all([duplicates(table(spark, sf_dir, t), k, f"A19-{t}") for t, k in keys.items()])


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("""
WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS kept FROM conversations),
v AS (SELECT conv_id, kept, n, 9 - kept AS pos FROM c)
SELECT conv_id, arg_min(kept, pos)::INTEGER AS kept_turns, min(pos)::INTEGER AS variant FROM v WHERE n <= 2000 AND n + 160 + 64 <= 2048 GROUP BY conv_id
""")
def first_fit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of last turns that fits a budget; conversations that nothing fits have no row."""
    c, w = table(spark, sf_dir, "conversations"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    v = c.select("conv_id", F.sum(F.length("text")).over(w).alias("n"), F.row_number().over(w).alias("kept_turns"))
    v = v.withColumn("variant", 9 - F.col("kept_turns"))
    return first_fit(v, "conv_id", "variant", "n", limit=2000, reserve=160, total=2048, margin=64).select("conv_id", "kept_turns", "variant")


@query(r"""
WITH t AS (SELECT conv_id, turn, text || ' [E' || (turn + 1) || ', E' || (conv_id % 5) || '] and [E2]' AS t FROM conversations),
r AS (SELECT conv_id, turn, regexp_extract_all(array_to_string(regexp_extract_all(t, '\[(E\d+(?:\s*,\s*E\d+)*)\]', 1), ','), 'E\d+') AS refs FROM t)
SELECT conv_id, turn, len(list_distinct(refs))::INTEGER AS n_refs, len(list_filter(list_distinct(refs), lambda x: x NOT IN ('E1', 'E2', 'E3', 'E4'))) = 0 AS all_known FROM r
""")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed references of a reply, distinct, and whether all are among the known facts."""
    c = table(spark, sf_dir, "conversations")
    t = F.concat("text", F.lit(" [E"), (F.col("turn") + 1).cast("string"), F.lit(", E"), (F.col("conv_id") % 5).cast("string"), F.lit("] and [E2]"))
    r = c.select("conv_id", "turn", references(t).alias("refs"))
    known = F.array(*(F.lit(f"E{i}") for i in range(1, 5)))
    return r.select("conv_id", "turn", F.size("refs").alias("n_refs"), (F.size(F.array_except("refs", known)) == 0).alias("all_known"))


@query(r"""
WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1))) AS s FROM conversations)
SELECT conv_id, turn, count(*) AS n_sentences, count(*) FILTER (regexp_matches(lower(s), '^the ')) AS n_marked FROM s WHERE trim(s) <> '' GROUP BY conv_id, turn
""")
def sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each reply and those that begin with a marked word."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n_sentences"), F.count_if(F.lower("s").rlike("^the ")).alias("n_marked"))


@query("""
WITH wanted AS (SELECT v AS variant, o_orderkey AS id FROM orders, (VALUES ('full'), ('no_keyword'), ('no_verifier'), ('no_refusal')) t(v)),
done AS (SELECT 'full' AS variant, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'no_keyword', o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT variant, id FROM wanted EXCEPT SELECT variant, id FROM done
""")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed suite still has to run: variants by items, less the completed keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    done = o.filter("o_orderstatus in ('F', 'O')").select(F.when(F.col("o_orderstatus") == "F", "full").otherwise("no_keyword").alias("variant"), "id")
    return remaining(o.select("id"), done, "id")


@query("""
SELECT lang, coalesce(kind, 'text') AS origin, count(*) AS n FROM (SELECT lang, nullif(regexp_extract(text, '^(The|De|Der|La)[ ,.]', 1), '') AS kind FROM documents) GROUP BY ALL
""")
def distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed values, from a pattern where the column lacks one."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce(F.nullif(F.regexp_extract("text", r"^(The|De|Der|La)[ ,.]", 1), F.lit("")), F.lit("text")).alias("origin"))
    return d.groupBy("lang", "origin").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), lambda x: length(x) > 2))::INTEGER AS n_tokens FROM documents
""")
def distinct_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))


QUERIES = {name: f for name, (f, _) in Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in Q.items() if sql}
