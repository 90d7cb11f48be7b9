"""Case histories: linked stages, the catalog of causes and checks with aliases, facts, and the verification of selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.text import literal

STAGES = ["observation", "investigation", "action", "retest"]


def stage_pivot(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per case with the value of each stage, by one grouping; complete where no stage is missing."""
    cells = [F.max(F.when(F.col("stage") == s, F.col(value))).alias(s) for s in STAGES]
    seen = [F.coalesce(F.bool_or(F.col("stage") == s), F.lit(False)) for s in STAGES]
    return records.groupBy(*keys).agg(*cells, reduce(lambda a, b: a & b, seen).alias("complete"))


def stage_items(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Ranked matches (query_id, rank, case_id) with the four stage records of each (case_id, stage, record_id, and more), in the order of stages.

    Adds position, from one over a query's items, and citation_id; records of other stages are no items.
    """
    order = F.array_position(F.array(*(F.lit(x) for x in STAGES)), F.col("stage"))
    items = matches.join(records.filter(F.col("stage").isin(STAGES)), "case_id").withColumn("stage_no", order.cast("int"))
    return items.withColumn("position", ((F.col("rank") - 1) * len(STAGES) + F.col("stage_no")).cast("int")).withColumnRenamed("record_id", "citation_id")


def stage_item_violations(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Matches that lack one of the stages or have one twice."""
    from provena.operators.constraints import violations

    per = matches.select("query_id", "case_id").join(items.groupBy("query_id", "case_id").agg(F.count("*").alias("n"), F.count_distinct("stage").alias("kinds")), ["query_id", "case_id"], "left")
    return violations(per, F.concat_ws("/", "query_id", "case_id"), {"J16-stages": ((F.col("n") == 4) & (F.col("kinds") == 4), "needs each of four stages once")})


def link_violations(records: DataFrame) -> DataFrame:
    """Cases whose records disagree on device or observation, lack or repeat a stage, or are not synthetic and untested."""
    # One order by record ids tells repeated ones and numbers the records, so that no row is copied for each distinct count.
    by = Window.partitionBy("case_id").orderBy("record_id")
    rows = records.select(
        "case_id", "record_id", "stage", "dut_id", "observation_id", F.coalesce("synthetic", F.lit(False)).alias("synthetic"),
        F.coalesce(~F.col("physical_test_performed"), F.lit(False)).alias("untested"), F.col("role").eqNullSafe("historical").alias("historical"),
    )
    rows = rows.withColumn("_at", F.row_number().over(by)).withColumn("_new", F.col("record_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.lag("record_id").over(by)))
    alike = lambda c: (F.min(c) == F.max(c)).alias(c)  # noqa: E731  null where there is none
    first = [F.max(F.when(F.col("_at") == i + 1, F.col("stage"))) for i in range(len(STAGES))]
    per = rows.groupBy("case_id").agg(
        F.count("*").alias("n"), F.array_distinct(F.array_compact(F.array(*first))).alias("stages"), alike("dut_id"), alike("observation_id"),
        F.count_if("_new").alias("ids"), F.bool_and("synthetic").alias("synthetic"), F.bool_and("untested").alias("untested"), F.bool_and("historical").alias("historical"),
    )
    rules = {
        "stages": ((F.col("n") == len(STAGES)) & (F.size("stages") == len(STAGES)), "needs each of four stages once"),
        "device": (F.col("dut_id"), "records name different devices"),
        "observation": (F.col("observation_id"), "records name different observations"),
        "record": (F.col("ids") == F.col("n"), "record ids repeat"),
        "synthetic": (F.col("synthetic") & F.col("untested"), "must be synthetic and not physically tested"),
        "role": (F.col("historical"), "must be historical"),
    }
    from provena.operators.constraints import violations

    return violations(per, "case_id", rules)


def anti_leak(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side does not know."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def catalog(cases: DataFrame) -> DataFrame:
    """Causes and checks of each matched case, numbered within the case: query_id, rank, case_id, kind, ordinal, item_id, text."""
    part = lambda column, kind, sign: cases.select(
        "query_id", "rank", "case_id", "dut_id", F.lit(kind).alias("kind"), F.posexplode(column).alias("_at", "text")
    ).select("query_id", "rank", "case_id", "dut_id", "kind", (F.col("_at") + 1).alias("ordinal"), F.concat("case_id", F.lit(sign), (F.col("_at") + 1).cast("string")).alias("item_id"), "text")
    return part("possible_causes", "cause", "-C").unionByName(part("checks", "check", "-K"))


def without_foreign_pins(items: DataFrame, history_pins: Column, current_pins: Column) -> DataFrame:
    """Drop causes that name a pin of the historical case which the current one lacks; ordinals keep their gaps."""
    named = lambda p: F.rlike(F.col("text"), F.concat(F.lit(r"\b"), literal(p), F.lit(r"\b")))
    foreign = F.exists(F.array_except(history_pins, current_pins), named)
    return items.filter((F.col("kind") != "cause") | ~foreign)


def alias_catalog(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add pos and alias: C for causes and K for checks, numbered by one counter over the order."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    letter = F.when(F.col("kind") == "cause", "C").otherwise("K")
    return items.withColumn("pos", pos).withColumn("alias", F.concat(letter, F.col("pos").cast("string")))


def resolve_aliases(picks: DataFrame, catalog_: DataFrame, key: str, ids: str) -> DataFrame:
    """One row per picked alias in its order, joined with the catalog; known is false where the catalog lacks it."""
    rows = picks.select(key, F.posexplode(ids).alias("_at", "alias")).withColumn("pos", F.col("_at") + 1).drop("_at")
    return rows.join(catalog_.drop("pos").withColumn("_k", F.lit(True)), [key, "alias"], "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


def facts(cases: DataFrame) -> DataFrame:
    """Facts of a case in order with aliases E1, E2 ...: causes, checks with their outcomes, and the text fields."""
    cause = cases.select("case_id", F.lit(0).alias("g"), F.posexplode("possible_causes").alias("i", "text")).withColumn("kind", F.lit("cause"))
    check = cases.select("case_id", F.lit(1).alias("g"), F.posexplode("check_results").alias("i", "c")).select("case_id", "g", "i", F.concat_ws(": ", "c.check", "c.result").alias("text"), F.lit("check").alias("kind"))
    fields = ["assessment", "action_taken", "conclusion", "limitation"]
    other = cases.select("case_id", F.lit(2).alias("g"), F.posexplode(F.array(*(F.struct(F.lit(f).alias("kind"), F.col(f).alias("text")) for f in fields))).alias("i", "s")).select("case_id", "g", "i", "s.text", "s.kind")
    every = cause.unionByName(check).unionByName(other).filter("text is not null")
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy("g", "i"))
    return every.withColumn("pos", pos).select("case_id", "pos", F.concat(F.lit("E"), F.col("pos").cast("string")).alias("alias"), "kind", "text")


def applicable(test_number: Column, direction: Column, cause_direction: Column) -> Column:
    """Whether history may answer: only test 210 needs a known direction on both sides, and the same one."""
    return F.coalesce((test_number != 210) | (direction == cause_direction), F.lit(False))


def foreign_pin_mentions(text: Column, pins: Column, current: Column) -> Column:
    """Known pins that a text names, in any letter case, and the current failure lacks."""
    named = F.filter(pins, lambda p: F.rlike(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9_])"), literal(F.lower(p)), F.lit(r"(?![a-z0-9_])"))))
    return F.array_except(F.transform(named, lambda p: F.upper(p)), F.transform(current, lambda p: F.upper(p)))


def verify_items(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add reason, the first rule in order that does not hold (null counts as not), and kept."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return items.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def decide(verified: DataFrame, by: list[str]) -> DataFrame:
    """unconfirmed where a cause and a check are kept, else refuse."""
    kept = lambda k: F.count_if(F.col("kept") & (F.col("kind") == k)).alias(f"{k}s")
    out = verified.groupBy(*by).agg(kept("cause"), kept("check"))
    return out.withColumn("status", F.when((F.col("causes") > 0) & (F.col("checks") > 0), "unconfirmed").otherwise("refuse"))


def citation_violations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations whose file is unknown, whose hash differs, whose lines lie outside the file, or whose text the record lacks."""
    from provena.operators.constraints import violations

    s = sources.select("file", F.col("sha256").alias("_sha"), F.col("n_lines").alias("_n"), F.col("texts").alias("_texts"))
    both = citations.join(s, "file", "left")
    rules = {
        "file": (F.col("_sha").isNotNull(), "no such source"),
        "hash": (F.col("sha256") == F.col("_sha"), "source has changed"),
        "lines": ((F.col("first_line") >= 1) & (F.col("first_line") <= F.col("last_line")) & (F.col("last_line") <= F.col("_n")), "lines outside the source"),
        "text": (F.array_contains("_texts", F.col("text")), "text is not in the source"),
    }
    return violations(both, "item_id", rules)


SELECTION = "struct<status:string,cause_ids:array<string>,check_ids:array<string>>"


def check_selection(rows: DataFrame, text: str, max_causes: int = 2, max_checks: int = 2, options: DataFrame | None = None, key: str = "query_id", forced: bool = False) -> DataFrame:
    """Add accepted and error for a selection document: exact keys, none twice, lists of distinct strings, limits, status.

    options (key, alias, kind): what may be picked; an alias that is not there, or is of the other kind, is an error.
    forced: a refusal is an error. The order of the rules is the order in which the first error is named. Texts that are
    no JSON object are malformed.
    """
    if options is not None:  # a catalog is a few rows a query
        known = options.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("alias", "kind"))).alias("_kinds"))
        rows = rows.join(known, key, "left")
    keys = F.json_object_keys(text)
    got = F.from_json(text, SELECTION)
    causes, checks, status = got["cause_ids"], got["check_ids"], got["status"]
    strings = lambda c: F.get_json_object(text, f"$.{c}").rlike(r'^\[(\s*"[^"]*"\s*(,\s*"[^"]*"\s*)*)?\]$')
    wrong = [
        (keys.isNull(), "malformed"),
        (F.size(keys) != F.size(F.array_distinct(keys)), "repeated key"),
        (F.array_sort(keys) != F.array(F.lit("cause_ids"), F.lit("check_ids"), F.lit("status")), "keys"),
        (~F.coalesce(status.isin("unconfirmed", "refuse"), F.lit(False)), "status"),
        (~F.coalesce(strings("cause_ids") & strings("check_ids"), F.lit(False)), "lists of strings"),
        ((F.size(causes) > max_causes) | (F.size(checks) > max_checks), "too many"),
        ((F.size(causes) != F.size(F.array_distinct(causes))) | (F.size(checks) != F.size(F.array_distinct(checks))), "repeated id"),
        ((status == "refuse") & (F.size(causes) + F.size(checks) > 0), "refusal with items"),
        ((status == "unconfirmed") & ((F.size(causes) == 0) | (F.size(checks) == 0)), "answer without items"),
    ]
    if options is not None:
        kind = lambda alias: F.try_element_at("_kinds", alias)
        picked = F.concat(causes, checks)
        wrong[-2:-2] = [
            (F.exists(picked, lambda a: kind(a).isNull()), "unknown id"),
            (F.exists(causes, lambda a: ~kind(a).eqNullSafe("cause")) | F.exists(checks, lambda a: ~kind(a).eqNullSafe("check")), "wrong kind"),
        ]
    if forced:
        wrong.append((status == "refuse", "refusal where an answer is asked for"))
    error = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in wrong))
    return rows.withColumn("selection", got).withColumn("error", error).withColumn("accepted", F.col("error").isNull()).drop("_kinds")


def select_by_rule(items: DataFrame, by: list[str], max_causes: int = 2, max_checks: int = 2) -> DataFrame:
    """The deterministic selector: the first applicable causes and checks by position, as a selection document."""
    top = lambda kind, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "alias")))), lambda s: s["alias"]), 1, n)
    picked = items.groupBy(*by).agg(top("cause", max_causes).alias("cause_ids"), top("check", max_checks).alias("check_ids"))
    full = (F.size("cause_ids") > 0) & (F.size("check_ids") > 0)
    none = F.array().cast("array<string>")
    cells = F.struct(F.when(full, F.col("cause_ids")).otherwise(none).alias("cause_ids"), F.when(full, F.col("check_ids")).otherwise(none).alias("check_ids"), F.when(full, "unconfirmed").otherwise("refuse").alias("status"))
    return picked.select(*by, F.to_json(cells).alias("selection_text"))
