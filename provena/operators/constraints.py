"""Constraints as violation rows, and the operator that refuses to go on while there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A dataset violates its contract; the message names the first violations."""


def violations(df: DataFrame, key: Column | str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(rule_id, entity_key, message) for every row and rule whose condition is not true.

    A condition that is null counts as violated: what cannot be shown to hold does not hold. One pass over the rows.
    """
    name = F.col(key) if isinstance(key, str) else key
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(message).alias("message")))
        for rule, (ok, message) in rules.items()
    ]
    found = df.select(name.cast("string").alias("entity_key"), F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("v"))
    return found.select("v.rule_id", "entity_key", "v.message")


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """One violation for every key that more than one row has."""
    many = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    return many.select(F.lit(rule).alias("rule_id"), text.alias("entity_key"), F.concat(F.col("n").cast("string"), F.lit(" rows share a key")).alias("message"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys of either side that the other lacks, told apart by the message."""
    a, b = (df.select(*keys).distinct() for df in (left, right))
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), keys, "full_outer").filter("_l is null or _r is null")
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return both.select(F.lit(rule).alias("rule_id"), text.alias("entity_key"), F.when(F.col("_r").isNull(), "missing on the right").otherwise("missing on the left").alias("message"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def has_text(column: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(F.trim(F.regexp_replace(column, r"\s+", " ")) != "", F.lit(False))


def finite_positive(column: Column) -> Column:
    x = column.cast("double")
    return F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))


def within(column: Column, characters: int | None = None, n_bytes: int | None = None) -> Column:
    """Whether a text keeps to its most code points and most bytes; nothing is cut."""
    parts = [F.length(column) <= characters] if characters is not None else []
    parts += [F.octet_length(column) <= n_bytes] if n_bytes is not None else []
    return reduce(lambda a, b: a & b, parts, column.isNotNull())


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def query_only(role: Column, indexed: Column) -> Column:
    """Whether an incident is kept out of the history."""
    return role.eqNullSafe("query_only") & indexed.eqNullSafe(False)


def allowed_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only these columns, in this order; one that is missing fails."""
    return df.select(*(F.col(f"`{c}`") for c in fields))


def enforce(found: DataFrame, show: int = 5) -> None:
    """Raise ContractError where there are violations; reads a few of them, in order."""
    rows = found.orderBy("rule_id", "entity_key").limit(show).collect()
    if rows:
        raise ContractError("; ".join(f"{r['rule_id']} {r['entity_key']}: {r['message']}" for r in rows))
