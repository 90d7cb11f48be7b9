"""Order within a key without a task that holds the key: prefix scans in two levels and exact ranks of values.

Rows are dealt by ranges of key and order, so that a hot key is many partitions. Each partition is scanned on its own; what
it hands to the next, one row for each key and partition, is scanned over the partitions and joined back.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.sources.stored import stored

PART, PLACE = "_part", "_place"


class Placed(NamedTuple):
    """Stored rows with their partition and place in it, in the order of keys and order."""

    rows: DataFrame
    keys: list[str]

    @property
    def within(self) -> Window:
        return Window.partitionBy(*self.keys, PART).orderBy(PLACE)

    @property
    def earlier(self) -> Window:
        """Over what partitions hand on: those of the key before this one."""
        return Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    def carried(self, **handed: Column) -> DataFrame:
        """One row for each key and partition."""
        return self.rows.groupBy(*self.keys, PART).agg(*(c.alias(name) for name, c in handed.items()))

    def with_carry(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        """Join what earlier partitions hand on to the rows of each key and partition; null keys meet as well."""
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*self.keys, PART)]
        rest = [f"c.{c}" for c in carry.columns if c not in (*self.keys, PART)]
        return local.alias("l").join(carry.alias("c"), same).select("l.*", *rest)


def place(rows: DataFrame, keys: list[str], order: list[str]) -> Placed:
    """Deal rows by ranges of keys and order, which must be total where it matters, and store them where they then lie."""
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return Placed(stored(sorted_.withColumn(PART, F.spark_partition_id()).withColumn(PLACE, at), "placed"), keys)


def running_sum(p: Placed, value: Column, out: str, own: bool = True) -> DataFrame:
    """Add the sum of a whole or exact number over the key's rows up to this one, with or without its own."""
    carry = p.carried(_sum=F.sum(value))
    carry = carry.select(*p.keys, PART, F.coalesce(F.sum("_sum").over(p.earlier), F.lit(0)).alias("_before"))
    local = p.rows.withColumn("_own", F.coalesce(value, F.lit(0))).withColumn("_local", F.sum("_own").over(p.within.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.col("_local") + F.col("_before") - (F.lit(0) if own else F.col("_own"))
    return p.with_carry(local, carry).withColumn(out, total).drop("_sum", "_own", "_local", "_before", PART, PLACE)


def row_numbers(p: Placed, out: str) -> DataFrame:
    """Add the row's number within its key, from one."""
    return running_sum(p, F.lit(1), out)


def previous(p: Placed, **values: str) -> DataFrame:
    """Add under each name the value of a column in the key's row before; null in its first row."""
    names = list(values)
    row = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    carry = p.carried(_last=F.max_by(row, F.col(PLACE)))
    carry = carry.select(*p.keys, PART, F.lag("_last").over(Window.partitionBy(*p.keys).orderBy(PART)).alias("_last"))
    local = p.rows.withColumn("_at", F.row_number().over(p.within)).withColumn("_row", F.lag(row).over(p.within))
    both = p.with_carry(local, carry).withColumn("_row", F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_row")))
    return both.withColumns({n: F.col(f"_row.{n}") for n in names}).drop("_row", "_at", "_last", PART, PLACE)


class Counts(NamedTuple):
    """(by, value, n, before, total): how often each value of a group stands, how many of the group's values are smaller, and how many it has."""

    rows: DataFrame
    by: list[str]
    value: str

    def at_rank(self, rank: Column) -> Column:
        """An aggregate: the value of that rank, from one."""
        return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col(self.value)))

    def nearest_rank(self, share: float) -> Column:
        """An aggregate: the smallest value that at least that share of the values does not exceed."""
        return self.at_rank(F.greatest(F.ceil(_share_of(F.col("total"), share)), F.lit(1)))

    def interpolated(self, share: float) -> Column:
        """An aggregate: the value at that share of the way from the first to the last, between neighbours in proportion."""
        at = _share_of(F.col("total") - 1, share)
        low, high = self.at_rank(F.floor(at) + 1), self.at_rank(F.ceil(at) + 1)
        return low + (high - low) * F.max((at - F.floor(at)).cast("double"))


def _share_of(n: Column, share: float) -> Column:
    """An exact decimal, so that no rounding moves a rank."""
    return n.cast("decimal(20,0)") * F.lit(Decimal(str(share)))


def value_counts(rows: DataFrame, by: list[str], value: str) -> Counts:
    """Counts of the values of each group with what stands before them: equal values meet before anything is moved; nulls take no part.

    Any number of exact percentiles are then one aggregate over the counts, with two numbers held for each.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    p = place(counts, by, [value])
    upto = running_sum(p, F.col("n"), "before", own=False)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    out = upto.alias("u").join(totals.alias("t"), same).select("u.*", "t.total") if by else upto.crossJoin(totals)  # one row
    return Counts(out, by, value)
