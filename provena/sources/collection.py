"""A stored collection of records by id: upserts make versions, readers see the last one that was published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena.operators.constraints import duplicates, enforce
from provena.operators.retrieval import upsert
from provena.sources.commits import Store


class Collection:
    """Records (id, and more) below a path. Every upsert writes a whole version and publishes it by a marker.

    A version is sorted by id over its files, so that a lookup's bounds on ids reach the scan; ids are never null.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.store = spark, Store(spark, path, {"collection": name})

    def records(self) -> DataFrame | None:
        """The last published version; None before the first upsert."""
        done = self.store.published()
        return self.spark.read.parquet(done[-1]["table"]) if done else None

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in place of those of the same id; ids that repeat among the new ones, or are null, are refused."""
        enforce(duplicates(rows, ["id"], "S10-id").unionByName(duplicates(rows.filter("id is null").unionByName(rows.filter("id is null")), ["id"], "S10-null")))
        held = self.records()
        merged = rows if held is None else upsert(held, rows, "id")
        version = f"version-{len(self.store.published()):06d}"
        self.store.publish(version, self.store.stage(merged.repartitionByRange("id").sortWithinPartitions("id"), version))

    def get(self, ids: DataFrame) -> DataFrame:
        """The records of some ids (id); ids that are not held give none, repeated ones give one."""
        return self.records().join(ids.select("id"), "id", "left_semi")

    def missing(self, ids: DataFrame) -> DataFrame:
        """The ids that are not held."""
        return ids.select("id").distinct().join(self.records().select("id"), "id", "left_anti")

    def count(self) -> int:
        """How many records there are, as the last marker says."""
        done = self.store.published()
        return done[-1]["rows"] if done else 0
