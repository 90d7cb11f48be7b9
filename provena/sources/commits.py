"""Results of a suite, published part by part: a part counts once its marker stands, and markers stand for a prefix of the plan."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.constraints import ContractError
from provena.sources.sinks import content_hash


class Store:
    """A folder on any file system: config.json, staged tables, and one marker for each published part.

    A marker is written whole under another name and renamed, which fails where it stands already; it names the staged table
    with its number of rows and content hash. What a broken run leaves staged without a marker is never read.
    """

    def __init__(self, spark: SparkSession, root: str, configuration: dict):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._begin(json.dumps(configuration, sort_keys=True))

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    def _publish(self, name: str, document: str) -> None:
        """Put a small document under a name that nothing has yet, all of it or nothing."""
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(document.encode()))
        out.close()
        final = self._path(f"{self.root}/{name}")
        self._fs.mkdirs(final.getParent())
        try:
            self._files.rename(draft, final, self._rename)
        except Exception as e:
            self._fs.delete(draft, False)
            raise ContractError(f"{name} is published already") from e

    def _begin(self, configuration: str) -> None:
        if not self._exists("config.json"):
            self._publish("config.json", configuration)
        saved = self._read("config.json")
        if saved != (now := json.loads(configuration)):
            differing = sorted(k for k in saved.keys() | now.keys() if saved.get(k) != now.get(k))
            raise ContractError(f"the suite was begun with another configuration: {', '.join(differing)}")

    def published(self) -> list[dict]:
        """The markers in their order: part, table, rows and hash of each."""
        found, n = [], 0
        while self._exists(f"markers/{n:06d}.json"):
            found.append(self._read(f"markers/{n:06d}.json"))
            n += 1
        return found

    def stage(self, df: DataFrame, part: str) -> str:
        """Write a part's rows where nobody reads them yet."""
        path = f"{self.root}/staged/{part}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def publish(self, part: str, table: str) -> None:
        """Make a staged table the next part, in the plan's order; a part is published once."""
        done = self.published()
        if part in {m["part"] for m in done}:
            raise ContractError(f"{part} is published already")
        mark = content_hash(self.spark.read.parquet(table)).first()
        self._publish(f"markers/{len(done):06d}.json", json.dumps({"part": part, "table": table, "rows": mark["n"], "sha256": mark["sha256"]}, sort_keys=True))

    def results(self, schema: str) -> DataFrame:
        """The rows of all published parts with their part; a table that is not what its marker says fails."""
        out = self.spark.createDataFrame([], f"{schema}, part string")
        for m in self.published():
            rows = self.spark.read.parquet(m["table"])
            mark = content_hash(rows).first()
            if (mark["n"], mark["sha256"]) != (m["rows"], m["sha256"]):
                raise ContractError(f"{m['part']} has changed since it was published")
            out = out.unionByName(rows.withColumn("part", F.lit(m["part"])))
        return out

    def resume(self, planned: list[str]) -> list[str]:
        """The parts that are still to be made; what is published must be the first planned ones in order."""
        done = [m["part"] for m in self.published()]
        if done != planned[: len(done)]:
            raise ContractError(f"published parts {done} are not the first planned ones")
        return planned[len(done) :]
