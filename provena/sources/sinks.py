"""Writers of evidence: canonical JSON, bundles with a hash of their own, upserts, reports. None overwrites by accident."""

from __future__ import annotations

import hashlib
import json
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.constraints import ContractError
from provena.operators.retrieval import upsert


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as compact JSON with keys in order and nulls kept."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})


def pretty_json(document: dict) -> str:
    """One small document as indented JSON with keys in order."""
    return json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def outside(target: str, source: str) -> None:
    """Refuse a target below the source tree, by whatever way its path leads there."""
    if (posixpath.normpath(target) + "/").startswith(posixpath.normpath(source).rstrip("/") + "/"):
        raise ContractError(f"{target} lies below {source}")


def write_bundle(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order over all part files; an existing target fails."""
    df.select(*order, canonical_json(df).alias("value")).orderBy(*order).select("value").write.mode("errorifexists").text(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a SHA-256 over order-free sums of the rows' hashes, and the rows' number; partial sums are all that moves."""
    h = df.select(F.xxhash64(canonical_json(df)).alias("h"), F.sha2(canonical_json(df), 256).alias("s"))
    low = F.conv(F.substring("s", 1, 12), 16, 10).cast("decimal(20,0)")
    sums = h.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.coalesce(F.sum(low), F.lit(0)).alias("t"))
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("x").cast("string"), F.col("t").cast("string")), 256).alias("sha256"), "n")


def file_hashes(df: DataFrame, path: str) -> DataFrame:
    """(path, sha256, length) of the files that a sink has written: what a manifest lists. df gives the session."""
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def bundle_hash(df: DataFrame, path: str) -> str:
    """The SHA-256 of a written bundle's lines in its order, each with its line end, read back file by file."""
    digest = hashlib.sha256()
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    for r in files.select("content").orderBy("path").toLocalIterator():  # one file at a time
        digest.update(r["content"])
    return digest.hexdigest()


def write_new(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def append_audit(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Audit rows under their run."""
    df.write.mode("append").partitionBy(run).parquet(path)


def upsert_table(held: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Write the held rows with the new ones in place of equal keys to a new path."""
    write_new(upsert(held, new, key), path)


def write_metrics_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One small summary as a single CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def append_power_csv(df: DataFrame, path: str) -> None:
    df.select("case_id", "watts").write.mode("append").csv(path, header=True)
