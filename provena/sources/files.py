"""Readers of evidence files, all by Spark's own sources, so that any file system will do.

Every reader fails on input that breaks its format; content is only judged by constraints on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provena.operators.constraints import union_all
from provena.sources.stored import stored

LABELS = r"(?i)\b(?:synthetic|simulated|prototype)\b"  # fixed values: words that a log may not hold


def relative(path: Column, root: str) -> Column:
    """The path below the root; null where it is not below it or climbs out of it."""
    at = F.instr(path, root.rstrip("/") + "/")
    below = F.substring(path, at + len(root.rstrip("/")) + 1, F.length(path))
    return F.when((at > 0) & ~F.concat(F.lit("/"), below, F.lit("/")).contains("/../"), below)


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per file of one JSON document each, with its path; malformed documents fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, sha256, length and content of each file, found recursively."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", "content")


def split_lines(spark: SparkSession, path: str, glob: str | None = None, folder: bool = False) -> DataFrame:
    """path, line_no and line of all files below a path, numbered from one in each, or over all files by path as one sequence.

    Files are read in splits, wherever those lie: each split's lines are counted, counts are summed over the splits before
    it, and lines are numbered where they are, so that a file of any size is many tasks. Lines end at a line feed alone; an
    empty file has none; bytes must be UTF-8.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    read = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    rows = stored(read.select(*at, F.validate_utf8("value").alias("line")), "split-lines")
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = (Window.orderBy("path", "split") if folder else Window.partitionBy("path").orderBy("split")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.select("path", "split", (F.coalesce(F.sum("n").over(order), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return rows.join(starts, ["path", "split"]).select("path", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, sha256, line_no and line of all files as split_lines; the hash is of a file's bytes as they are and takes one task a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path)
    hashes = files.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))
    return split_lines(spark, path, glob).join(hashes, "path").select("path", "sha256", "line_no", "line")


def log_violations(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with carriage returns or banned words."""
    files = whole_files(spark, path, glob).select("path", F.col("content").cast("string").alias("t"))
    bad = lambda rule, ok, text: files.filter(ok).select(F.lit(rule).alias("rule_id"), F.col("path").alias("entity_key"), F.lit(text).alias("message"))
    return union_all([bad("S04-cr", F.instr("t", "\r") > 0, "carriage return"), bad("S04-word", F.col("t").rlike(LABELS), "banned word")])


def json_lines(spark: SparkSession, path: str, schema: StructType | str, skip_blank: bool = True, folder: bool = False) -> DataFrame:
    """Rows of JSONL with their one-based line_no; blank lines are skipped or fail, malformed ones fail. folder: one sequence over all files."""
    lines = split_lines(spark, path, folder=folder)
    if skip_blank:
        lines = lines.filter(F.trim("line") != "")
    parsed = lines.select("line_no", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("line_no", "r.*")


def json_line_violations(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """Lines of JSONL that a strict reader rejects: blank ones, those that are not JSON, and objects that repeat a key at any depth."""
    line = F.col("line")
    rule = F.when(F.trim(line) == "", "S03-blank").when(F.try_parse_json(line).isNotNull(), F.lit(None)).when(F.get_json_object(line, "$").isNotNull(), "S03-keys").otherwise("S03-json")
    lines = split_lines(spark, path, folder=folder).select(F.concat("path", F.lit(":"), F.col("line_no").cast("string")).alias("entity_key"), "line_no", rule.alias("rule_id"))
    texts = {"S03-blank": "blank line", "S03-keys": "repeated key", "S03-json": "not JSON"}
    message = F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[F.col("rule_id")]
    return lines.filter("rule_id is not null").select("rule_id", "entity_key", message.alias("message"), "line_no")


def csv_contract(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file whose header must name exactly the schema's columns in order and whose values must have its types."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def lot_and_wafer(path: Column) -> tuple[Column, Column]:
    """Lot and wafer from .../LOT/WAFER.txt."""
    return F.regexp_extract(path, r"/([^/]+)/[^/]+\.txt$", 1), F.regexp_extract(path, r"/([^/]+)\.txt$", 1)


def power_from_telemetry(line: Column) -> Column:
    """Watts from a telemetry line's milliwatts; null where it has none."""
    return F.regexp_extract(line, r"\bVDD_IN (\d+)mW", 1).try_cast("double") / 1000
