"""Line-addressed text: numbering, segmentation by a start marker, excerpts by line range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_lines(files: DataFrame, text: str) -> DataFrame:
    """One row per line with its one-based line_no; an empty last piece after a final newline is no line."""
    parts = F.split(text, "\n")
    whole = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(whole).alias("_at", "line")).select(*rest, (F.col("_at") + 1).alias("line_no"), "line")


def segment(lines: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """Blocks of lines, each from a line that starts one to the line before the next: keys, block, first_line, last_line, block_text."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("block > 0")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return marked.groupBy(*keys, "block").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("block_text"),
    )


def excerpt_hash(lines: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """SHA-256 of the lines first_line to last_line of each range; a range without lines gives no row."""
    inside = lines.join(ranges, key).filter(F.col("line_no").between(F.col("first_line"), F.col("last_line")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    out = inside.groupBy(*ranges.columns).agg(F.transform(ordered, lambda x: x["line"]).alias("_l"))
    return out.select(key, F.sha2(F.array_join("_l", "\n"), 256).alias("excerpt_sha256"), F.size("_l").alias("n_lines"))
