"""Suites of runs: ablation variants, resumption, comparison and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The variants of an ablation and what each leaves out.
VARIANTS = {
    "full": {"keyword": True, "verifier": True, "refusal": True},
    "no_keyword": {"keyword": False, "verifier": True, "refusal": True},
    "no_verifier": {"keyword": True, "verifier": False, "refusal": True},
    "no_refusal": {"keyword": True, "verifier": True, "refusal": False},
}


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v.values()) for k, v in VARIANTS.items()], "variant string, keyword boolean, verifier boolean, refusal boolean")


def wanted(items: DataFrame, key: str) -> DataFrame:
    """Every item under each of the four variants."""
    return items.select(F.explode(F.array(*(F.lit(v) for v in VARIANTS))).alias("variant"), key)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys that a resumed suite has not completed yet."""
    return wanted(items, key).join(done.select("variant", key), ["variant", key], "left_anti")


def comparable(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Violations of two suites whose protocol fields differ, by variant."""
    both = a.alias("a").join(b.alias("b"), "variant", "full_outer")
    same = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    return both.select(F.lit("comparable").alias("rule_id"), F.col("variant").alias("entity_key"), F.explode(F.filter(F.array(*same), lambda x: x.isNotNull())).alias("message"))


def as_markdown(df: DataFrame, first: str, digits: int = 4) -> str:
    """A summary, one row per metric, as Markdown; what was not measured says so. All its rows are gathered: metrics are few by nature."""
    names = [c for c in df.columns if c != first]
    cell = lambda v: "unmeasured" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    rows = [f"| {r[first]} | " + " | ".join(cell(r[c]) for c in names) + " |" for r in df.orderBy(first).collect()]
    return "\n".join([f"| {first} | " + " | ".join(names) + " |", "| --- |" + " --- |" * len(names), *rows]) + "\n"


def bar_chart_svg(df: DataFrame, label: str, value: str, width: int = 480) -> str:
    """Bars of a summary, scaled by the largest value; missing values draw nothing. All its rows are gathered and drawn."""
    rows = df.select(label, F.col(value).cast("double").alias("v")).orderBy(label).collect()
    most = max([r["v"] for r in rows if r["v"]], default=0) or 1.0
    bars = [f'<text x="4" y="{18 + 24 * i}">{r[label]}</text><rect x="140" y="{6 + 24 * i}" height="16" width="{width * (r["v"] or 0) / most:.1f}"/>' for i, r in enumerate(rows)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 160}" height="{24 * len(rows) + 12}">{"".join(bars)}</svg>\n'


def scatter_svg(df: DataFrame, label: str, x: str, y: str, size: int = 320) -> str:
    """Points of a summary, both axes scaled by their largest value; a row that lacks one draws nothing."""
    rows = [r for r in df.select(label, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).orderBy(label).collect() if r["x"] is not None and r["y"] is not None]
    most = [max((r[c] for r in rows), default=0) or 1.0 for c in ("x", "y")]
    at = lambda r: (40 + size * r["x"] / most[0], 10 + size * (1 - r["y"] / most[1]))
    points = [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="4"/><text x="{a + 6:.1f}" y="{b:.1f}">{r[label]}</text>' for r in rows for a, b in [at(r)]]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size + 160}" height="{size + 40}">{"".join(points)}</svg>\n'
