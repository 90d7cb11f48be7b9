"""Vector columns: squared distance and the similarity that stands for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.exp(-distance)


def distance_of(similarity_: Column) -> Column:
    """The distance again; null unless 0 < similarity <= 1 and finite."""
    return F.when((similarity_ > 0) & (similarity_ <= 1) & ~F.isnan(similarity_), -F.ln(similarity_))
