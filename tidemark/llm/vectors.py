"""Embeddings as whole numbers: what the operators on vectors read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def scaled(vectors: DataFrame, limit: float, *extra: Column) -> DataFrame:
    """vec_id, x (floor of 256 times each entry, as long) and ``extra`` of the rows with a usable vector.

    Usable: not null, not empty, no null or non-finite entry, and no entry of ``limit`` or more in magnitude.
    Of vectors of several lengths, the most frequent length is kept (the longer of equally frequent ones).
    """
    v = vectors["embedding"].cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < limit, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    return vectors.where(usable).select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x"), *extra)


def common_length(rows: DataFrame) -> int:
    """The most frequent length of x, 0 without rows. One row reaches the driver."""
    best = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0
