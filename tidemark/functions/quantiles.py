"""Exact quantiles, prefix sums and average percent-ranks without funnelling a column through one task.

``percentile`` (exact) keeps every distinct value of a column in one aggregation buffer, and a window without
a partition sorts all rows in one task. Here order statistics come from narrowing histograms
(:mod:`tidemark.functions.selection`), and a prefix sum is cut at some of them: every chunk between two cuts holds
a bounded number of rows (or the rows tied on one value, which are one row by then) and is accumulated by itself, then shifted by the totals of
the chunks before it. The cuts are values, not partitions, so a stage that reruns deals its rows alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import present, select_ranks, series_of, series_sizes

#: Rows of a chunk of a prefix sum.
CHUNK_ROWS = 200_000


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation (stable at both ends).
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def order_statistics(df: DataFrame, col: str, ranks: list[int], few: int | None = None) -> dict[int, float]:
    """Exact values at 0-based ascending ``ranks`` of the values of ``col``."""
    got = select_ranks(series_of(df, [col]), {col: list(ranks)}, **({"few": few} if few is not None else {}))
    return {r: v for (_, r), v in got.items()}


def exact_quantiles_of(df: DataFrame, columns: list[str], probs: list[float], few: int | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of every column's values, all columns in the same passes."""
    pairs = series_of(df, columns)
    whole = series_sizes(pairs)
    place = {c: [(whole[c].rows - 1) * min(max(p, 0.0), 1.0) for p in probs] for c in columns if c in whole}
    ranks = {c: sorted({r for h in at for r in (math.floor(h), min(math.floor(h) + 1, whole[c].rows - 1))}) for c, at in place.items()}
    got = select_ranks(pairs, ranks, whole, **({"few": few} if few is not None else {}))
    return {c: [_lerp(got[c, math.floor(h)], got[c, min(math.floor(h) + 1, whole[c].rows - 1)], h - math.floor(h)) for h in place[c]]
            if c in whole else [None] * len(probs) for c in columns}


def exact_quantiles(df: DataFrame, col: str, probs: list[float], few: int | None = None) -> list[float | None]:
    """Linear-interpolated quantiles of the values of ``col`` (returns small Python values)."""
    return exact_quantiles_of(df, [col], probs, few)[col]


def chunk_of(key: Column, group: Column, cuts: dict[object, list[float]]) -> Column:
    """How many cuts of its group are below a key."""
    if not any(cuts.values()):
        return F.lit(0)
    known = F.create_map(*[c for g, at in cuts.items() for c in (F.lit(g), F.array(*[F.lit(float(v)) for v in at]).cast("array<double>"))])
    return F.coalesce(F.size(F.filter(F.try_element_at(known, group), lambda v: v < key)), F.lit(0))


def cumulative_by_key(df: DataFrame, key: str, measures: dict[str, Column], group: str | None = None,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per distinct (``group``,) numeric ``key`` ascending: each measure summed, plus ``<name>_before`` =
    sum over smaller keys (within the group). The number of groups is bounded by what the driver can hold."""
    names, gcols = list(measures), [group] if group else []
    g = F.col(group) if group else F.lit(0)
    per_key = df.where(F.col(key).isNotNull()).groupBy(*gcols, key).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    pairs = present(per_key.select(g.alias("series"), F.col(key).cast("double").alias("x")))
    whole = series_sizes(pairs)
    cuts = {s: list(range(chunk_rows - 1, b.rows - 1, chunk_rows)) for s, b in whole.items()}
    at = select_ranks(pairs, cuts, whole)
    chunked = per_key.withColumn("_chunk", chunk_of(F.col(key).cast("double"), g, {s: [at[s, r] for r in rs] for s, rs in cuts.items()}))
    w_in = Window.partitionBy(*gcols, "_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = chunked.select(*gcols, key, "_chunk", *names, *[F.coalesce(F.sum(n).over(w_in), F.lit(0)).alias(f"_i_{n}") for n in names])
    if not any(cuts.values()):  # one chunk per group: nothing comes before it
        return inner.select(*gcols, key, *names, *[F.col(f"_i_{n}").alias(f"{n}_before") for n in names])
    w_off = Window.partitionBy(*gcols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*gcols, "_chunk").agg(*[F.sum(n).alias(n) for n in names])
    offs = totals.select(*gcols, "_chunk", *[F.coalesce(F.sum(n).over(w_off), F.lit(0)).alias(f"_o_{n}") for n in names])
    return (inner.join(offs, [*gcols, "_chunk"])
            .select(*gcols, key, *names, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(f"{n}_before") for n in names]))


def average_pct_rank(df: DataFrame, col: str, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(value, pct) for every distinct value: average rank of ties / n (pandas ``rank(pct=True)``)."""
    c = cumulative_by_key(df, col, {"_c": F.lit(1)}, chunk_rows=chunk_rows)
    avg_rank = F.col("_c_before") + (F.col("_c") + 1) / 2.0
    return c.select(col, (avg_rank / float(n)).alias("pct"))
