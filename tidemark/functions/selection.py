"""Exact order statistics of many series at once, by narrowing value histograms.

A target is a rank within a series; its bracket [lo, hi] starts as the series' whole range. A round is one
pass over the rows: those inside a bracket are counted by bin (the two ends have bins of their own, the rest
are of equal width), with each bin's smallest and largest value. The bin that holds the rank becomes the next
bracket, trimmed to those values. A bracket of one value is the answer, however many rows tie on it; once few rows
are left in every bracket, one last pass brings their distinct values. A round always takes the two end values out, and
commonly all but a thousandth of the rows, so no value, rank or row is ever estimated, capped or gathered in one buffer.

What reaches the driver is bounded: BINS counts in all per round, FEW values at the end, and one row per
series, so series are columns or pools, not keys of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 16_384
FEW = 65_536
#: Bins of a bracket, whatever their total.
LEAST_BINS, MOST_BINS = 8, 1024


@dataclass(frozen=True)
class Bracket:
    """Values [lo, hi] of a series, and how many of its values are below."""

    series: object
    lo: float
    hi: float
    below: int
    rows: int


def series_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, x) pairs of numeric columns, the series being the column's name; nulls and NaN are missing."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns])
    return present(df.select(F.inline(pairs)))


def present(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("x").isNotNull() & ~F.isnan("x"))


def _inside(pairs: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(b, lo, hi, x) of the rows inside each bracket, b being its place in the list."""
    by_series: dict[object, list[Column]] = {}
    for i, b in enumerate(brackets):
        by_series.setdefault(b.series, []).append(F.struct(
            F.lit(i).alias("b"), F.lit(float(b.lo)).alias("lo"), F.lit(float(b.hi)).alias("hi")))
    known = F.create_map(*[c for s, items in by_series.items() for c in (F.lit(s), F.array(*items))])
    hit = F.filter(F.try_element_at(known, F.col("series")), lambda b: F.col("x").between(b["lo"], b["hi"]))
    return pairs.select("x", F.inline(hit))


def _bin(bins: int) -> Column:
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    place = (x / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    inner = F.greatest(F.lit(1), F.least(F.lit(bins - 2), F.floor(F.nanvl(F.coalesce(place, F.lit(0.0)), F.lit(0.0)) * bins).cast("int")))
    return F.when(x == lo, 0).when(x == hi, bins - 1).otherwise(inner)


def _narrowed(bracket: Bracket, rank: int, bins: list[tuple[int, int, float, float]]) -> Bracket:
    below = bracket.below
    for _, n, lo, hi in sorted(bins):
        if rank < below + n:
            return Bracket(bracket.series, lo, hi, below, n)
        below += n
    raise AssertionError("a bracket holds its rank")


def series_sizes(pairs: DataFrame) -> dict[object, Bracket]:
    """The whole range and number of rows of every series."""
    rows = pairs.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    return {r["series"]: Bracket(r["series"], r["lo"], r["hi"], 0, r["n"]) for r in rows}


def select_ranks(pairs: DataFrame, ranks: dict[object, list[int]], whole: dict[object, Bracket] | None = None,
                 few: int = FEW, most_bins: int = MOST_BINS) -> dict[tuple[object, int], float]:
    """The values at 0-based ascending ``ranks`` of every series of ``pairs`` (columns series, x; none missing).

    Ranks outside a series have no entry in the result.
    """
    whole = whole or series_sizes(pairs)
    at = {(s, r): whole[s] for s, wanted in ranks.items() if s in whole for r in wanted if 0 <= r < whole[s].rows}
    out = {}
    while True:
        for t in [t for t, b in at.items() if b.lo == b.hi]:
            out[t] = at.pop(t).lo
        if not at:
            return out
        brackets = sorted(set(at.values()), key=lambda b: (str(b.series), b.lo))
        place = {b: i for i, b in enumerate(brackets)}
        last = sum(b.rows for b in brackets) <= few
        inside = _inside(pairs, brackets)
        bins = max(LEAST_BINS, min(most_bins, BINS // len(brackets)))
        keyed = inside.groupBy("b", F.col("x").alias("bin")) if last else inside.groupBy("b", _bin(bins).alias("bin"))
        found: dict[int, list] = {}
        for b, k, n, lo, hi in keyed.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect():
            found.setdefault(b, []).append((k, n, lo, hi))
        at = {t: _narrowed(b, t[1], found[place[b]]) for t, b in at.items()}
