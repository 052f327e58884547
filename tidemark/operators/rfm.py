"""RFM segmentation.

Scores are 1-5. Recency and monetary use quintile bins of the value
distribution (right-closed bins on linearly interpolated quintiles, recency
inverted so recent = 5). When two quintile edges coincide the bins are
undefined and the scorer falls back to the average percent-rank of each value
cut into five equal-width bins of the observed rank range. Frequency uses
fixed order-count tiers.

Quintile edges are five numbers; they are computed exactly but distributed
(:mod:`tidemark.functions.quantiles`) and then applied as literals in a
map-only scoring pass — no window over the whole customer base, no ``ntile``
(which splits ties and disagrees with value quintiles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.core import grand_total, rnd, rnd_double
from ..functions.quantiles import average_pct_rank, exact_quantiles_of

QUINTILE_PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def rfm_input(mart_customer_metrics: DataFrame) -> DataFrame:
    return (mart_customer_metrics
            .select("customer_unique_id", "recency_days",
                    F.col("lifetime_orders").alias("frequency"),
                    F.col("lifetime_spend").alias("monetary"))
            .where(F.col("recency_days").isNotNull() & F.col("monetary").isNotNull()
                   & F.col("frequency").isNotNull()))


def _edge_bins(x: Column, edges: list[float], ascending: bool) -> Column:
    q1, q2, q3, q4 = edges[1:5]
    if ascending:
        return (F.when(x <= q1, 1).when(x <= q2, 2).when(x <= q3, 3).when(x <= q4, 4).otherwise(5)).cast("int")
    return (F.when(x >= q4, 1).when(x >= q3, 2).when(x >= q2, 3).when(x >= q1, 4).otherwise(5)).cast("int")


def _rank_bins(pct: Column, lo: float, hi: float) -> Column:
    # five equal-width bins over [lo, hi], right-closed, first bin closed.
    step = (hi - lo) / 5
    if step == 0:
        return F.lit(3)
    e = [k * step + lo for k in range(1, 5)]
    return (F.when(pct <= e[0], 1).when(pct <= e[1], 2).when(pct <= e[2], 3)
            .when(pct <= e[3], 4).otherwise(5)).cast("int")


def quintile_score(df: DataFrame, col: str, out: str, ascending: bool = True, edges: list[float | None] | None = None) -> DataFrame:
    """Add ``out`` = 1..5 quintile score of ``col`` to ``df``; ``edges`` are its quintiles, if known."""
    edges = edges or exact_quantiles_of(df, [col], QUINTILE_PROBS)[col]
    if edges[0] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    x = F.col(col).cast("double")
    if len(set(edges)) == len(edges):
        return df.withColumn(out, _edge_bins(x, edges, ascending))
    # Fallback: average percent-rank, 5 equal-width bins of its observed range.
    n = df.where(F.col(col).isNotNull()).count()
    ranks = average_pct_rank(df, col, n)
    if not ascending:
        ranks = ranks.withColumn("pct", 1.0 - F.col("pct"))
    lo_hi = ranks.agg(F.min("pct").alias("lo"), F.max("pct").alias("hi")).first()
    lo, hi = lo_hi["lo"], lo_hi["hi"]
    if lo == hi:
        scored = ranks.select(col, F.lit(3).alias(out))
    else:
        # bins of pd.cut: the first edge is widened by 0.1% of the range.
        scored = ranks.select(col, _rank_bins(F.col("pct"), lo, hi).alias(out))
    # ranks rise with the value, so every score holds one range of values: a when-chain, no join on tied values
    ranges = scored.groupBy(out).agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()  # at most 5 rows
    score = F.coalesce(*[F.when(x.between(F.lit(r["lo"]), F.lit(r["hi"])), F.lit(r[out])) for r in ranges])
    return df.withColumn(out, score)


def rfm_scores(mart_customer_metrics: DataFrame) -> DataFrame:
    base = rfm_input(mart_customer_metrics)
    edges = exact_quantiles_of(base, ["recency_days", "monetary"], QUINTILE_PROBS)
    scored = quintile_score(base, "recency_days", "r_score", ascending=False, edges=edges["recency_days"])
    scored = quintile_score(scored, "monetary", "m_score", ascending=True, edges=edges["monetary"])
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (scored.withColumn("f_score", rules.frequency_score(F.col("frequency")))
            .withColumn("rfm_score", rnd((r + f + m) / 3.0, 2).cast("double"))
            .withColumn("rfm_label", F.concat(r.cast("string"), f.cast("string"), m.cast("string")))
            .withColumn("segment", rules.segment(r, f, m))
            .select("customer_unique_id", "recency_days", "frequency",
                    F.col("monetary").cast("decimal(14,2)").alias("monetary"),
                    F.col("r_score").cast("short").alias("r_score"),
                    F.col("f_score").cast("short").alias("f_score"),
                    F.col("m_score").cast("short").alias("m_score"),
                    "rfm_score", "rfm_label", "segment"))


def rfm_summary(rfm_segments: DataFrame) -> DataFrame:
    """Per segment: customers, mean recency / frequency / monetary / score, % of base (1 dp)."""
    return (rfm_segments.groupBy("segment")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.avg("recency_days").alias("avg_recency_days"),
                 F.avg("frequency").alias("avg_frequency"),
                 F.avg(F.col("monetary").cast("double")).alias("avg_monetary"),
                 F.avg("rfm_score").alias("avg_rfm_score"))
            .withColumn("_total", grand_total("customers"))
            .select("segment", "customers",
                    rnd_double(F.col("avg_recency_days"), 2).alias("avg_recency_days"),
                    rnd_double(F.col("avg_frequency"), 2).alias("avg_frequency"),
                    rnd_double(F.col("avg_monetary"), 2).alias("avg_monetary"),
                    rnd_double(F.col("avg_rfm_score"), 2).alias("avg_rfm_score"),
                    rnd_double(F.col("customers") / F.col("_total") * 100.0, 1).alias("pct_of_base"))
            .orderBy(F.desc("customers"), "segment"))
