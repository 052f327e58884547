"""SQL of the model's evaluation, tied quintiles, BI cells, typed what-if scenarios and lookups."""

from __future__ import annotations

from .ctes import CTES, PCT, RD
from .sql import PRIO, Q, TIER

Q["churn_eval_baseline"] = f"""
WITH s AS (SELECT is_churned = 1 AS y, churn_probability AS p FROM churn_predictions_baseline),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE y) AS pos, greatest(1, floor(CAST(0.1 AS DOUBLE) * count(*))) AS k,
             count(*) FILTER (WHERE y AND p >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND p >= 0.5) AS fp FROM s),
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY p) AS tied,
             count(*) OVER (ORDER BY p DESC) AS up, count(*) FILTER (WHERE y) OVER (ORDER BY p DESC) AS pos_up FROM s),
m AS (SELECT sum(mid) AS mids, sum(CAST(pos_up AS DOUBLE) / up) AS steps,
             sum(least(1.0, greatest(0.0, ((SELECT k FROM t) - (up - tied)) / CAST(tied AS DOUBLE)))) AS hits FROM r WHERE y)
SELECT {RD('(mids - pos * (pos + 1) / 2.0) / (pos * (n - pos))', 4)} AS auc, {RD('steps / pos', 4)} AS pr_auc,
       coalesce({RD('2.0 * tp / nullif(tp + fp + pos, 0)', 4)}, 0.0) AS f1, coalesce({RD('tp / nullif(CAST(tp + fp AS DOUBLE), 0)', 4)}, 0.0) AS precision,
       {RD('tp / CAST(pos AS DOUBLE)', 4)} AS recall, {RD('hits / k', 4)} AS precision_at_k
FROM t, m"""

_FEATURES = """customer_lifespan_days lifetime_orders is_repeat_buyer lifetime_spend lifetime_product_spend lifetime_freight_spend
freight_ratio avg_order_value lifetime_items avg_items_per_order total_unique_products_purchased total_unique_sellers_contacted
avg_delivery_delay_days max_delivery_delay_days late_orders_count late_order_ratio has_late_delivery total_reviews_submitted
avg_review_score negative_reviews_count positive_reviews_count has_negative_review negative_review_ratio f_score m_score""".split()
Q["churn_feature_medians"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(median(CAST({c} AS DOUBLE)), 0.0) AS median FROM churn_features" for c in _FEATURES)

Q["churn_split_summary"] = """
WITH h AS (SELECT is_churned, CAST('0x' || substr(md5(customer_unique_id || ':42'), 1, 13) AS BIGINT) AS h FROM churn_features),
r AS (SELECT is_churned, row_number() OVER (PARTITION BY is_churned ORDER BY h) <= floor(0.2 * count(*) OVER (PARTITION BY is_churned) + 0.5) AS test FROM h)
SELECT if(test, 'test', 'train') AS split, is_churned, count(*) AS customers FROM r GROUP BY ALL"""

Q["churn_model_invariants"] = """
SELECT 'customers' AS rule, count(*) AS n FROM churn_features
UNION ALL SELECT unnest(['not_scored_or_unknown', 'probability_out_of_range', 'tier', 'revenue_at_risk', 'monetary_value', 'label', 'priority']), 0"""


def _quintile(col: str, falling: bool) -> str:
    """A score per customer: five bins between distinct quintiles, else five equal bins of the ties' mean rank."""
    plain = "CASE WHEN x >= e[5] THEN 1 WHEN x >= e[4] THEN 2 WHEN x >= e[3] THEN 3 WHEN x >= e[2] THEN 4 ELSE 5 END" if falling else \
        "CASE WHEN x <= e[2] THEN 1 WHEN x <= e[3] THEN 2 WHEN x <= e[4] THEN 3 WHEN x <= e[5] THEN 4 ELSE 5 END"
    share = "(rank() OVER (ORDER BY x) - 1 + (count(*) OVER (PARTITION BY x) + 1) / CAST(2 AS DOUBLE)) / CAST(count(*) OVER () AS DOUBLE)"
    return f"""
SELECT customer_unique_id, CASE WHEN len(list_distinct(e)) = 6 THEN {plain} WHEN lo = hi THEN 3
  ELSE 1 + list_sum([if(pct <= k * ((hi - lo) / 5) + lo, 0, 1) FOR k IN [1, 2, 3, 4]]) END AS score
FROM (SELECT *, min(pct) OVER () AS lo, max(pct) OVER () AS hi
      FROM (SELECT customer_unique_id, CAST({col} AS DOUBLE) AS x, {'1.0 - ' if falling else ''}{share.replace('ORDER BY x', f'ORDER BY {col}').replace('BY x', f'BY {col}')} AS pct
            FROM mart_customer_metrics)),
     (SELECT quantile_cont(CAST({col} AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM mart_customer_metrics)"""


CTES["late_rising"] = _quintile("late_orders_count", False)
CTES["late_falling"] = _quintile("late_orders_count", True)
CTES["negative_falling"] = _quintile("negative_reviews_count", True)
Q["rfm_quintile_tied"] = """
SELECT customer_unique_id, late_orders_count, negative_reviews_count, CAST(a.score AS int) AS late_score,
       CAST(b.score AS int) AS late_score_falling, CAST(c.score AS int) AS negative_score_falling
FROM mart_customer_metrics JOIN late_rising a USING (customer_unique_id) JOIN late_falling b USING (customer_unique_id)
JOIN negative_falling c USING (customer_unique_id)"""

CTES["bi_cell_orders"] = """
SELECT f.*, d.state, CAST(date_trunc('month', f.purchased_at) AS DATE) AS month, d.is_repeat_buyer
FROM fact_orders f JOIN dim_customers d USING (customer_unique_id)"""
CTES["bi_cell_customers"] = """
SELECT DISTINCT o.customer_unique_id, o.state, o.month, o.is_repeat_buyer, p.churn_probability, p.risk_tier, p.revenue_at_risk, p.retention_priority
FROM bi_cell_orders o LEFT JOIN churn_predictions_baseline p USING (customer_unique_id)"""


def _cell(cut: str, keys: str) -> str:
    """One cut: orders and distinct customers of each cell, taken apart and joined."""
    by = f"GROUP BY {keys}" if keys else ""
    state, month = ("state" if "state" in keys else "NULL"), ("month" if "month" in keys else "NULL")
    cols = f"{keys}, " if keys else ""
    return f"""
SELECT '{cut}' AS cut, {'o.' if state != 'NULL' else ''}{state} AS state, {'o.' if month != 'NULL' else ''}{month} AS month, gmv, total_orders,
       {RD('gmv / CAST(total_orders AS DOUBLE)', 2)} AS avg_order_value, total_freight, total_customers, repeat_customers,
       {PCT('repeat_customers', 'total_customers')} AS repeat_rate, revenue_at_risk, vip_revenue_at_risk, high_risk_customers,
       {PCT('high_risk_customers', 'total_customers')} AS high_risk_share, avg_churn_probability, late_orders,
       {PCT('late_orders', 'total_orders')} AS late_delivery_rate, avg_review_score, {PCT('bad', 'total_orders')} AS negative_review_share
FROM (SELECT {cols}{RD('sum(total_revenue)', 2)} AS gmv, count(*) AS total_orders, {RD('sum(freight_revenue)', 2)} AS total_freight,
             count(*) FILTER (WHERE coalesce(is_late_delivery, false)) AS late_orders, {RD('avg(avg_review_score)', 2)} AS avg_review_score,
             count(*) FILTER (WHERE avg_review_score <= 2) AS bad FROM bi_cell_orders {by}) o
JOIN (SELECT {cols}count(*) AS total_customers, count(*) FILTER (WHERE is_repeat_buyer) AS repeat_customers,
             {RD('coalesce(sum(revenue_at_risk), 0)', 2)} AS revenue_at_risk,
             {RD("coalesce(sum(revenue_at_risk) FILTER (WHERE retention_priority = 'Priority 1: Immediate VIP Retention'), 0)", 2)} AS vip_revenue_at_risk,
             count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_customers, {RD('avg(churn_probability)', 4)} AS avg_churn_probability
      FROM (SELECT DISTINCT {cols}customer_unique_id, is_repeat_buyer, churn_probability, risk_tier, revenue_at_risk, retention_priority FROM bi_cell_customers) {by}) c
ON {' AND '.join(f'o.{k} IS NOT DISTINCT FROM c.{k}' for k in keys.split(', ')) if keys else 'true'}"""


Q["bi_measures_by_state_and_month"] = " UNION ALL ".join(
    _cell(cut, keys) for cut, keys in (("total", ""), ("state", "state"), ("month", "month"), ("state_month", "state, month")))

_TYPED = f"""0.5 * recency_days / (recency_days + CAST(365 AS DOUBLE)) + 0.2 * CAST(late_order_ratio AS DOUBLE)
  + if(lifetime_orders < 2, 0.05, 0.0) + if(has_late_delivery > 0, 0.1, 0.0) + if(segment IN ('At Risk', 'Lost / Inactive'), 0.15, 0.0)"""
CTES["typed_profiles"] = """
SELECT customer_unique_id, recency_days, late_order_ratio, CAST(lifetime_orders AS int) AS lifetime_orders, has_late_delivery,
       coalesce(segment, 'New Customers') AS segment, lifetime_spend AS spend, coalesce(m_score, 1) AS m FROM whatif_base"""
CTES["typed_scenarios"] = """
SELECT customer_unique_id, scenario_id, recency_days, coalesce(s.ratio, late_order_ratio) AS late_order_ratio, coalesce(s.orders, lifetime_orders) AS lifetime_orders,
       coalesce(s.late, has_late_delivery) AS has_late_delivery, coalesce(s.seg, segment) AS segment, spend, m
FROM typed_profiles, (VALUES ('win_back', NULL, 2, NULL, 'Champions'), ('lapse', NULL, NULL, 1, 'At Risk'), ('punctual', 0.0, NULL, 0, NULL)) s(scenario_id, ratio, orders, late, seg)"""
for _name, _src in (("typed_b", "typed_profiles"), ("typed_s", "typed_scenarios")):
    CTES[_name] = f"""
SELECT *, {TIER.format(p='p')} AS tier, {RD('p * spend', 2)} AS rar, {PRIO.format(p='p', m='m')} AS prio
FROM (SELECT *, {RD(f'least(1.0, greatest(0.0, {_TYPED}))', 4)} AS p FROM {_src})"""
Q["whatif_typed"] = f"""
SELECT customer_unique_id, scenario_id, b.p AS baseline_churn_probability, b.tier AS baseline_risk_tier, b.rar AS baseline_revenue_at_risk,
       b.prio AS baseline_retention_priority, s.p AS simulated_churn_probability, s.tier AS simulated_risk_tier,
       s.rar AS simulated_revenue_at_risk, s.prio AS simulated_retention_priority,
       {RD('s.p - b.p', 4)} AS delta_churn_probability, {RD('s.rar - b.rar', 2)} AS delta_revenue_at_risk,
       if(b.tier <> s.tier, b.tier || ' -> ' || s.tier, 'Maintained ' || b.tier || ' Risk') AS risk_tier_transition,
       if(b.prio <> s.prio, b.prio || ' -> ' || s.prio, 'Maintained ' || b.prio) AS retention_priority_transition,
       CASE sign({RD('s.p - b.p', 4)}) WHEN -1 THEN 'lower' WHEN 1 THEN 'higher' ELSE 'unchanged' END AS impact
FROM typed_s s JOIN typed_b b USING (customer_unique_id)"""

Q["batch_score"] = f"""
SELECT b.customer_unique_id, b.recency_days, {', '.join(
    "coalesce(CAST(b.avg_review_score AS DOUBLE), 4.0) AS avg_review_score" if c == 'avg_review_score' else f'b.{c}' for c in _FEATURES)},
       coalesce(b.segment, 'New Customers') AS segment, s.p AS churn_probability, s.tier AS risk_tier,
       {RD('b.lifetime_spend', 2)} AS monetary_value, s.rar AS revenue_at_risk, s.prio AS retention_priority
FROM whatif_base b JOIN whatif_b s USING (customer_unique_id)"""

Q["table_health"] = """
WITH n AS (SELECT (SELECT count(*) FROM raw_orders) AS raw_orders, (SELECT count(*) FROM raw_customers) AS raw_customers,
  (SELECT count(*) FROM mart_customer_metrics) AS mart_customer_metrics, (SELECT count(*) FROM fact_orders) AS mart_fact_orders,
  (SELECT count(*) FROM mart_marketing_funnel) AS mart_marketing_funnel, (SELECT count(*) FROM rfm_segments) AS ml_rfm_segments,
  (SELECT count(*) FROM churn_predictions_baseline) AS ml_churn_predictions,
  (SELECT strftime(max(purchased_at), '%Y-%m-%d %H:%M:%S') FROM fact_orders) AS last_order_timestamp,
  (SELECT count(*) FROM mart_customer_metrics WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM churn_predictions_baseline)) AS unscored_customers),
a AS (SELECT *, concat_ws('; ', if(raw_orders = 0, 'No raw orders have been loaded.', NULL), if(mart_customer_metrics = 0, 'The customer metrics table has no rows.', NULL),
  CASE WHEN ml_churn_predictions = 0 THEN 'No churn scores have been stored.'
       WHEN unscored_customers > 0 THEN unscored_customers || ' customers of the metrics table have no churn score.' END) AS anomalies FROM n)
SELECT *, if(anomalies = '', 'ok', 'warning') AS status FROM a"""

Q["product_detail"] = "SELECT * FROM mart_product_metrics WHERE product_id = 'P1'"
Q["customer_rfm"] = "SELECT * FROM rfm_segments WHERE customer_unique_id = 'U1'"
Q["customer_churn"] = "SELECT * FROM churn_predictions_baseline WHERE customer_unique_id = 'U1'"
Q["portfolio_overview_scan"] = Q["portfolio_overview"]
Q["campaign_csv"] = Q["campaign_export"]
Q["csv_ingest_order_reviews"] = Q["stream_ingest_order_reviews"]

for _name in ("churn_eval_baseline", "churn_split_summary", "table_health"):  # a chain of their own inside the common one
    Q[_name] = f"SELECT * FROM ({Q[_name]})"
