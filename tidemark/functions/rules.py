"""Business rules as column expressions (``when`` chains — no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import rnd

# Segment names, risk tiers and retention priorities written by the scorers.
SEG_CHAMPIONS = "Champions"
SEG_LOYAL = "Loyal Customers"
SEG_POTENTIAL = "Potential Loyalists"
SEG_NEW = "New Customers"
SEG_AT_RISK = "At Risk"
SEG_LOST = "Lost / Inactive"
SEG_OTHERS = "Others"
SEGMENTS = [SEG_CHAMPIONS, SEG_LOYAL, SEG_POTENTIAL, SEG_NEW, SEG_AT_RISK, SEG_LOST, SEG_OTHERS]

TIER_HIGH, TIER_MEDIUM, TIER_LOW = "High", "Medium", "Low"
TIERS = [TIER_HIGH, TIER_MEDIUM, TIER_LOW]

PRIORITY_VIP = "Priority 1: Immediate VIP Retention"
PRIORITY_LOYALTY = "Priority 2: Loyalty & Nurture"
PRIORITY_REENGAGEMENT = "Priority 3: Automated Re-engagement"
PRIORITY_STANDARD = "Priority 4: Standard Operations"
PRIORITY_MEDIUM = "Medium Priority"

# The CSV export's action texts and the two priority labels it
# tests. Those labels differ from the ones the scorer writes, so on scorer
# output the two branches never fire; ``strict_labels=True`` matches the
# scorer's labels instead.
ACTION_PRIORITY_2_LABEL = "Priority 2: Loyalty & Proactive Nurture"
ACTION_PRIORITY_3_LABEL = "Priority 3: Automated Winback & Re-engagement"
ACTION_VIP = "Dedicated account manager outreach and VIP incentive"
ACTION_LOYALTY = "Personalized loyalty rewards and product recommendations"
ACTION_WINBACK = "Automated email coupon sequence and survey"
ACTION_HIGH = "Reactivation discount and feedback request"
ACTION_MEDIUM = "Feature newsletter and gentle re-engagement"
ACTION_DEFAULT = "Standard operational messaging and ongoing nurture"


def frequency_score(orders: Column) -> Column:
    """Order-count tiers: 1 -> 1, 2 -> 3, 3-4 -> 4, 5+ -> 5 (2 is never produced)."""
    return (F.when(orders >= 5, 5).when(orders >= 3, 4).when(orders == 2, 3).otherwise(1)).cast("int")


def segment(r: Column, f: Column, m: Column) -> Column:
    """Priority-ordered RFM segment rules."""
    return (F.when((r >= 4) & (m >= 4), SEG_CHAMPIONS)
            .when((f >= 3) & (r >= 3) & (m >= 3), SEG_LOYAL)
            .when((r >= 4) & (m >= 3) & (f <= 2), SEG_POTENTIAL)
            .when((r >= 4) & (m <= 2), SEG_NEW)
            .when((r <= 2) & (m >= 4), SEG_AT_RISK)
            .when((r <= 2) & (m <= 2), SEG_LOST)
            .otherwise(SEG_OTHERS))


def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.70, TIER_HIGH).when(p >= 0.30, TIER_MEDIUM).otherwise(TIER_LOW)


def retention_priority(p: Column, m_score: Column) -> Column:
    return (F.when((p >= 0.70) & (m_score >= 4), PRIORITY_VIP)
            .when((p < 0.30) & (m_score >= 4), PRIORITY_LOYALTY)
            .when((p >= 0.70) & (m_score <= 2), PRIORITY_REENGAGEMENT)
            .when((p < 0.30) & (m_score <= 2), PRIORITY_STANDARD)
            .otherwise(PRIORITY_MEDIUM))


def revenue_at_risk(p: Column, monetary: Column) -> Column:
    """round(p × spend, 2), half away from zero on the decimal value."""
    return rnd(p.cast("double") * monetary.cast("double"), 2).cast("double")


def estimate_m_score(spend: Column) -> Column:
    """Monetary score for a profile without RFM scores."""
    return (F.when(spend >= 400, 5).when(spend >= 200, 4).when(spend >= 100, 3)
            .when(spend >= 50, 2).otherwise(1)).cast("int")


def recommended_action(priority: Column, tier: Column, strict_labels: bool = False) -> Column:
    """CRM action text. With ``strict_labels`` the priority-2/3 branches match the scorer's labels."""
    p2 = PRIORITY_LOYALTY if strict_labels else ACTION_PRIORITY_2_LABEL
    p3 = PRIORITY_REENGAGEMENT if strict_labels else ACTION_PRIORITY_3_LABEL
    return (F.when(priority == PRIORITY_VIP, ACTION_VIP)
            .when(priority == p2, ACTION_LOYALTY)
            .when(priority == p3, ACTION_WINBACK)
            .when(tier == TIER_HIGH, ACTION_HIGH)
            .when(tier == TIER_MEDIUM, ACTION_MEDIUM)
            .otherwise(ACTION_DEFAULT))
