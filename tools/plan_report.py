"""Physical-plan summary of every registered query, as planned for a large input.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Auto-broadcast is switched off (only size-bounded explicit hints remain) and
AQE is off, so the plan shown is the static plan a large input would get
before runtime re-planning.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans.registry import QUERIES, wh  # noqa: E402
from tidemark.session import get_session  # noqa: E402

MODEL = {"churn_predictions", "churn_scorecard", "model_info", "churn_tier_summary_model",
         "portfolio_overview_model", "batch_score_model", "churn_model_invariants"}


def summarize(plan: str) -> dict[str, int]:
    pats = {
        "scan": r"FileScan parquet|Scan parquet|Scan ExistingRDD|LocalTableScan",
        "exchange": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
        "single": r"Exchange SinglePartition",
        "smj": r"SortMergeJoin",
        "bhj": r"BroadcastHashJoin",
        "hash_agg": r"HashAggregate",
        "sort_agg": r"SortAggregate",
        "obj_agg": r"ObjectHashAggregate",
        "window": r"\bWindow \[",
        "group_limit": r"WindowGroupLimit",
        "topk": r"TakeOrderedAndProject",
        "expand": r"\bExpand \[",
    }
    return {k: len(re.findall(v, plan)) for k, v in pats.items()}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16)
    wh(spark, sf).build()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    cols = ["scan", "exchange", "single", "smj", "bhj", "hash_agg", "sort_agg", "obj_agg", "window",
            "group_limit", "topk", "expand"]
    print("# Physical plans (static, auto-broadcast off)\n")
    print("Generated by `tools/plan_report.py`. Counts of operators in each registered query's physical")
    print("plan when no table is broadcast unless a size-bounded hint asks for it and AQE is off, i.e.")
    print("the plan a large input gets before runtime re-planning. `single` counts exchanges into one")
    print("partition (only over already-aggregated rows or a one-row global aggregate); model queries")
    print("are pyspark.ml jobs and omitted.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name in sorted(set(QUERIES) - MODEL):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
