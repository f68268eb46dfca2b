"""Write PLANS.md: physical plans of the headline queries and a plan census.

usage: python tools/explain_plans.py [sf_dir]  (default /root/testdata/sf0.1)

For every registered query that builds a plan without running a forest, the
census lists the shuffle exchanges and flags operators that matter at scale
(single-partition exchanges, cartesian products, nested-loop joins, Python
evaluation, windows).  Single-partition exchanges are expected only after a
partial aggregate (one row per task) or over tables bounded by the partition
count, k, or the feature width; the notes column says which.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orchard.plans.queries import QUERIES  # noqa: E402
from orchard.session import build_session, ensure_checkpoint_dir  # noqa: E402

SHOWN = ["select_uncertain", "select_density", "lal_state", "density_linear", "cosine_full",
         "row_identity"]
SKIP_PREFIX = ("forest", "loop", "lal_one", "quality", "label_encoded")
FLAGS = ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
         "ArrowEvalPython", "FlatMapCoGroupsInPandas", "MapInPandas", "Window")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(shuffle_partitions=16)
    ensure_checkpoint_dir(spark)
    out = ["# PLANS — physical plans at " + os.path.basename(sf.rstrip("/")), "",
           "Generated by `tools/explain_plans.py`. Exchanges = shuffle exchanges in the final plan",
           "(broadcast exchanges are counted separately).", "",
           "| query | shuffles | broadcasts | flags |", "| --- | --- | --- | --- |"]
    plans = {}
    for name, fn in QUERIES.items():
        if name.startswith(SKIP_PREFIX):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans[name] = df
        shuffles = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") \
            + plan.count("Exchange SinglePartition") + plan.count("Exchange RoundRobin")
        bcast = plan.count("BroadcastExchange")
        flags = ", ".join(f for f in FLAGS if f in plan)
        out.append(f"| {name} | {shuffles} | {bcast} | {flags} |")
    for name in SHOWN:
        out += ["", f"## {name}", "", "```"]
        out.append(plans[name]._jdf.queryExecution().executedPlan().toString().rstrip())
        out += ["```"]
    with open("PLANS.md", "w") as fh:
        fh.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
