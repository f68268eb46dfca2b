"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query is executed in full with the ``noop`` sink (no collect), after a
warm-up pass on the smallest data set so JVM start-up is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orchard.plans.queries import QUERIES  # noqa: E402
from orchard.session import build_session, ensure_checkpoint_dir  # noqa: E402

HEADLINE = [
    "select_uncertain",
    "select_density",
    "density_linear",
    "lal_state",
    "select_lal_linear",
    "cosine_full",
    "standard_scale",
    "random_permutation",
    "shared_label_encode",
    "sorted_ints",
    "auc",
    "loop_random",
    "forest_accuracy",
    "loop_uncertain_forest",
    "loop_uncertain_orders_forest",
    "lal_one_selection",
]
WARMUP_SF = "/root/testdata/sf0.001"


def lal_phases(spark, sf, num_trees=50):
    """One LAL selection split into the phases the baseline reports
    (pool with one labelled row per class, a 50-tree committee)."""
    from pyspark.sql import functions as F
    from orchard.operators import committee, lal, pool
    from orchard.session import cut_lineage
    from orchard.sources import tables
    t = {}
    pts = tables.embedding_points(spark, sf)
    pool_points, _ = tables.train_test(pts)
    start = pool.start_one_per_class(pool_points, 2, 1)
    labeled = cut_lineage(pool.fetch_labeled(pool_points, start, 2))
    unlabeled = pool.fetch_unlabeled(pool_points, start, 2)
    t0 = time.time()
    model = committee.fit_forest(labeled, num_trees, 1)
    t["lal_phase_fit_forest"] = time.time() - t0
    t0 = time.time()
    standin = lal.gain_training_standin(committee.forest_vote_arrays(model, labeled), labeled)
    regressor = lal.fit_gain_regressor(standin, num_trees=10, seed=1)
    t["lal_phase_fit_regressor"] = time.time() - t0
    t0 = time.time()
    state = lal.lal_state(committee.forest_vote_arrays(model, unlabeled), labeled)
    t["lal_phase_votes_and_features"] = time.time() - t0
    t0 = time.time()
    lal.select_lal(state, regressor, 1).select(F.col("id")).collect()
    t["lal_phase_predict_and_pick"] = time.time() - t0
    return t


def run(spark, name, sf):
    t0 = time.time()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ensure_checkpoint_dir(spark)
    for name in ("select_uncertain", "density_linear", "forest_accuracy"):
        run(spark, name, WARMUP_SF)
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf), 3)
    if len(sys.argv) == 1:
        times.update({k: round(v, 3) for k, v in lal_phases(spark, sf).items()})
    m = re.search(r"sf([0-9.]+)", sf)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
