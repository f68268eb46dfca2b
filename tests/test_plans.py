"""Physical-plan checks: what must not appear at scale."""

import pytest

from conftest import SF_SMALL
from orchard.plans.queries import QUERIES

SKIP_PREFIX = ("forest", "loop", "lal_one", "quality", "label_encoded", "gain_regressor", "round_log")
PLANNED = sorted(n for n in QUERIES if not n.startswith(SKIP_PREFIX))


def _plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_or_nested_loop_or_row_python(spark, name):
    plan = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["select_uncertain", "select_density", "committee_votes",
                                  "fetch_unlabeled", "density_linear"])
def test_pool_path_has_no_hash_shuffle(spark, name):
    plan = _plan(spark, name)
    # the only hash shuffle allowed is the per-dimension sum of the density
    # reference total (d groups), inside a scalar subquery
    main = plan.split("Subquery")[0]
    assert "Exchange hashpartitioning" not in main, name


def test_top_k_is_take_ordered(spark):
    plan = _plan(spark, "select_uncertain")
    assert "TakeOrderedAndProject(limit=20" in plan
    assert "Sort [" not in plan.split("TakeOrderedAndProject")[1]


def test_per_class_pick_is_an_aggregate_not_a_window(spark):
    for name in ("one_random_per_class", "start_one_per_class"):
        plan = _plan(spark, name)
        assert "Window" not in plan, name
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name
    # no exchange of the pool by id: only the few picks meet by id
    assert "LeftAnti" not in _plan(spark, "start_one_per_class")


@pytest.mark.parametrize("name", ["accuracy", "test_error", "misclassified", "mse", "confusion"])
def test_evaluation_is_one_projection(spark, name):
    plan = _plan(spark, name)
    assert "Exchange hashpartitioning" not in plan and "Join" not in plan, name


def test_shared_dictionary_reads_its_table_once(spark):
    from orchard.operators import prep
    df = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    firsts = prep.shared_label_encode(df, ["p_brand", "p_type"])
    # the dictionary is checkpointed: what is left is the one scan that is encoded
    assert firsts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
