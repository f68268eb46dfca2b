"""Distributed selection: the k smallest rows without one task for them."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from orchard.operators import select
from orchard.plans.queries import QUERIES


def _scores(spark, n=20_000, distinct=None):
    score = F.rand(3) if distinct is None else (F.xxhash64("id") % distinct).cast("double")
    return spark.range(n).select("id", score.alias("score")).repartition(16)


@pytest.mark.parametrize("k", [0, 1, 7, 1000, 6000, 20_000, 30_000])
@pytest.mark.parametrize("distinct", [None, 1, 3])
def test_share_gives_the_rows_of_the_top_k(spark, k, distinct):
    scores = _scores(spark, distinct=distinct)
    for descending in (False, True):
        got = select.top_k(scores, k, descending=descending, share=True).orderBy("rank").collect()
        want = select.top_k(scores, k, descending=descending).orderBy("rank").collect()
        assert [(r["rank"], r["id"], r["score"]) for r in got] == [(r["rank"], r["id"], r["score"]) for r in want]


def test_random_share_follows_the_md5_keys(spark):
    ids = spark.range(5000)
    for k in (3, 400, 5000):
        got = select.select_random(ids, k, 9, share=True).orderBy("rank").collect()
        assert got == select.select_random(ids, k, 9).orderBy("rank").collect()


def test_undefined_scores_come_last(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, -0.0), (5, 0.0)], "id long, score double")
    assert [r["id"] for r in select.top_k(rows, 5, share=True).orderBy("rank").collect()] == [4, 5, 3, 1, 2]
    assert [r["id"] for r in select.top_k(rows, 3, descending=True, share=True).orderBy("rank").collect()] == [3, 4, 5]


def test_cut_off_keeps_few_rows_beyond_k(spark):
    rows = _scores(spark, 100_000).select("id", F.col("score").alias("_c")).withColumn("_i", F.col("id").cast("double"))
    kept = rows.where(select.cut_off(rows, ("_c", "_i"), 500))
    assert 500 <= kept.count() <= 4 * 500
    ties = rows.withColumn("_c", F.lit(1.0))
    kept = ties.where(select.cut_off(ties, ("_c", "_i"), 500))
    assert 500 <= kept.count() <= 4 * 500 and kept.agg(F.min("id")).first()[0] == 0


LOOPS = ["loop_random", "loop_uncertain_fixed_committee", "loop_density_fixed_committee",
         "loop_lal_linear_fixed_committee", "loop_separable_batches", "loop_uncertain_forest"]


@pytest.mark.parametrize("name", LOOPS)
def test_no_batch_of_a_loop_passes_one_task(spark, name, monkeypatch):
    """Every batch's plan, as the loop writes it."""
    from orchard.plans import loop
    plans, writer = [], loop.pool.bounded_side

    def seen(df, bound, *args):
        if "rank" in df.columns and df.columns == ["id", "rank"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return writer(df, bound, *args)

    monkeypatch.setattr(loop.pool, "bounded_side", seen)
    QUERIES[name](spark, SF_SMALL)
    assert plans
    for plan in plans:
        for bad in ("TakeOrderedAndProject", "GlobalLimit", "CollectLimit"):
            assert bad not in plan
        # the one ordering without keys is over a row per range (the offsets)
        assert plan.count("Exchange SinglePartition") <= 1
