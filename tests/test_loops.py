
import pytest

from conftest import SF_SMALL
from orchard.operators import committee, pool, select, similarity
from orchard.plans import jobs, loop
from orchard.sources import tables


@pytest.fixture(scope="module")
def pts(spark):
    return tables.embedding_points(spark, SF_SMALL).cache()


def test_forest_votes_shape(spark, pts):
    model = committee.fit_forest(pts.where("id < 60"), num_trees=5, seed=3)
    arrays = committee.forest_vote_arrays(model, pts)
    rows = arrays.select("id", "votes").collect()
    assert len(rows) == pts.count()
    assert all(len(r.votes) == 5 and set(r.votes) <= {0.0, 1.0} for r in rows)
    long = committee.forest_votes(model, pts)
    assert long.count() == 5 * pts.count()
    a = {r.id: r.sum_votes for r in committee.vote_stats(long).collect()}
    b = {r.id: r.sum_votes for r in committee.row_vote_stats(arrays).collect()}
    assert a == b


@pytest.mark.parametrize("kind", ["uncertainty", "density", "random"])
def test_forest_loop_invariants(spark, pts, kind):
    pool_points, test = tables.train_test(pts)
    start = pool.start_one_per_class(pool_points, 6, 1)
    if kind == "uncertainty":
        strat = loop.uncertainty_strategy()
    elif kind == "density":
        strat = loop.density_strategy(similarity.reference_total(
            pool.fetch_unlabeled(pool_points, start, 6)))
    else:
        strat = loop.random_strategy(1)
    res = loop.run_loop(spark, pool_points, start, 6, strat, 7, test=test, max_rounds=2,
                        fit_committee=True, num_trees=4, seed=1)
    hist = res.history.orderBy("iteration").collect()
    n_pool = pool_points.count()
    assert [h.n_labeled for h in hist] == [6, 13, 20]
    assert all(h.n_labeled + h.n_unlabeled == n_pool for h in hist)
    assert all(0.0 <= h.accuracy <= 1.0 for h in hist)
    lab = res.labeled.collect()
    assert len({r.id for r in lab}) == len(lab) == 20
    batches = res.batches.collect()
    assert sorted((b.iteration, b.rank) for b in batches) == [(i, r) for i in (1, 2) for r in range(1, 8)]
    # known and unknown partition the pool
    unl = pool.fetch_unlabeled(pool_points, res.labeled, 20)
    assert unl.count() + len(lab) == n_pool
    again = loop.run_loop(spark, pool_points, start, 6, strat, 7, test=test, max_rounds=2,
                          fit_committee=True, num_trees=4, seed=1)
    assert sorted(r.id for r in again.batches.collect()) == sorted(b.id for b in batches)


def test_density_total_and_table_agree(spark, pts):
    unl = pts.where("id >= 20")
    arrays = committee.stump_vote_arrays(unl, 10)
    total = similarity.reference_total(unl)
    table = similarity.density_linear(pts, reference=unl)
    a = [(r.id, round(r.score, 9)) for r in select.select_density(arrays, total, 15).collect()]
    b = [(r.id, round(r.score, 9)) for r in select.select_density(arrays, table, 15).collect()]
    assert a == b


def test_carry_columns_ride_with_winners(spark, pts):
    arrays = committee.stump_vote_arrays(pts, 10)
    batch = select.select_uncertain(arrays, 5, carry=("features", "label")).collect()
    feats = {r.id: r.features for r in pts.collect()}
    assert all(feats[r.id] == r.features for r in batch)


def test_lal_loop_runs_until_the_pool_is_empty(spark, pts):
    hist = jobs.forest_loop(spark, pts, "lal", rounds=2).orderBy("iteration").collect()
    n = tables.train_test(pts)[0].count()
    k = -(-(n - 10) // 2)
    assert [h.n_labeled for h in hist] == [10, 10 + k, n]
    assert hist[-1].n_unlabeled == 0


def test_one_lal_selection(spark, pts):
    rows = jobs.lal_one_selection(spark, pts, num_trees=5).collect()
    assert len(rows) == 1 and rows[0]["rank"] == 1


def test_point_views_have_the_point_schema(spark):
    for view in (tables.embedding_points, tables.document_points, tables.order_points):
        df = view(spark, SF_SMALL)
        assert df.dtypes == [("id", "bigint"), ("features", "array<double>"), ("label", "double")]
        row = df.first()
        assert set(df.select("label").distinct().toPandas()["label"]) <= {0.0, 1.0}
        assert len(row.features) > 0
    assert tables.embedding_points(spark, SF_SMALL).select("id").distinct().count() == \
        tables.embedding_points(spark, SF_SMALL).count()
