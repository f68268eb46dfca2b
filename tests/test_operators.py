"""Hand-made cases for the operators (FIXTURES.md section 4)."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from orchard.functions import columns as C
from orchard.operators import committee, evaluate, lal, pool, prep, ranking, select, similarity
from orchard.plans import loop
from orchard.sources.text import points_from_rows


def _votes(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, tree INT, vote DOUBLE")


def test_unit_vector_zero_row_stays_zero(spark):
    pts = points_from_rows(spark, [(0, [0.0, 0.0]), (1, [3.0, 4.0])])
    got = {r["id"]: r["features"] for r in similarity.unit_rows(pts).collect()}
    assert got[0] == [0.0, 0.0]
    assert got[1] == pytest.approx([0.6, 0.8])


def test_cosine_identical_and_orthogonal(spark):
    pts = points_from_rows(spark, [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [0.0, 5.0]), (1, [0.0, 0.0])])
    cos = {(r["i"], r["j"]): r["value"] for r in similarity.cosine_full(pts).collect()}
    assert len(cos) == 16
    assert cos[(0, 1)] == pytest.approx(1.0)
    assert cos[(0, 2)] == pytest.approx(0.0)
    assert cos[(3, 3)] == 0.0


@pytest.mark.parametrize("tile_rows", [1, 3, 7, 1000])
def test_tiled_products_match_numpy(spark, tile_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(23, 4))
    pts = points_from_rows(spark, [(0, list(r)) for r in x])
    full = similarity.cosine_full(pts, tile_rows=tile_rows).collect()
    upper = similarity.cosine_upper(pts, tile_rows=tile_rows).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = u @ u.T
    assert len(full) == 23 * 23 and len({(r.i, r.j) for r in full}) == 23 * 23
    for r in full:
        assert r.value == pytest.approx(want[r.i, r.j], abs=1e-12)
    assert len(upper) == 23 * 22 // 2 and all(r.i < r.j for r in upper)
    other = points_from_rows(spark, [(0, list(r)) for r in x[:5]])
    prod = similarity.product(pts, other, tile_rows=tile_rows).collect()
    raw = x @ x[:5].T
    assert len(prod) == 23 * 5
    for r in prod:
        assert r.value == pytest.approx(raw[r.i, r.j], abs=1e-12)


def test_density_linear_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6))
    x[4] = 0.0
    pts = points_from_rows(spark, [(0, list(r)) for r in x])
    ref = pts.where("id >= 10")
    lin = {r.id: r.density for r in similarity.density_linear(pts, ref).collect()}
    pairs = similarity.row_sums(similarity.cosine_full(pts).where("j >= 10")).collect()
    for r in pairs:
        assert lin[r.id] == pytest.approx(r.density, abs=1e-9)
    no_self = {r.id: r.density for r in similarity.density_linear(pts, ref, include_self=False).collect()}
    assert no_self[12] == pytest.approx(lin[12] - 1.0)
    assert no_self[4] == 0.0 and no_self[3] == pytest.approx(lin[3])


def test_votes_all_zero_all_one_half(spark):
    rows = [(0, t, 0.0) for t in range(4)] + [(1, t, 1.0) for t in range(4)] + \
           [(2, t, float(t % 2)) for t in range(4)]
    st = {r.id: r for r in committee.vote_stats(_votes(spark, rows)).collect()}
    m = {r.id: r.margin for r in committee.margin_scores(_votes(spark, rows)).collect()}
    h = {r.id: r.half_entropy for r in committee.half_entropy_scores(_votes(spark, rows)).collect()}
    maj = {r.id: r.prediction for r in committee.majority_vote(_votes(spark, rows)).collect()}
    assert st[0].p0 == 1.0 and st[1].p0 == 0.0 and st[2].p0 == 0.5
    assert st[2].sd_vote == pytest.approx(np.std([0, 1, 0, 1], ddof=1))
    assert m == {0: 0.5, 1: 0.5, 2: 0.0}
    assert h[1] == 0.0 and h[0] == 0.0 and h[2] == pytest.approx(0.5)
    assert maj == {0: 0.0, 1: 1.0, 2: 0.0}


def test_top_k_ties_by_id_and_short_pool(spark):
    scores = spark.createDataFrame([(i, 1.0) for i in [9, 3, 7, 1]], "id BIGINT, score DOUBLE")
    assert [r.id for r in select.top_k(scores, 2).collect()] == [1, 3]
    assert [r.id for r in select.top_k(scores, 10, descending=True).collect()] == [1, 3, 7, 9]


def test_lal_picks_largest_gain_not_largest_id(spark):
    pred = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id BIGINT, prediction DOUBLE")
    assert select.select_by_prediction(pred, 1).collect()[0].id == 1


def test_scaler_constant_column_scales_to_zero(spark):
    pts = points_from_rows(spark, [(0, [1.0, 5.0]), (1, [3.0, 5.0]), (0, [5.0, 5.0])])
    out = {r.id: r.features for r in prep.standard_scale(pts, pts).collect()}
    assert out[0] == pytest.approx([-1.0, 0.0])
    assert out[2] == pytest.approx([1.0, 0.0])


def test_one_class_labelled_set_still_two_classes(spark):
    pts = points_from_rows(spark, [(1, [float(i), 1.0]) for i in range(6)])
    model = committee.fit_forest(pts, num_trees=3, seed=1)
    assert model.numClasses == 2


def test_forest_votes_match_per_tree_transform(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    pts = points_from_rows(spark, list(zip(y, x.tolist())))
    model = committee.fit_forest(pts, num_trees=7, seed=2)
    a = {(r.id, r.tree): r.vote for r in committee.forest_votes(model, pts).collect()}
    b = {(k, t): float(tree.predict(Vectors.dense(x[k]))) for k in range(80) for t, tree in enumerate(model.trees)}
    assert len(a) == 80 * 7
    assert a == b
    assert set(a.values()) <= {0.0, 1.0}


def test_start_one_per_class_has_both_classes(spark):
    pts = points_from_rows(spark, [(1.0 if i == 17 else 0.0, [float(i)]) for i in range(40)])
    start = pool.start_one_per_class(pts, 5, seed=9)
    ids = [r.id for r in start.collect()]
    assert len(ids) == 5 and 17 in ids


def test_apply_batch_keeps_first_round(spark):
    lab = spark.createDataFrame([(1, 0), (2, 0)], "id BIGINT, labeled_at INT")
    batch = spark.createDataFrame([(2,), (3,)], "id BIGINT")
    got = {r.id: r.labeled_at for r in pool.apply_batch(lab, batch, 1).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
    assert {r.id for r in pool.reset_pool(pool.apply_batch(lab, batch, 1)).collect()} == {1, 2}


def test_loop_to_exhaustion_matches_static_sequence(spark):
    pts = points_from_rows(spark, [(float(i % 2), [float(i)]) for i in range(27)])
    start = pool.start_first_k(pts, 3)
    res = loop.run_loop(spark, pts, start, 3, loop.random_strategy(4), 5)
    got = sorted((r.iteration, r.rank, r.id) for r in res.batches.collect())
    unl = pool.fetch_unlabeled(pts, start, 3)
    static = loop.static_sequence(unl.select("id", C.order_key("id", 4).alias("score")), 5)
    want = sorted((r.iteration, r.rank, r.id) for r in static.collect())
    assert got == want
    hist = res.history.orderBy("iteration").collect()
    assert [h.n_unlabeled for h in hist] == [24, 19, 14, 9, 4, 0]
    assert len([g for g in got if g[0] == 5]) == 4
    assert res.labeled.count() == 27


def test_index_rows_and_running_sums(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "id BIGINT, v DOUBLE")
    idx = {r.id: r.row_index for r in ranking.index_rows(df, [F.col("v"), F.col("id")]).collect()}
    want = sorted(range(200), key=lambda i: (i % 5, i))
    assert [idx[i] for i in want] == list(range(200))
    cum = ranking.running_sums(df, ["id"], ["v"]).collect()
    got = {r.id: r.v_cum for r in cum}
    assert got[199] == pytest.approx(sum(i % 5 for i in range(200)))
    assert got[10] == pytest.approx(sum(i % 5 for i in range(11)))


def test_auc_matches_pairwise_count(spark):
    rng = np.random.default_rng(2)
    s = rng.integers(0, 6, 60).astype(float)
    y = rng.integers(0, 2, 60).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s)], "label DOUBLE, score DOUBLE")
    got = evaluate.auc(df).collect()[0].auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert got == pytest.approx(want)


def test_lal_state_scalars(spark):
    votes = _votes(spark, [(5, t, float(t < 2)) for t in range(4)] + [(6, t, 1.0) for t in range(4)])
    labeled = points_from_rows(spark, [(1.0, [0.0]), (0.0, [1.0]), (1.0, [2.0])])
    st = {r.id: r for r in lal.lal_state(votes, labeled).collect()}
    assert st[5].f1 == 0.5 and st[6].f1 == 1.0
    assert st[5].f3 == pytest.approx(2 / 3) and st[6].f8 == 3
    assert st[5].f6 == pytest.approx((np.std([1, 1, 0, 0], ddof=1) + 0.0) / 2)


def test_hash_split_weights(spark):
    df = spark.range(20000)
    counts = {r.split: r["count"] for r in prep.hash_split(df, "id", [0.7, 0.3], 1).groupBy("split").count().collect()}
    assert abs(counts[0] / 20000 - 0.7) < 0.02


def test_shared_dictionary_orders_by_first_column(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "c")], "x STRING, y STRING")
    enc = {(r.x, r.y): (r.x_code, r.y_code) for r in prep.shared_label_encode(df, ["x", "y"]).collect()}
    # x values a, b get 0, 1; y-only value c gets 2; a keeps its x code
    assert enc[("b", "a")] == (1, 0) and enc[("a", "c")] == (0, 2)


def test_half_entropy_of_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "p DOUBLE")
    got = [r.h for r in df.select(C.half_entropy("p").alias("h")).collect()]
    assert got == [0.0, 0.5, pytest.approx(0.0)]
    assert not any(math.isnan(v) for v in got)


def test_shrunk_total_equals_total_of_the_rest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    pts = points_from_rows(spark, [(0, list(r)) for r in x])
    full = similarity.reference_total(pts)
    shrunk = similarity.shrink_total(full, pts.where("id < 7")).collect()[0]
    direct = similarity.reference_total(pts.where("id >= 7")).collect()[0]
    assert shrunk.n_ref == direct.n_ref == 33
    assert shrunk.total == pytest.approx(direct.total)
    none_removed = similarity.shrink_total(full, pts.where("id < 0")).collect()[0]
    assert none_removed.total == pytest.approx(full.collect()[0].total)


def test_density_loop_with_current_reference(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 4))
    pts = points_from_rows(spark, [(float(i % 2), list(r)) for i, r in enumerate(x)])
    start = pool.start_first_k(pts, 4)
    total = similarity.reference_total(pool.fetch_unlabeled(pts, start, 4))
    members = lambda u: committee.stump_vote_arrays(u, 3)
    strat = loop.density_strategy(total, members=members, reference_set="current_unlabeled")
    res = loop.run_loop(spark, pts, start, 4, strat, 5, max_rounds=3)
    assert res.batches.count() == 15


@pytest.mark.parametrize("tile_rows", [2, 1000])
def test_sparse_triple_products_match_numpy(spark, tile_rows):
    rng = np.random.default_rng(11)
    a = np.where(rng.random((9, 6)) < 0.4, rng.normal(size=(9, 6)), 0.0)
    b = np.where(rng.random((6, 4)) < 0.5, rng.normal(size=(6, 4)), 0.0)
    a[:, 5] = 0.0
    a[0, 5] = 1.5  # keep the full inner width
    ta = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(9) for j in range(6) if a[i, j]],
                               "i BIGINT, j BIGINT, value DOUBLE")
    tb = spark.createDataFrame([(i, j, float(b[i, j])) for i in range(6) for j in range(4) if b[i, j]],
                               "i BIGINT, j BIGINT, value DOUBLE")
    got = {(r.i, r.j): r.value for r in similarity.multiply_triples(ta, tb, tile_rows=tile_rows).collect()}
    want = a @ b
    # entries that meet at an inner index, and no others
    assert set(got) == {(i, j) for i in range(9) for j in range(4) if ((a[i] != 0) & (b[:, j] != 0)).any()}
    for (i, j), v in got.items():
        assert v == pytest.approx(want[i, j], abs=1e-12)
    dense = {r.id: r.features for r in similarity.triples_to_rows(ta).collect()}
    assert dense[0] == pytest.approx(list(a[0]))
    sims = {(r.i, r.j): r.value for r in similarity.column_similarities(ta, tile_rows=tile_rows).collect()}
    u = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    assert set(sims) == {(i, j) for i in range(9) for j in range(i + 1, 9) if ((a[i] != 0) & (a[j] != 0)).any()}
    for (i, j), v in sims.items():
        assert v == pytest.approx(float(u[i] @ u[j]), abs=1e-12)


def test_random_order_does_not_depend_on_partitioning(spark):
    ids = spark.range(300).select(F.col("id"))
    picks = [[r.id for r in select.select_random(ids.repartition(p), 25, 7).collect()]
             for p in (1, 5, 13)]
    assert picks[0] == picks[1] == picks[2]
    perms = [{r.id: r.position for r in prep.random_permutation(ids.repartition(p), 7).collect()}
             for p in (1, 9)]
    assert perms[0] == perms[1]


def test_auc_with_one_class_is_null_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.7)], "label DOUBLE, score DOUBLE")
    assert evaluate.auc(df).collect()[0].auc is None


def test_full_entropy_option_is_symmetric(spark):
    votes = _votes(spark, [(1, t, float(t < 1)) for t in range(4)] + [(2, t, float(t < 3)) for t in range(4)])
    dens = spark.createDataFrame([(1, 1.0), (2, 1.0)], "id BIGINT, density DOUBLE")
    full = {r.id: r.score for r in select.density_scores(votes, dens, entropy="full").collect()}
    half = {r.id: r.score for r in select.density_scores(votes, dens).collect()}
    assert full[1] == pytest.approx(full[2])
    assert half[1] != pytest.approx(half[2])


def test_hot_key_inputs(spark):
    # one class / one value holds most rows: results stay exact, plans stay aggregates
    rows = [(i, "hot" if i % 3 else f"v{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id BIGINT, c STRING")
    picks = {r.c: r.id for r in prep.one_random_per_class(df, "id", "c", 5).collect()}
    assert set(picks) == {r[1] for r in rows}
    plan = prep.one_random_per_class(df, "id", "c", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    enc = prep.shared_label_encode(df, ["c"]).collect()
    codes = {r.c: r.c_code for r in enc}
    assert sorted(codes.values()) == list(range(len(codes)))
    assert all(r.c_code == codes[r.c] for r in enc) and len(enc) == 3000


def test_loop_resumes_from_its_labelled_table(spark):
    pts = points_from_rows(spark, [(float(i % 2), [float(i)]) for i in range(40)])
    start = pool.start_first_k(pts, 4)
    strat = loop.random_strategy(2)
    whole = loop.run_loop(spark, pts, start, 4, strat, 3, max_rounds=5)
    first = loop.run_loop(spark, pts, start, 4, strat, 3, max_rounds=2)
    rest = loop.run_loop(spark, pts, first.labeled, 10, strat, 3, max_rounds=3)
    got = sorted((r.iteration, r.rank, r.id) for r in rest.batches.collect())
    want = sorted((r.iteration, r.rank, r.id) for r in whole.batches.collect())
    assert got == want
    assert [h.iteration for h in rest.history.orderBy("iteration").collect()] == [3, 4, 5, 6]
