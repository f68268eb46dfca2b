"""Similarity pairs, sparse products and maintained row sums on small cases."""

import numpy as np
import pytest

from orchard.operators import joins, similarity

POINTS = "id long, features array<double>"


def _brute(rows, t):
    out = {}
    for i, a in rows:
        for j, b in rows:
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if i < j and na and nb and np.dot(a, b) / (na * nb) >= t - 1e-9:
                out[i, j] = round(float(np.dot(a, b) / (na * nb)), 6)
    return out


def _hits(df):
    rows = df.collect()
    out = {(r["i"], r["j"]): round(r["value"], 6) for r in rows}
    assert len(out) == len(rows)
    return out


def _groups(n=240, groups=6, width=12):
    rng = np.random.default_rng(4)
    return [(i, (np.eye(width)[i % groups] * 5 + rng.normal(size=width) * 0.3).tolist()) for i in range(n)]


def test_join_skips_tiles_that_cannot_hold_a_hit(spark):
    rows = _groups()
    join = joins.CosineJoin(spark.createDataFrame(rows, POINTS), 0.9, tile_rows=10, pivots=6)
    assert _hits(join.hits()) == _brute(rows, 0.9)
    r = join.report().first()
    # only tiles of one group can reach the threshold
    assert r["tiles"] >= 24 and r["compared"] + r["skipped"] == r["tile_pairs"] and r["skipped"] > r["tile_pairs"] // 2


@pytest.mark.parametrize("t", [0.2, 0.7, 1.0])
def test_join_on_vectors_without_structure(spark, t):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[3][1]) * (i + 1)).tolist()) for i in range(30)] + [(200, [0.0] * 4), (201, [0.0] * 4)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4), (300, None)], POINTS)
    assert _hits(joins.cosine_join(df, t, tile_rows=8, pivots=3)) == _brute(rows, t)


def test_join_of_nothing_and_bad_thresholds(spark):
    empty = spark.createDataFrame([], POINTS)
    assert joins.cosine_join(empty, 0.5).collect() == []
    assert joins.cosine_join(spark.createDataFrame([(1, [1.0])], POINTS), 0.5).collect() == []
    for t in (0, -1, 1.5):
        with pytest.raises(ValueError):
            joins.cosine_join(empty, t)


TRIPLES = "i long, j long, value double"


def _product(a, b):
    out = {}
    for i, k, x in a:
        for k2, j, y in b:
            if k == k2:
                out[i, j] = out.get((i, j), 0) + x * y
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("heavy", [1, 20, 10_000])
def test_product_with_one_hot_index(spark, heavy):
    rng = np.random.default_rng(2)
    a = [(int(i), int(k), float(x)) for i, k, x in zip(rng.integers(0, 40, 150), rng.integers(0, 60, 150), rng.normal(size=150))]
    b = [(int(k), int(j), float(x)) for k, j, x in zip(rng.integers(0, 60, 150), rng.integers(0, 40, 150), rng.normal(size=150))]
    a += [(i, 7, 1.0) for i in range(40)] + [(0, 7, 2.0)]      # the hot index, and a repeated entry
    b += [(7, j, 0.5) for j in range(40)]
    b += [(99, 1, 1.0)]                                          # meets nothing
    got = similarity.multiply_triples(spark.createDataFrame(a, TRIPLES), spark.createDataFrame(b, TRIPLES),
                                      heavy_pairs=heavy).collect()
    assert {(r["i"], r["j"]): round(r["value"], 6) for r in got} == _product(a, b) and len(got) == len(_product(a, b))


def test_light_indices_are_not_copied(spark):
    a = spark.range(100).selectExpr("id AS i", "id AS j", "1.0D AS value")
    plan = similarity.multiply_triples(a, similarity.transpose(a))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan and "Cartesian" not in plan


def test_row_sums_kept_up_equal_row_sums_made_anew(spark):
    rng = np.random.default_rng(3)
    entries = spark.createDataFrame([(int(i), int(j), float(x)) for i, j, x in zip(
        rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.normal(size=200))], TRIPLES)
    ids = spark.range(35)                                        # 30 to 34 have no entry
    sums = similarity.row_sums(entries, ids)
    for removed in ([1, 2, 31], [5], [], list(range(6, 29))):
        gone = spark.createDataFrame([(i,) for i in removed], "id long")
        sums = similarity.shrink_row_sums(sums, entries, gone, 100)
        entries, ids = similarity.drop_entries_of(entries, gone, 100), ids.join(gone, "id", "left_anti")
        want = {r["id"]: r["density"] for r in similarity.row_sums(entries, ids).collect()}
        got = {r["id"]: r["density"] for r in sums.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
