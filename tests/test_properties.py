"""Property tests: distributed building blocks against plain Python."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orchard.operators import evaluate, ranking, select, similarity
from orchard.sources.text import points_from_rows

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60)


@SETTINGS
@given(vals=values, parts=st.integers(min_value=1, max_value=7))
def test_index_rows_is_the_sorted_position(spark, vals, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id BIGINT, v INT")
    got = {r.id: r.row_index for r in
           ranking.index_rows(df, [F.col("v"), F.col("id")], partitions=parts).collect()}
    want = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert [got[i] for i in want] == list(range(len(vals)))


@SETTINGS
@given(vals=values, k=st.integers(min_value=1, max_value=70), desc=st.booleans())
def test_top_k_is_the_head_of_the_sorted_scores(spark, vals, k, desc):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id BIGINT, score DOUBLE")
    got = [r.id for r in select.top_k(df, k, descending=desc).collect()]
    order = sorted(range(len(vals)), key=lambda i: ((-vals[i] if desc else vals[i]), i))
    assert got == order[:k]


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=2, max_size=50))
def test_auc_equals_pair_count(spark, data):
    ys = [y for y, _ in data]
    if len(set(ys)) < 2:
        return
    df = spark.createDataFrame([(float(y), float(s)) for y, s in data], "label DOUBLE, score DOUBLE")
    got = evaluate.auc(df).collect()[0].auc
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


@SETTINGS
@given(n=st.integers(min_value=1, max_value=30), d=st.integers(min_value=1, max_value=5),
       tile=st.integers(min_value=1, max_value=12), seed=st.integers(0, 1000))
def test_strict_upper_cosine_covers_each_pair_once(spark, n, d, tile, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    pts = points_from_rows(spark, [(0, list(r)) for r in x])
    rows = similarity.cosine_upper(pts, tile_rows=tile).collect()
    assert sorted((r.i, r.j) for r in rows) == [(i, j) for i in range(n) for j in range(i + 1, n)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in rows:
        assert r.value == pytest.approx(float(u[r.i] @ u[r.j]), abs=1e-12)
