"""Text, CSV and model sources / sinks on files written by the test itself."""

import pytest
from pyspark.ml.regression import RandomForestRegressionModel

from orchard.operators import lal
from orchard.sources import models, text


def test_whitespace_labelled_text_with_sign_recode(spark, tmp_path):
    p = tmp_path / "pts.txt"
    p.write_text("  1.5 2 -1\n\n3\t4   1 \n0 0 -1\n")
    pts = text.read_labeled_text(spark, str(p), recode="sign").orderBy("id").collect()
    assert [r.id for r in pts] == [0, 1, 2]
    assert pts[0].features == [1.5, 2.0] and pts[0].label == 0.0
    assert pts[1].features == [3.0, 4.0] and pts[1].label == 1.0


def test_single_space_text_and_train_test_pair(spark, tmp_path):
    a, b = tmp_path / "train.txt", tmp_path / "test.txt"
    a.write_text("1 2 0\n3 4 1\n")
    b.write_text("5 6 1\n")
    train, test = text.read_train_test(spark, str(a), str(b), sep=" ")
    assert train.count() == 2 and test.collect()[0].features == [5.0, 6.0]


def test_quoted_header_csv(spark, tmp_path):
    p = tmp_path / "cards.csv"
    p.write_text('"V1","V2","Class"\n0.5,1.5,"0"\n2.5,3.5,"1"\n')
    pts = text.read_csv_points(spark, str(p)).orderBy("id").collect()
    assert pts[0].features == [0.5, 1.5] and pts[1].label == 1.0


def test_missing_marker_rows_dropped_and_code_recode(spark, tmp_path):
    p = tmp_path / "cancer.csv"
    p.write_text("1000,5,1,2\n1001,?,4,4\n1002,3,3,4\n")
    pts = text.read_csv_points(spark, str(p), header=False, missing="?", recode="code",
                               zero_code=2.0, drop_columns=[0]).collect()
    assert len(pts) == 2
    assert sorted(r.label for r in pts) == [0.0, 1.0]
    assert sorted(len(r.features) for r in pts) == [2, 2]


def test_triples_ints_vectors(spark, tmp_path):
    t = tmp_path / "tri.txt"
    t.write_text("0 1 2.5\n1 0 3\n")
    assert text.read_triples(spark, str(t)).count() == 2
    i = tmp_path / "ints.txt"
    i.write_text("5\n\n3\n7\n")
    assert sorted(r.value for r in text.read_ints(spark, str(i)).collect()) == [3, 5, 7]
    v = tmp_path / "vec.txt"
    v.write_text("1 2 3\n4 5 6\n")
    vec = text.read_vectors(spark, str(v)).orderBy("id").collect()
    assert vec[1].features == [4.0, 5.0, 6.0]


def test_gain_tables(spark, tmp_path):
    p = tmp_path / "lal.txt"
    p.write_text("0.1 0.2 0.3 9 9 0.6 9 8 0.05\n0.4 0.5 0.6 9 9 0.7 9 7 0.01\n")
    g = text.read_gain_table(spark, str(p)).collect()
    assert g[0].f6 == 0.6 and g[0].f8 == 8.0 and g[0].gain == 0.05
    r = text.read_regression_table(spark, str(p)).orderBy("id").collect()
    assert len(r[0].features) == 8 and r[1].gain == 0.01


def test_text_sink_round_trip(spark, tmp_path):
    pts = text.points_from_rows(spark, [(1.0, [0.25, 1e-7]), (0.0, [3.0, -2.0])])
    out = str(tmp_path / "out")
    text.write_points_text(pts, out)
    back = text.read_labeled_text(spark, out, sep=" ").collect()
    assert sorted((tuple(r.features), r.label) for r in back) == [((0.25, 1e-7), 1.0), ((3.0, -2.0), 0.0)]


def test_history_sink_and_model_load_or_train(spark, tmp_path):
    pts = text.points_from_rows(spark, [(1.0, [0.0]), (0.0, [1.0])])
    text.write_table(pts, str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 2
    train = spark.createDataFrame([(0.1 * i, 0.2, 0.3, 0.4, float(i), 0.01 * i) for i in range(20)],
                                  "f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, f6 DOUBLE, f8 DOUBLE, gain DOUBLE")
    path = str(tmp_path / "gain-model")
    m1 = lal.fit_gain_regressor(train, num_trees=3, seed=1, model_path=path)
    m2 = models.load_or_train(path, RandomForestRegressionModel.load, lambda: pytest.fail("retrained"))
    assert m1.getNumTrees == m2.getNumTrees == 3


def test_scan_order_ids_are_consecutive_across_partitions(spark, tmp_path):
    p = tmp_path / "many.txt"
    p.write_text("".join(f"{i} {i % 2}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pts = text.read_labeled_text(spark, str(p), sep=" ")
        rows = pts.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.id for r in rows) == list(range(5000))
    assert all(r.features == [float(r.id)] for r in rows)


def test_dirty_lines_do_not_fail_the_load(spark, tmp_path):
    p = tmp_path / "dirty.txt"
    p.write_text("1 2 1\n\t\n3 x 0\n")
    rows = text.read_labeled_text(spark, str(p)).orderBy("id").collect()
    assert rows[0].features == [1.0, 2.0] and rows[0].label == 1.0
    assert rows[1].label is None
    assert rows[2].features == [3.0, None]
    g = tmp_path / "short.txt"
    g.write_text("0.1 0.2\n")
    short = text.read_gain_table(spark, str(g)).collect()[0]
    assert short.f1 == 0.1 and short.f6 is None and short.gain == 0.2


def test_model_store_publishes_once_and_ignores_unpublished_attempts(spark, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel
    from orchard.operators import lal
    from orchard.sources.models import ModelStore, data_digest
    rows = [tuple(float(i % 4) for _ in lal.STATE_COLS) + (float(i % 4),) for i in range(40)]
    train = spark.createDataFrame(rows, [*lal.STATE_COLS, "gain"])
    store = ModelStore(spark, str(tmp_path / "store"))
    model, found = lal.stored_gain_regressor(train, store, num_trees=3)
    assert not found
    # the same rows in another order and partitioning are the same model; other parameters are not
    again, found = lal.stored_gain_regressor(train.orderBy("gain").repartition(7), store, num_trees=3)
    assert found and again.toDebugString == model.toDebugString
    assert not lal.stored_gain_regressor(train, store, num_trees=4)[1]
    assert data_digest(train) != data_digest(train.union(train.limit(1)))
    # a writer that died before its marker is ignored; of two writers the first stands
    model.save(str(tmp_path / "store" / "dead" / "attempt-x"))
    assert store.published("dead") is None
    first = store.publish("both", model)
    assert store.publish("both", again) == first == store.published("both")
    with pytest.raises(Exception):
        store.load_or_train("broken", RandomForestRegressionModel.load, lambda: 1 / 0)
    assert store.published("broken") is None


def test_factorised_prediction_equals_row_by_row(spark):
    from pyspark.sql import functions as F
    from orchard.operators import lal
    gen = spark.range(400).select(*[(F.rand(i) * 3).alias(c) for i, c in enumerate(lal.STATE_COLS)])
    model = lal.fit_gain_regressor(gen.withColumn("gain", F.col("f1") * F.col("f2")), num_trees=20)
    # 11 votes: few states for many rows
    state = spark.range(3000).select("id", (F.col("id") % 11 / 10.0).alias("f1"), (F.col("id") % 11 * 0.2).alias("f2"),
                                     F.lit(0.3).alias("f3"), F.lit(0.4).alias("f6"), F.lit(2).alias("f8"))
    assert lal.distinct_states(state).count() == 11
    whole = model.copy().setFeaturesCol("sv").transform(lal._assembled(state)).select("id", "prediction")
    assert sorted(lal.predict_gain(state, model).collect()) == sorted(whole.collect())
    plan = lal.predict_gain(state, model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "UDF" not in plan
