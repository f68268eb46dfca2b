"""The job from two text files, and forests that do not depend on the layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orchard.operators import committee, lal
from orchard.plans import jobs, loop



def write(path, rows):
    path.write_text("".join(" ".join(map(str, r)) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(4)
    base = tmp_path_factory.mktemp("dataset")
    out = {}
    for name, n in (("train", 60), ("test", 25)):
        x = np.round(rng.normal(3, 2, (n, 4)), 4)
        x[:, 3] = 7.0  # a constant column
        y = np.where(x[:, 0] + x[:, 1] > 6, 1, -1)
        out[name] = (write(base / f"{name}.txt", [list(r) + [k] for r, k in zip(x, y)]), x, y)
    return out


def scaled(x, by):
    sd = by.std(0, ddof=1)
    return (x - by.mean(0)) * np.where(sd < 1e-12, 0, 1 / np.where(sd < 1e-12, 1, sd))


@pytest.mark.parametrize("by", jobs.SCALE_TEST_BY)
def test_points_of_two_files(spark, files, by):
    (train_path, x, y), (test_path, tx, ty) = files["train"], files["test"]
    points, test = jobs.dataset_points(spark, train_path, test_path, scale_test_by=by)
    for df, want, labels in ((points, scaled(x, x), y), (test, scaled(tx, x if by == "train" else tx), ty)):
        rows = df.orderBy("id").collect()
        assert [r["id"] for r in rows] == list(range(len(labels)))
        assert np.allclose([r["features"] for r in rows], want)
        assert [r["label"] for r in rows] == [1.0 if k == 1 else 0.0 for k in labels]


def test_unknown_scaling_is_an_error(spark, files):
    with pytest.raises(ValueError):
        jobs.dataset_points(spark, files["train"][0], files["test"][0], scale_test_by="both")


def test_a_job_goes_on_in_its_folder(spark, files, tmp_path):
    args = (spark, files["train"][0], files["test"][0], loop.random_strategy(5), 6, 3)
    kept = dict(num_trees=3, state_path=str(tmp_path / "run"))
    first, _ = jobs.dataset_job(*args, **kept)
    again, _ = jobs.dataset_job(*args, **kept)
    rows = [sorted(map(tuple, r.batches.collect())) for r in (first, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 54
    history = first.history.orderBy("iteration").collect()
    assert [r["n_labeled"] for r in history] == [6, 24, 42, 60]
    assert all(0 <= r["accuracy"] <= 1 for r in history)


def trees(model):
    return model.toDebugString.split("\n", 1)[1]  # the first line names the model


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_forests_for_any_layout(spark, partitions, monkeypatch):
    monkeypatch.setattr(committee, "FIT_ROWS", 20)  # more than FIT_PARTITIONS of them
    points = spark.range(400).select("id", F.array(
        F.rand(1), F.rand(2), F.rand(3)).alias("features"), (F.rand(4) > 0.5).cast("double").alias("label"))
    rows = spark.createDataFrame(points.collect(), points.schema)
    assert committee.fit_order(rows, "id").rdd.getNumPartitions() == 20
    found = set()
    for n in (2, 16, 200):
        partitions(n)
        found.add(trees(committee.fit_forest(rows.repartition(n, F.rand(n)), 4, seed=2)))
    assert len(found) == 1


def test_equal_regressors_with_a_state_that_most_rows_share(spark, partitions):
    hot = [(0.5, 0.1, 0.2, 0.3, 4.0, 0.7)] * 900
    rows = hot + [(i / 50, i / 90, 0.2, 0.3, float(i), i / 60) for i in range(50)]
    train = spark.createDataFrame(rows, [*lal.STATE_COLS, "gain"])
    numbered = lal.numbered_copies(train, *train.columns)
    assert sorted(map(tuple, numbered.drop("copy").collect())) == sorted(rows)
    sizes = committee.fit_order(numbered, *numbered.columns).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200  # the shared state is spread
    found = set()
    for n in (2, 40):
        partitions(n)
        found.add(trees(lal.fit_gain_regressor(train.repartition(n, F.rand(n)), num_trees=4)))
    assert len(found) == 1


def test_copies_in_bounded_runs(spark, monkeypatch):
    monkeypatch.setattr(lal, "COPY_RUN", 3)
    train = spark.createDataFrame([(1.0,)] * 10 + [(2.0,)] + [(None,)] * 3, "x double")
    got = sorted(map(tuple, lal.numbered_copies(train, "x").collect()), key=str)
    assert got == sorted([(1.0, i) for i in range(10)] + [(2.0, 0)] + [(None, i) for i in range(3)], key=str)
    assert lal.numbered_copies(train.limit(0), "x").count() == 0
