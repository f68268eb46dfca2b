"""What is read once, and what does not grow faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orchard.operators import joins, similarity
from orchard.plans import jobs

TRIPLES = "i long, j long, value double"


def _documents(spark, n=160):
    """Documents and labels whose texts count how often they are made."""
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return f"{'Ab1 ' * (i % 7)}{'und ' * (i % 2)}word{i} 12\n"

    rows = spark.range(n).withColumn("text", F.udf(text, "string").asNondeterministic()("id"))
    docs = rows.select(F.col("id").alias("doc_id"), "text", F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias(
        "lang"), F.lit("s").alias("source"), F.lit(20).cast("long").alias("n_chars"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    return docs, labels, read


def test_quality_job_reads_the_texts_once(spark):
    docs, labels, read = _documents(spark)
    row = jobs.quality_job(docs, labels).first()
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] > 0
    assert read.value == 160


def test_multiclass_job_reads_the_texts_once(spark):
    docs, _, read = _documents(spark)
    assert jobs.multiclass_job(docs).first()["num_classes"] == 2
    assert read.value == 160


def test_entries_are_not_moved_to_a_thin_matrix(spark):
    # an index hit by 70,000 rows, and repeated entries
    a = spark.range(70_000).selectExpr("id AS i", "0L AS j", "1.0D AS value").unionByName(
        spark.createDataFrame([(0, 0, 2.0), (1, 1, 5.0), (2, 9, 1.0)], TRIPLES))
    b = spark.createDataFrame([(0, 3, 2.0), (1, 3, 1.0), (1, 3, 1.0)], TRIPLES)
    got = similarity.multiply_triples(a, b)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CoGroup" not in plan and "Generate" not in plan
    values = {r["i"]: r["value"] for r in got.collect()}
    assert len(values) == 70_000 and (values[0], values[1], values[2]) == (6.0, 12.0, 2.0)


@pytest.mark.parametrize("n", [120, 480])
def test_copies_of_a_joined_row_do_not_grow_with_the_tiles(spark, n):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(n)]
    join = joins.CosineJoin(spark.createDataFrame(rows, "id long, features array<double>"), 0.2, tile_rows=8, pivots=2)
    assert join.n_tiles >= n // 8
    assert join.dealt().count() <= n * 7
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.2 - 1e-9, 1)))}
    got = [(r["i"], r["j"]) for r in join.hits().collect()]
    assert len(got) == len(want) and set(got) == want


def test_hits_leave_a_task_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "HITS", 5)
    import pandas as pd
    frame = pd.DataFrame({"own": [0] * 6, "ga": [0] * 6, "gb": [0] * 6, "id": range(6), "tile": [0, 0, 0, 1, 1, 1],
                          "features": [np.array([1.0, 0.0])] * 6})
    parts = list(joins._group_hits(0.9)(iter([frame[:2], frame[2:]])))
    assert len(parts) == 2 and sum(map(len, parts)) == 15


def test_plain_pool_is_derived_once(spark):
    read = spark.sparkContext.accumulator(0)

    def x(i):
        read.add(1)
        return float(i % 5)

    made = spark.range(120).withColumn("x", F.udf(x, "double").asNondeterministic()("id"))
    points = made.select("id", F.array("x").alias("features"), (F.col("x") > 2).cast("double").alias("label"))
    out = jobs.forest_loop(spark, points, "uncertainty", rounds=1).collect()
    assert out[-1]["n_unlabeled"] == 0
    assert read.value == 120
