"""Products of dense matrices: copies and sums that must not grow with the square of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orchard.operators import similarity

TRIPLES = "i long, j long, value double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _matrix(n, width, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x, [(i, k, float(x[i, k])) for i in range(n) for k in range(width)]


def test_products_of_one_block_are_not_summed_again(spark):
    x, entries = _matrix(50, 6)
    a = spark.createDataFrame(entries, TRIPLES)
    got = similarity.multiply_triples(a, similarity.transpose(a), tile_rows=7, heavy_pairs=100)
    # the n^2 products leave the tasks that make them: nothing deals them out again
    assert "Exchange" not in _plan(got).split("FlatMapGroupsInPandas")[0]
    rows = got.collect()
    assert len(rows) == 2500 and all(abs(r["value"] - x[r["i"]] @ x[r["j"]]) < 1e-9 for r in rows)


def test_products_of_several_blocks_and_light_indices_are_summed(spark):
    x, entries = _matrix(30, 9)
    entries += [(i, 100 + i % 10, 2.0) for i in range(30)]
    a = spark.createDataFrame(entries, TRIPLES)
    full = np.hstack([x, 2.0 * (np.arange(30)[:, None] % 10 == np.arange(10))])
    rows = similarity.multiply_triples(a, similarity.transpose(a), tile_rows=4, inner_block=4, heavy_pairs=100).collect()
    assert len(rows) == 900
    assert all(abs(r["value"] - full[r["i"]] @ full[r["j"]]) < 1e-9 for r in rows)


@pytest.mark.parametrize("mode", ["full", "strict_upper"])
def test_copies_of_a_row_follow_the_cores(spark, monkeypatch, mode):
    taken = spark.sparkContext.accumulator(0)
    made = similarity._group_products

    def counted(strict, tile_rows):
        fn = made(strict, tile_rows)

        def count(frames):
            for f in frames:
                taken.add(len(f))
                yield f

        def run(frames: similarity.Iterator[pd.DataFrame]) -> similarity.Iterator[pd.DataFrame]:
            yield from fn(count(frames))

        return run

    monkeypatch.setattr(similarity, "_group_products", counted)
    n, x = 300, _matrix(300, 3)[0]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    rows = similarity.self_product(points, mode, tile_rows=4).collect()
    # 75 tiles: a copy for each of them before; 4 cores make 6 groups
    assert taken.value <= 7 * n
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows) == (n * n if mode == "full" else n * (n - 1) // 2)
    assert all(abs(r["value"] - x[r["i"]] @ x[r["j"]]) < 1e-9 for r in rows)


def test_products_leave_a_task_in_bounded_parts():
    frame = pd.DataFrame({"ga": [0] * 6, "gb": [1] * 6, "own": [0, 0, 0, 1, 1, 1], "id": range(6),
                          "v": [np.array([1.0, 0.0])] * 6})
    parts = list(similarity._group_products(False, 2)(iter([frame[:4], frame[4:]])))
    assert sum(map(len, parts)) == 18 and max(map(len, parts)) <= 8


def _written_bytes(df, path):
    df.write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet"))


@pytest.mark.parametrize("query", ["cosine_full", "cosine_upper", "triple_multiply", "triple_column_similarity"])
def test_rounded_entries_of_a_matrix_are_written_in_few_bytes(spark, tmp_path, monkeypatch, query):
    n, x = 1000, _matrix(1000, 8)[0]
    monkeypatch.setattr(similarity, "_groups", lambda *_: 1)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    a = similarity.rows_to_triples(points)
    made = {"cosine_full": lambda: similarity.cosine_full(points), "cosine_upper": lambda: similarity.cosine_upper(points),
            "triple_multiply": lambda: similarity.multiply_triples(a, similarity.transpose(a)),
            "triple_column_similarity": lambda: similarity.column_similarities(a)}[query]()
    # cosines are spread like the products: several times as many entries as values
    spread = 1.0 if query == "triple_multiply" else 8.0
    rounded = made.select("i", "j", F.round(F.col("value") * spread, 4).alias("value"))
    rows = n * n if query in ("cosine_full", "triple_multiply") else n * (n - 1) // 2
    # 6.2 to 6.5 bytes a row where they leave in the order of the rows
    assert _written_bytes(rounded, tmp_path / "entries") < 6 * rows
    back = spark.read.parquet(str(tmp_path / "entries"))
    assert back.count() == back.select("i", "j").distinct().count() == rows


def test_entries_leave_a_square_of_tiles_by_value():
    x = np.random.default_rng(5).normal(size=(12, 3))
    frame = pd.DataFrame({"ga": [0] * 12, "gb": [1] * 12, "own": [0] * 6 + [1] * 6, "id": range(12), "v": list(x)})
    got = pd.concat(similarity._group_products(True, 2)(iter([frame])))
    assert got["value"].is_monotonic_increasing and len(got) == 36
    assert np.allclose(got["value"], [x[i] @ x[j] for i, j in zip(got["i"], got["j"])])
    packed = pd.DataFrame({"of_a": [True] * 6 + [False] * 6, "key": [*range(6)] * 2, "inner": [np.arange(3)] * 12,
                           "v": list(x)})
    got = pd.concat(similarity._block_products(2)(iter([packed])))
    assert got["value"].is_monotonic_increasing and len(got) == 36
    assert np.allclose(got["value"], [x[i] @ x[6 + j] for i, j in zip(got["i"], got["j"])])
