"""Repeated matrix entries, wide matrices, loop safety, file order, settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orchard.operators import committee, pool, similarity
from orchard.operators.select import select_random
from orchard.plans import loop
from orchard.sources import models, text


def triples(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, value double")


def test_repeated_entries_add_up(spark):
    t = triples(spark, [(0, 0, 1.0), (0, 0, 5.0), (0, 2, 7.0), (1, 1, 2.0)])
    rows = {r.id: list(r.features) for r in similarity.triples_to_rows(t).collect()}
    assert rows == {0: [6.0, 0.0, 7.0], 1: [0.0, 2.0, 0.0]}


def test_sparse_products_match_numpy(spark):
    rng = np.random.default_rng(4)
    n, m, p = 13, 9, 11
    a, b = np.zeros((n, m)), np.zeros((m, p))
    rows_a, rows_b = [], []
    for _ in range(60):
        i, j, k, v = rng.integers(n), rng.integers(m), rng.integers(p), float(rng.integers(1, 9))
        a[i, j] += v
        b[j, k] += v
        rows_a.append((int(i), int(j), v))
        rows_b.append((int(j), int(k), v))
    got = np.zeros((n, p))
    for r in similarity.multiply_triples(triples(spark, rows_a), triples(spark, rows_b), tile_rows=4,
                                         inner_block=4).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, a @ b)
    unit = a / np.where(np.linalg.norm(a, axis=1) == 0, 1, np.linalg.norm(a, axis=1))[:, None]
    want = unit @ unit.T
    sims = {(r.i, r.j): r.value for r in similarity.column_similarities(triples(spark, rows_a)).collect()}
    for i in range(n):
        for j in range(i + 1, n):
            assert sims.get((i, j), 0.0) == pytest.approx(want[i, j])


def test_no_width_is_too_large(spark):
    wide = 5_000_000
    a = triples(spark, [(0, wide, 2.0), (1, 3, 1.0), (1, wide, 1.0)])
    got = {(r.i, r.j): r.value for r in similarity.multiply_triples(a, similarity.transpose(a)).collect()}
    assert got == {(0, 0): 4.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 2.0}


def points(spark, n):
    return spark.createDataFrame([(i, [float(i)], float(i % 2)) for i in range(n)],
                                 "id long, features array<double>, label double")


def test_loop_refuses_repeated_and_null_ids(spark):
    pts = points(spark, 10)
    for bad in (pts.union(pts.limit(1)), pts.union(pts.limit(1).withColumn("id", F.lit(None).cast("long")))):
        with pytest.raises(ValueError, match="unique"):
            loop.run_loop(spark, bad, pool.start_first_k(pts, 2), 2, loop.random_strategy(1), 3)


def test_loop_stops_when_a_strategy_gives_nothing(spark):
    pts = points(spark, 12)
    nothing = lambda ctx: select_random(ctx.unlabeled.where("id < 4"), ctx.k, 1, carry=loop.CARRY)
    res = loop.run_loop(spark, pts, pool.start_first_k(pts, 2), 2, nothing, 2)
    assert res.labeled.count() == 4 and res.history.count() == 3


def test_loop_state_is_read_back_in_a_new_session(spark, tmp_path):
    pts = points(spark, 20)
    start = pool.start_first_k(pts, 2)
    whole = loop.run_loop(spark, pts, start, 2, loop.random_strategy(5), 4)
    path = str(tmp_path / "state")
    loop.run_loop(spark, pts, start, 2, loop.random_strategy(5), 4, max_rounds=2, state_path=path)
    other = spark.newSession()
    state = loop.read_state(other, path)
    rest = loop.run_loop(other, points(other, 20), state, 10, loop.random_strategy(5), 4)
    assert sorted(map(tuple, rest.batches.collect())) == sorted(map(tuple, whole.batches.collect()))


def test_integers_beyond_32_bits_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text("3000000000\n\n-7\n  5 \n")
    bad.write_text("1\nx1\n")
    assert sorted(r.value for r in text.read_ints(spark, str(good)).collect()) == [-7, 5, 3_000_000_000]
    with pytest.raises(Exception, match="not an integer"):
        text.read_ints(spark, str(bad)).collect()


def test_an_unreadable_model_is_never_replaced(spark, tmp_path):
    place = tmp_path / "model"
    place.mkdir()
    (place / "data").write_text("other")

    def broken(_):
        raise OSError("storage is away")

    with pytest.raises(OSError):
        models.load_or_train(str(place), broken, lambda: pytest.fail("trained"))
    assert (place / "data").read_text() == "other"


def test_ids_follow_file_order(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0").write_text("0 first 0\n")
    (folder / "part-1").write_text("".join(f"{i} 1\n" for i in range(1, 4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = text.read_labeled_text(spark, str(folder)).select("id", F.col("features")[0]).collect()
            assert sorted((r[0], r[1]) for r in got) == [(i, float(i)) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_forest_does_not_depend_on_session_settings(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist(), float(rng.random() < 0.5)) for i in range(400)]
    seen, keep = set(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts, aqe in (("2", "true"), ("8", "true"), ("2", "false"), ("8", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            pts = spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(int(parts))
            model = committee.fit_forest(pts, 5, seed=3)
            seen.add(tuple(sorted((r.id, r.tree, r.vote) for r in committee.forest_votes(model, pts).collect())))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(seen) == 1


def test_stumps_read_the_whole_vector(spark):
    pts = spark.createDataFrame([(0, [-1.0] * 4 + [9.0] * 2, 0.0), (1, [1.0], 0.0), (2, [], 0.0)],
                                "id long, features array<double>, label double")
    got = {r.id: list(r.votes) for r in committee.stump_vote_arrays(pts, 2).collect()}
    assert got == {0: [1.0, 1.0], 1: [1.0, 0.0], 2: [0.0, 0.0]}
