"""Committed rounds, runs of positions, and the stored CSV pipeline."""

import pytest
from pyspark.sql import functions as F

from orchard.operators import pool, ranking
from orchard.plans import jobs, loop
from orchard.sources import text
from orchard.sources.models import ModelStore
from orchard.sources.rounds import RoundLog


def points(spark, n):
    return spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("features"),
                                 (F.col("id") % 2).cast("double").alias("label"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("killed_at", [1, 3])
def test_a_run_killed_before_its_marker_resumes_in_the_same_folder(spark, tmp_path, monkeypatch, killed_at):
    pts = points(spark, 14)
    start = pool.start_first_k(pts, 2)
    args = (spark, pts, start, 2, loop.random_strategy(5), 4)
    whole = loop.run_loop(*args)
    path, commit, calls = str(tmp_path / "state"), RoundLog.commit, []

    def dies(self, attempt, line=None):
        calls.append(attempt)
        if len(calls) == killed_at:
            raise KeyboardInterrupt
        return commit(self, attempt, line)

    with monkeypatch.context() as m:
        m.setattr(RoundLog, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            loop.run_loop(*args, state_path=path)
    log = RoundLog(spark, path)
    assert len(log.committed()) == killed_at - 1  # the staged attempt does not count
    if killed_at == 3:
        assert loop.read_state(spark, path).count() == 6
        assert loop.read_log(spark, path).count() == 1
    again = loop.run_loop(*args, state_path=path)
    assert rows(again.batches) == rows(whole.batches)
    keep = ("iteration", "n_labeled", "n_unlabeled", "accuracy")
    assert rows(again.history.select(*keep)) == rows(whole.history.select(*keep))
    assert loop.read_log(spark, path).where("seconds >= 0").count() == 3
    # a finished run has nothing left to do
    assert rows(loop.run_loop(*args, state_path=path).batches) == rows(whole.batches)
    assert len(log.committed()) == 4


def test_resumed_run_keeps_its_number_of_rounds(spark, tmp_path):
    pts, path = points(spark, 20), str(tmp_path / "state")
    args = (spark, pts, pool.start_first_k(pts, 2), 2, loop.random_strategy(5), 3)
    loop.run_loop(*args, max_rounds=1, state_path=path)
    res = loop.run_loop(*args, max_rounds=3, state_path=path)
    assert res.labeled.count() == 2 + 9
    assert [r[0] for r in res.history.orderBy("iteration").collect()] == [1, 2, 3, 4]


def test_an_attempt_is_committed_once(spark, tmp_path):
    log = RoundLog(spark, str(tmp_path / "log"))
    assert log.committed() == {} and log.lines(loop.HISTORY_SCHEMA).count() == 0
    attempt = log.commit(log.stage("start", spark.range(3)))
    with pytest.raises(FileExistsError):
        log.commit(attempt)
    assert log.rows().count() == 3


def test_positions_of_a_value_that_holds_nearly_all_rows(spark):
    values = [7] * 900 + [None, None] + list(range(98))
    df = spark.createDataFrame([(v,) for v in values], "value int")
    got = ranking.value_positions(df, "value", chunk=8)
    expected = sorted(values, key=lambda v: (v is not None, v))
    assert rows(got) == list(enumerate(expected))
    # the runs are split before they are dealt out: no task expands a whole value
    per_task = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert per_task < 500
    assert ranking.value_positions(df.limit(0), "value").count() == 0


def test_integers_in_a_minimum_of_partitions(spark, tmp_path):
    (tmp_path / "n").write_text("\n".join(map(str, range(50))))
    few = text.read_ints(spark, str(tmp_path / "n"))
    many = text.read_ints(spark, str(tmp_path / "n"), min_partitions=6)
    assert many.rdd.getNumPartitions() == 6 and rows(few) == rows(many)


def test_csv_pipeline_is_stored_as_one_unit(spark, tmp_path):
    lines = ['"id","x.y","label","it\'s"']
    for i in range(200):
        yes = i % 3 == 0
        lines.append(f'"{i}","{"?" if i % 20 == 7 else 1000 * yes + 5}","{"a\'b" if yes else "no"}","{-0.25 * yes}"')
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines))
    store = ModelStore(spark, str(tmp_path / "models"))
    job = lambda: jobs.csv_supervised_job(spark, str(path), "id", "label", "a'b", store, 5).first()
    first, second = job(), job()
    assert (first.from_store, second.from_store) == (False, True)
    assert first[1:] == second[1:]
    assert first.n_train + first.n_test == 190 and first.accuracy == 1.0 and first.auc == 1.0
    assert first.fp == first.fn == 0 and first.tp + first.tn == first.n_test
    path.write_text("\n".join(lines[:-1]))
    changed = job()
    assert changed.n_train + changed.n_test == 189
    assert changed.from_store == (changed.n_train == first.n_train)  # other training rows, another model
