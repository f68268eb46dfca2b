"""The label - retrain - evaluate round loop.

Each round, on the driver, is a handful of Spark jobs over DataFrames; only
scalar metrics come back (counts, accuracy).  Per round:

1. take the unlabelled rows (anti join against the small labelled table,
   broadcast while its known bound allows); the labelled rows, with their
   features, are the labelled table itself;
2. fit the committee on the labelled rows (if the strategy needs one) and
   score the test table;
3. let the strategy pick a batch of k ids: k is a share of the pool, so the
   pick is a distributed selection (``select.smallest_k``) and the features of
   the winners come from a join with the pool;
4. write the batch (with its rank, features and labels) and the round's log
   line as one committed step below ``state_path`` (``sources.rounds``); the
   labelled table is the committed steps read together, so lineage stays one
   round long, nothing written is rewritten, a later application can read the
   state back (``read_state``), and a run that was killed goes on in the same
   folder after its last committed round.

The loop ends when the pool is empty, when a strategy hands out no row, or
after ``max_rounds`` rounds.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orchard.operators import committee, pool, similarity
from orchard.operators.select import (select_by_prediction, select_density, select_random,
                                      select_uncertain)
from orchard.session import scratch_path
from orchard.sources.rounds import RoundLog

HISTORY_SCHEMA = T.StructType([
    T.StructField("iteration", T.IntegerType()),
    T.StructField("n_labeled", T.LongType()),
    T.StructField("n_unlabeled", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("seconds", T.DoubleType()),
])


@dataclass
class RoundContext:
    iteration: int
    k: int
    points: DataFrame
    labeled: DataFrame
    labeled_bound: int
    unlabeled: DataFrame
    labeled_points: DataFrame
    model: object = None
    extra: dict = field(default_factory=dict)


Strategy = Callable[[RoundContext], DataFrame]


@dataclass
class LoopResult:
    history: DataFrame
    batches: DataFrame
    labeled: DataFrame  # (id, labeled_at, rank); pass it as ``start`` to resume


# ---------------------------------------------------------- strategies ----
# Columns of a chosen row that travel with it into the labelled table.
CARRY = ("features", "label")


def random_strategy(seed: int) -> Strategy:
    return lambda ctx: select_random(ctx.unlabeled, ctx.k, seed, share=True)


def committee_votes(ctx: RoundContext, members: Callable[[DataFrame], DataFrame] | None):
    """Per-row vote arrays of the unlabelled rows (all their columns kept).

    ``members`` gives a fixed committee (it must return per-row ``votes``
    arrays and keep the input columns); otherwise the round's forest votes.
    """
    if members is not None:
        return members(ctx.unlabeled)
    return committee.forest_vote_arrays(ctx.model, ctx.unlabeled)


def uncertainty_strategy(members: Callable[[DataFrame], DataFrame] | None = None) -> Strategy:
    """Most uncertain first; ``members`` gives fixed committee votes, else the round's forest."""
    return lambda ctx: select_uncertain(committee_votes(ctx, members), ctx.k, share=True)


def density_strategy(density: DataFrame, beta: float = 1.0,
                     members: Callable[[DataFrame], DataFrame] | None = None,
                     reference_set: str = "initial_unlabeled") -> Strategy:
    """``density``: the one-row reference total of the initially unlabelled
    rows (computed once; density then costs one dot product per row inside
    the scoring projection) or an ``(id, density)`` table.

    ``reference_set='initial_unlabeled'`` keeps the reference fixed, as the
    original loop does; ``'current_unlabeled'`` removes the rows labelled
    since the start from the total each round (needs the one-row total).
    """
    if reference_set not in ("initial_unlabeled", "current_unlabeled"):
        raise ValueError(f"unknown reference_set {reference_set!r}")

    def pick(ctx: RoundContext) -> DataFrame:
        dens = density
        if reference_set == "current_unlabeled":
            since_start = ctx.labeled.where(F.col("labeled_at") > 0).select("id", "features")
            dens = similarity.shrink_total(density, since_start)
        return select_density(committee_votes(ctx, members), dens, ctx.k, beta, share=True)
    return pick


def lal_strategy(regressor, members: Callable[[DataFrame], DataFrame] | None = None) -> Strategy:
    """Largest gain predicted by a fitted regressor; ``regressor=None`` uses
    the fixed linear stand-in gain (``lal.LINEAR_GAIN``)."""
    from orchard.operators.lal import lal_state, linear_gain, predict_gain

    def pick(ctx: RoundContext) -> DataFrame:
        state = lal_state(committee_votes(ctx, members), ctx.labeled_points)
        gains = linear_gain(state) if regressor is None else predict_gain(state, regressor)
        return select_by_prediction(gains, ctx.k, share=True)
    return pick


# ---------------------------------------------------------------- loop ----

def run_loop(spark: SparkSession, points: DataFrame, start: DataFrame, start_bound: int,
             strategy: Strategy, k: int, *, test: DataFrame | None = None,
             max_rounds: int | None = None, fit_committee: bool = False,
             num_trees: int = 10, seed: int = 1, state_path: str | None = None) -> LoopResult:
    """Run rounds until the pool is empty or ``max_rounds`` batches were taken.

    ``points`` is the pool ``(id, features, label)``; ``start`` a labelled
    table ``(id, labeled_at=0)`` of at most ``start_bound`` rows, all in the
    pool.  The labelled table keeps the features and labels of its rows; a
    round reads the pool to score it and once more for its winners.  History rows describe the state at the start of a round
    (before its batch); accuracy is NULL when no committee is fitted.

    ``start`` may also be the ``labeled`` table of an earlier run or what
    ``read_state`` gives for its ``state_path`` (rounds > 0 included):
    numbering then continues after its last round.  ``state_path`` names the
    folder of the run (default: a new one in the shared checkpoint folder).  If
    an earlier run was killed there, this one, called with the same arguments,
    goes on after the last committed round and gives the history and batches of
    both together.

    Ids of the pool must be unique and not null; that is checked once.
    """
    bound = start_bound
    n_pool, n_ids = points.select(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n_pool != n_ids:
        raise ValueError(f"pool ids must be unique and not null: {n_pool} rows, {n_ids} ids")
    log = RoundLog(spark, state_path or scratch_path(spark, f"loop-{uuid.uuid4().hex}"))
    done_rounds = start.select(F.max("labeled_at")).first()[0] or 0
    rank = F.col("rank") if "rank" in start.columns else F.lit(None)
    start_ids = start.select("id", "labeled_at", rank.cast("int").alias("rank"))
    start_rows = _labelled_columns(points.join(pool.bounded_side(start_ids, bound), "id"))
    if "start" not in log.committed():
        log.commit(log.stage("start", start_rows))
    history = [tuple(r) for r in log.lines(HISTORY_SCHEMA).orderBy("iteration").collect()]  # a row a round
    bound += k * len(history)
    labeled = log.rows(start_rows.schema)
    n_before = history[-1][1] if history else -1
    iteration = history[-1][0] if history else done_rounds
    while True:
        t0 = time.time()
        iteration += 1
        labeled_points = labeled.select("id", *CARRY)
        unlabeled = pool.fetch_unlabeled(points, labeled, bound)
        n_labeled = labeled.count()
        n_unlabeled = n_pool - n_labeled
        stuck = n_labeled == n_before  # the last batch was empty
        n_before = n_labeled
        model, acc = None, None
        if fit_committee and n_labeled > 0:
            model = committee.fit_forest(labeled_points, num_trees=num_trees, seed=seed, rows=n_labeled)
            if test is not None:
                acc = forest_accuracy(model, test)
        done = n_unlabeled == 0 or stuck or (max_rounds is not None
                                    and iteration > done_rounds + max_rounds)
        if done:
            history.append((iteration, n_labeled, n_unlabeled, acc, time.time() - t0))
            break
        ctx = RoundContext(iteration, k, points, labeled, bound, unlabeled, labeled_points, model)
        picks = pool.bounded_side(strategy(ctx).select("id", "rank"), k)
        batch = points.select("id", *CARRY).join(picks, "id").withColumn("labeled_at", F.lit(iteration))
        attempt = log.stage(_round_name(iteration), _labelled_columns(batch))
        history.append((iteration, n_labeled, n_unlabeled, acc, time.time() - t0))
        log.commit(attempt, dict(zip(HISTORY_SCHEMA.names, history[-1])))
        labeled = log.rows(start_rows.schema)
        bound += k
    hist = spark.createDataFrame(history, HISTORY_SCHEMA)
    batches = labeled.where(F.col("labeled_at") > 0).select(
        F.col("labeled_at").alias("iteration"), "rank", "id")
    return LoopResult(hist, batches, labeled.select("id", "labeled_at", "rank"))


def _labelled_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("labeled_at").cast("int").alias("labeled_at"),
                       F.col("rank").cast("int").alias("rank"), *CARRY)


def _round_name(iteration: int) -> str:
    return f"step-{iteration:09d}"  # sorts after "start"


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The labelled table (id, labeled_at, rank) of the committed rounds at
    ``state_path``, in any application that can read the folder."""
    return RoundLog(spark, state_path).rows().select("id", "labeled_at", "rank")


def read_log(spark: SparkSession, state_path: str) -> DataFrame:
    """One row a committed round at ``state_path``: the history with its seconds."""
    return RoundLog(spark, state_path).lines(HISTORY_SCHEMA)


def forest_accuracy(model, test: DataFrame) -> float | None:
    """Accuracy of the committee's hard majority vote on the test table."""
    votes = committee.forest_vote_arrays(model, test.select("id", "features", "label"))
    pred = committee.predictions(votes, keep=("label",))
    row = pred.select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()
    return float(row[0]) if row[0] is not None else None


def static_sequence(scores: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """Whole labelling sequence when scores do not depend on the labelled set.

    Then the loop's batches are consecutive k-chunks of one global order, so
    the run needs one distributed ranking instead of one job chain per round.
    """
    from orchard.functions.columns import score_key
    from orchard.operators.ranking import index_rows
    numeric = dict(scores.dtypes)["score"] != "string"
    key = score_key("score") if numeric else F.col("score")
    ranked = index_rows(scores.select("id", "score", key.alias("_key")),
                        [F.col("_key").desc() if descending else F.col("_key").asc(),
                         F.col("id").asc()], name="pos")
    return ranked.select((F.floor(F.col("pos") / k) + 1).cast("int").alias("iteration"),
                         (F.col("pos") % k + 1).cast("int").alias("rank"), "id")
