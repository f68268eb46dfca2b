"""Learned gain ("LAL") selection.

State features per unlabelled row, from committee votes and the labelled set:

    f1  mean vote                         (per row)
    f2  sample SD of the votes (n - 1)    (per row)
    f3  share of positives among labelled rows     (scalar)
    f6  mean of f2 over the unlabelled rows        (scalar)
    f8  number of labelled rows                    (scalar)

One pass over the pool writes the narrow table (id, f1, f2) to the checkpoint
folder; f6 and the predictions come from it, so the committee votes once.  The
three scalars are read back once and enter as literals, so every later pass sees
the same bits.  A regressor predicts the gain of labelling each row; the largest
predicted gain is chosen, ties by id.

Prediction is factorised: f1 and f2 follow from the number of votes for class 1
and the other features are scalars, so a round has at most (trees + 1) distinct
states, however large the pool.  The regressor, of thousands of trees, predicts
these once each; the predictions return to the rows by a join on the state.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.operators.committee import fit_order, stats_of
from orchard.operators.select import select_by_prediction
from orchard.session import BROADCAST_BYTES, cut_lineage
from orchard.sources.models import ModelStore, data_digest, load_or_train

STATE_COLS = ("f1", "f2", "f3", "f6", "f8")
# Column positions of the five state features in the
# regressor's text training file (0-based), the target being the last column.
TRAIN_FILE_COLUMNS = (0, 1, 2, 5, 7)
#: Equal training rows written out by one task.
COPY_RUN = 10_000
# Fixed values of the linear stand-in gain used where SQL must check the pick.
LINEAR_GAIN = {"f1": 0.5, "f2": 2.0, "f3": -0.25, "f6": 1.0, "f8": 0.001}


def lal_state(votes: DataFrame, labeled_points: DataFrame) -> DataFrame:
    stats = cut_lineage(stats_of(votes).select(
        "id", F.col("mean_vote").alias("f1"),
        F.coalesce(F.col("sd_vote"), F.lit(0.0)).alias("f2")))
    f3, f8 = labeled_points.select(F.avg(F.col("label").cast("double")), F.count(F.lit(1))).first()
    f6 = stats.select(F.avg("f2")).first()[0]
    return stats.select("id", "f1", "f2", F.lit(f3).cast("double").alias("f3"),
                        F.lit(f6).cast("double").alias("f6"), F.lit(f8).cast("bigint").alias("f8"))


def linear_gain(state: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = weights or LINEAR_GAIN
    expr = sum((F.col(c).cast("double") * F.lit(float(w[c])) for c in STATE_COLS), F.lit(0.0))
    return state.select("id", expr.alias("prediction"))


def select_lal_linear(state: DataFrame, k: int = 1,
                      weights: dict[str, float] | None = None) -> DataFrame:
    return select_by_prediction(linear_gain(state, weights), k)


def _assembled(state: DataFrame) -> DataFrame:
    cast = state.select("id", *[F.col(c).cast("double").alias(c) for c in STATE_COLS])
    return VectorAssembler(inputCols=list(STATE_COLS), outputCol="sv").transform(cast)


def distinct_states(state: DataFrame) -> DataFrame:
    """The different states of a pool: one hash aggregate, combined map-side."""
    return state.groupBy(*STATE_COLS).agg(F.min("id").alias("id"))


def predict_gain(state: DataFrame, model: RandomForestRegressionModel) -> DataFrame:
    """id and predicted gain of every row, one prediction per distinct state.

    ``state`` must give the same bits when it is read twice (as ``lal_state``
    does).  The predictions are broadcast within a checked size.
    """
    model = model.copy().setFeaturesCol("sv").setPredictionCol("prediction")
    known = cut_lineage(model.transform(_assembled(distinct_states(state))).select(*STATE_COLS, "prediction"))
    side = known.select(*[F.col(c).alias(f"_{c}") for c in STATE_COLS], "prediction")
    if known.limit(BROADCAST_BYTES // 64 + 1).count() * 64 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    same = [F.col(c).cast("double") == F.col(f"_{c}") for c in STATE_COLS]
    return state.join(side, same).select("id", "prediction")


def select_lal(state: DataFrame, model: RandomForestRegressionModel, k: int = 1) -> DataFrame:
    return select_by_prediction(predict_gain(state, model), k)


def numbered_copies(rows: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and ``copy``, the number of a row among equal ones (from 0).

    Equal rows are counted with map-side combine and written out again in runs
    of COPY_RUN, each from its own task: no group of equal rows is collected.
    """
    runs = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPY_RUN))).alias("_run"))
    first = F.col("_run") * COPY_RUN
    last = F.least(F.col("_n"), first + COPY_RUN) - 1
    return runs.repartition(*cols, "_run").select(*cols, F.explode(F.sequence(first, last)).alias("copy"))


def _fitted(train: DataFrame, num_trees: int, seed: int, max_depth: int) -> RandomForestRegressionModel:
    keys = (*STATE_COLS, "gain")
    rows = numbered_copies(train.select(*[F.col(c).cast("double").alias(c) for c in keys]), *keys)
    data = VectorAssembler(inputCols=list(STATE_COLS), outputCol="sv").transform(fit_order(rows, *keys, "copy"))
    return RandomForestRegressor(featuresCol="sv", labelCol="gain", numTrees=num_trees,
                                 maxDepth=max_depth, seed=seed).fit(data)


def fit_gain_regressor(train: DataFrame, num_trees: int = 100, seed: int = 1,
                       model_path: str | None = None,
                       max_depth: int = 5) -> RandomForestRegressionModel:
    """Load the regressor from ``model_path`` if one is there, else fit (and save) it.

    ``train`` has the five state columns and ``gain``; rows are put in a fixed
    order, as the bootstrap samples depend on it.
    """
    def fit() -> RandomForestRegressionModel:
        return _fitted(train, num_trees, seed, max_depth)

    return load_or_train(model_path, RandomForestRegressionModel.load, fit) if model_path else fit()


def stored_gain_regressor(train: DataFrame, store: ModelStore, num_trees: int = 2000, seed: int = 1,
                          max_depth: int = 5) -> tuple[RandomForestRegressionModel, bool]:
    """(regressor, whether it was in the store), keyed by the rows and parameters."""
    key = data_digest(train, num_trees=num_trees, seed=seed, max_depth=max_depth, kind="gain regressor")
    return store.load_or_train(key, RandomForestRegressionModel.load,
                               lambda: _fitted(train, num_trees, seed, max_depth))


def gain_training_standin(votes_on_labeled: DataFrame, labeled_points: DataFrame) -> DataFrame:
    """STAND-IN regressor training table of the real schema.

    The original training file comes from an offline simulation that is not
    part of the library.  Here each labelled row gets its state features and
    gain = |label - f1|, how far the committee is from the known answer.
    """
    state = lal_state(votes_on_labeled, labeled_points)
    return state.join(labeled_points.select("id", "label"), "id").select(
        *STATE_COLS, F.abs(F.col("label") - F.col("f1")).alias("gain"))
