"""Committee votes and per-row vote statistics.

Votes come in two layouts.  ``votes(id, tree, vote)`` is the long table, one
row per (row, committee member), vote 0.0 or 1.0; its statistics need a
group-by on id.  The per-row layout keeps the row and adds ``votes
ARRAY<DOUBLE>``; its statistics are a projection, so scoring a pool needs no
shuffle at all - the form the strategies use.

Members are either fixed stumps (SQL-expressible, used for oracle checks) or
the trees of a Spark ML random forest.  Forest votes come from one pass over
the rows through the public per-tree models, one prediction column each.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.functions.columns import binary_sd, class0_share, half_entropy, margin

# Fixed values of the forest committee (old-API defaults made explicit).
FOREST_MAX_DEPTH = 4
FOREST_MAX_BINS = 32
FOREST_IMPURITY = "gini"
FOREST_SUBSET = "auto"
# Training rows are dealt into a partition per FIT_ROWS of them, FIT_PARTITIONS
# at least, whatever the session's settings: bootstrap samples depend on the
# partitions and their order.
FIT_PARTITIONS = 16
FIT_ROWS = 250_000
# Label metadata: two nominal classes, so a one-class labelled set still
# trains a two-class forest.
BINARY_LABEL_META = {"ml_attr": {"type": "nominal", "vals": ["0", "1"],
                                 "name": "label"}}


# ----------------------------------------------------------- stumps -------

def stump_vote_arrays(points: DataFrame, members: int = 10) -> DataFrame:
    """All input columns plus ``votes``: member t (0-based) votes 1.0 when the
    sum of the features at positions t, t + members, t + 2 members ... is > 0,
    so the whole vector is read.  Narrow, no shuffle."""
    size = F.size("features")

    def vote(t):
        own = F.aggregate(F.sequence(t, F.greatest(size - 1, t), F.lit(members)), F.lit(0.0),
                          lambda acc, i: acc + F.coalesce(F.get("features", i), F.lit(0.0)))
        return F.when(own > 0, F.lit(1.0)).otherwise(F.lit(0.0))

    return points.select("*", F.array(*[vote(F.lit(t)) for t in range(members)]).alias("votes"))


def explode_votes(arrays: DataFrame) -> DataFrame:
    """The long ``votes(id, tree, vote)`` table from per-row vote arrays."""
    ex = arrays.select("id", F.posexplode("votes").alias("tree", "vote"))
    return ex.select("id", F.col("tree").cast("int").alias("tree"), "vote")


def stump_votes(points: DataFrame, members: int = 10) -> DataFrame:
    return explode_votes(stump_vote_arrays(points.select("id", "features"), members))


# ------------------------------------------------------- statistics -------

def vote_stats(votes: DataFrame) -> DataFrame:
    """Per row: committee size, votes for 1, mean, sample SD, class-0 share.

    One hash aggregation keyed by id (partial + final), so no row's votes are
    ever collected into a list.
    """
    agg = votes.groupBy("id").agg(F.count("vote").alias("_n"), F.sum("vote").alias("_s"))
    return agg.select("id", *_stat_cols(F.col("_n"), F.col("_s")))


def _stat_cols(n, s):
    return [n.alias("n_votes"), s.alias("sum_votes"), F.try_divide(s, n).alias("mean_vote"),
            binary_sd(s, n).alias("sd_vote"), class0_share(s, n).alias("p0")]


def row_vote_stats(arrays: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same statistics from per-row vote arrays: a projection, no shuffle."""
    counted = arrays.select("id", *keep, F.size("votes").cast("bigint").alias("_n"),
                            F.aggregate("votes", F.lit(0.0), lambda a, v: a + v).alias("_s"))
    return counted.select("id", *keep, *_stat_cols(F.col("_n"), F.col("_s")))


def stats_of(votes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Vote statistics of either vote layout (long table or per-row arrays)."""
    if "votes" in votes.columns:
        return row_vote_stats(votes, keep)
    return vote_stats(votes)


def margin_scores(votes: DataFrame) -> DataFrame:
    return stats_of(votes).select("id", margin("p0").alias("margin"))


def half_entropy_scores(votes: DataFrame) -> DataFrame:
    return stats_of(votes).select("id", half_entropy("p0").alias("half_entropy"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """Hard majority of the committee; an exact tie goes to class 0."""
    stats = stats_of(votes)
    return stats.select("id", F.when(F.col("mean_vote") > 0.5, F.lit(1.0))
                        .otherwise(F.lit(0.0)).alias("prediction"))


def predictions(arrays: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, majority vote and mean vote (``score``) of per-row
    vote arrays: one projection."""
    stats = row_vote_stats(arrays, keep)
    return stats.select("id", *keep, F.when(F.col("mean_vote") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
                        .alias("prediction"), F.col("mean_vote").alias("score"))


# ----------------------------------------------------------- forest -------

def with_binary_label(points: DataFrame) -> DataFrame:
    """Vector features and a label column carrying two-class metadata."""
    return points.select("id", array_to_vector("features").alias("fv"),
                         F.col("label").alias("label", metadata=BINARY_LABEL_META))


def fit_order(train: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Training rows in the partitions and order that a forest is fitted on.

    Bootstrap samples depend on both, so rows are hashed by ``keys`` (which tell
    them apart) into a number of partitions that follows from their count alone
    and are sorted inside them: the same forest for any layout of the input and
    any shuffle setting, and more tasks for more rows.  ``rows``: the count,
    where the caller has it.
    """
    n = train.count() if rows is None else rows
    return train.repartition(max(FIT_PARTITIONS, -(-n // FIT_ROWS)), *keys).sortWithinPartitions(*keys)


def fit_forest(train: DataFrame, num_trees: int = 10, seed: int = 1,
               max_depth: int = FOREST_MAX_DEPTH, rows: int | None = None) -> RandomForestClassificationModel:
    """Fit a forest classifier on a labelled point table in ``fit_order``."""
    data = with_binary_label(fit_order(train, "id", rows=rows))
    rf = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=num_trees,
                                maxDepth=max_depth, maxBins=FOREST_MAX_BINS,
                                impurity=FOREST_IMPURITY, featureSubsetStrategy=FOREST_SUBSET,
                                seed=seed)
    return rf.fit(data)


def forest_vote_arrays(model: RandomForestClassificationModel, points: DataFrame) -> DataFrame:
    """All input columns plus ``votes``: every tree's vote, in one scan.

    Each tree predicts in its own column (public per-tree models); then the
    columns become the ``votes`` array: one pass, no join, no shuffle.
    """
    frame = points.select("*", array_to_vector("features").alias("_fv"))
    cols = []
    for t, tree in enumerate(model.trees):
        m = tree.copy()
        m.setFeaturesCol("_fv").setPredictionCol(f"_t{t}").setRawPredictionCol("")
        m.setProbabilityCol("").setLeafCol("")
        frame = m.transform(frame)
        cols.append(f"_t{t}")
    return frame.select(*points.columns, F.array(*[F.col(c) for c in cols]).alias("votes"))


def forest_votes(model: RandomForestClassificationModel, points: DataFrame) -> DataFrame:
    """votes(id, tree, vote) of every tree for every row, in one scan."""
    return explode_votes(forest_vote_arrays(model, points.select("id", "features")))
