"""Supervised fit / evaluate jobs and forest-backed round loops.

Each job is load -> split -> fit -> predict -> metric, with only the metric
row coming back.  Splits are md5 hash bands of the row key, so a job gives
the same split on every run and any partitioning.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.operators import committee, evaluate, lal, pool, prep, similarity
from orchard.plans import loop
from orchard.session import cut_lineage, scratch_path
from orchard.sources import tables, text
from orchard.sources.models import ModelStore, data_digest

NUM_TREES = 10
LOOP_ROUNDS = 3       # rounds until the pool is empty: batches are a share of it
LOOP_START = 10
SEPARABLE_START = 200  # rows of both classes, so that every bootstrap sample has both
SEED = 1
REGRESSION_TREES = 50


def one_row(spark: SparkSession, **cols) -> DataFrame:
    """A one-row table of scalar-subquery columns (no join of one-row tables)."""
    return spark.range(1).select(*[c.alias(name) for name, c in cols.items()])


def forest_votes_job(points: DataFrame) -> DataFrame:
    train, test = tables.train_test(points)
    model = committee.fit_forest(train, NUM_TREES, SEED)
    return committee.forest_votes(model, test)


def forest_fit_evaluate(points: DataFrame) -> DataFrame:
    """Accuracy of the hard majority vote and of Spark ML's averaged forest."""
    train, test = tables.train_test(points)
    model = committee.fit_forest(train, NUM_TREES, SEED)
    votes = committee.forest_vote_arrays(model, test)
    hard = committee.predictions(votes, keep=("label",))
    soft = model.transform(committee.with_binary_label(test)).select("label", "prediction")
    acc_vote = evaluate.accuracy(hard).scalar()
    acc_avg = evaluate.accuracy(soft).scalar()
    n_train = train.select(F.count(F.lit(1))).scalar()
    return one_row(points.sparkSession, n_train=n_train, accuracy_vote=acc_vote,
                   accuracy_avg=acc_avg, test_error=F.lit(1.0) - acc_vote)


def forest_importance(points: DataFrame) -> DataFrame:
    train, _ = tables.train_test(points)
    model = committee.fit_forest(train, NUM_TREES, SEED)
    return evaluate.feature_importance(points.sparkSession, model.featureImportances)


def regression_job(orders: DataFrame) -> DataFrame:
    """Forest regressor on order attributes -> total price; MSE on a 20 % hash band."""
    feats = orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("double").alias("cust"),
        F.year("o_orderdate").cast("double").alias("year"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0)
         .otherwise(2.0).alias("status"),
        F.col("o_totalprice").alias("label"))
    cols = ["cust", "year", "month", "priority", "status"]
    data = VectorAssembler(inputCols=cols, outputCol="fv", handleInvalid="keep").transform(
        prep.hash_split(feats.na.fill(0.0, cols), "o_orderkey", [0.8, 0.2], SEED))
    train, test = data.where("split = 0"), data.where("split = 1")
    model = RandomForestRegressor(featuresCol="fv", labelCol="label", numTrees=REGRESSION_TREES,
                                  maxDepth=5, seed=SEED).fit(committee.fit_order(train, "o_orderkey"))
    pred = model.transform(test)
    return evaluate.mse(pred).select("mse", F.lit(REGRESSION_TREES).alias("num_trees"))


# Fixed values of the supervised CSV job: training share, trees, missing mark.
CSV_SPLIT = (0.7, 0.3)
CSV_TREES = 100
CSV_MISSING = "?"


def csv_pipeline(feature_cols: list[str], label_col: str, positive: str, num_trees: int) -> Pipeline:
    """Text columns -> numbers and a 0/1 label -> scaled vector -> forest, as
    one Spark ML pipeline: what is fitted, stored and reloaded is one unit."""
    numbers = [f"_x{i}" for i in range(len(feature_cols))]
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {x}" for c, x in zip(feature_cols, numbers))
    yes = positive.replace("\\", "\\\\").replace("'", "\\'")
    recode = f"CAST(CASE WHEN {label_col} = '{yes}' THEN 1 ELSE 0 END AS DOUBLE) AS _y"
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT {casts}, {recode} FROM __THIS__"),
        VectorAssembler(inputCols=numbers, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_fv", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="_fv", labelCol="_y", numTrees=num_trees, seed=SEED,
                               maxDepth=committee.FOREST_MAX_DEPTH, maxBins=committee.FOREST_MAX_BINS)])


def csv_supervised_job(spark: SparkSession, path: str, id_col: str, label_col: str, positive: str,
                       store: ModelStore, num_trees: int = CSV_TREES) -> DataFrame:
    """CSV with a quoted header -> drop rows with a missing value -> hash split
    -> load the stored pipeline or fit and store it -> metrics on the test band.

    All columns but ``id_col`` and ``label_col`` are features.  The pipeline is
    stored by the digest of its training rows and parameters, so the same file
    finds it again and any other row trains anew.  One row: ``from_store``,
    sizes, accuracy, confusion counts, AUC.  The scaler sees training rows only.
    """
    raw = spark.read.option("header", True).option("nullValue", CSV_MISSING).csv(path)
    # names by position from here on: a header may hold any characters
    by_role = {id_col: "_id", label_col: "_label"}
    rows = raw.toDF(*[by_role.get(c, f"_c{i}") for i, c in enumerate(raw.columns)]).dropna()
    features = [c for c in rows.columns if c not in by_role.values()]
    data = prep.hash_split(rows, "_id", CSV_SPLIT, SEED)
    train, test = data.where("split = 0").drop("split"), data.where("split = 1").drop("split")
    fit_on = committee.fit_order(train, "_id")
    key = data_digest(train, header=raw.columns, positive=positive, trees=num_trees)
    model, found = store.load_or_train(
        key, PipelineModel.load, lambda: csv_pipeline(features, "_label", positive, num_trees).fit(fit_on))
    pred = model.transform(test).select(
        F.col("_y").alias("label"), "prediction", vector_to_array("probability")[1].alias("score"))
    conf = evaluate.confusion(pred)
    return one_row(spark, from_store=F.lit(found), n_train=train.select(F.count(F.lit(1))).scalar(),
                   n_test=test.select(F.count(F.lit(1))).scalar(), num_trees=F.lit(num_trees),
                   accuracy=evaluate.accuracy(pred).scalar(), **{c: conf.select(c).scalar() for c in conf.columns},
                   auc=evaluate.auc(pred).scalar())


def orders_csv(spark: SparkSession, orders: DataFrame) -> str:
    """Orders as a quoted CSV: three features that tell status F from the rest,
    on unlike scales; orders of the last priority lack one of them."""
    flag = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    urgent = F.when(F.col("o_orderpriority").startswith("5"), F.lit(CSV_MISSING))
    path = scratch_path(spark, f"orders-csv-{uuid.uuid4().hex}")
    orders.select(F.col("o_orderkey").alias("key"), (flag * 250 - 7).alias("wide"),
                  (flag * -0.5).alias("narrow"), urgent.otherwise((flag + 3).cast("string")).alias("shifted"),
                  F.col("o_orderstatus").alias("status")) \
        .write.option("header", True).option("quoteAll", True).csv(path)
    return path


def quality_job(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """labels join documents: forest classifier of ``quality`` from text features.

    The texts are read once: the fit and every metric read the written features."""
    feats = prep.document_features(documents).join(labels.select("doc_id", "quality"), "doc_id")
    cols = list(prep.DOCUMENT_FEATURES)
    data = cut_lineage(prep.hash_split(feats, "doc_id", [0.8, 0.2], SEED))
    data = VectorAssembler(inputCols=cols, outputCol="fv").transform(data) \
        .withColumn("label", F.col("quality").cast("double"))
    train, test = data.where("split = 0"), data.where("split = 1")
    model = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=NUM_TREES,
                                   maxDepth=committee.FOREST_MAX_DEPTH, seed=SEED).fit(
        committee.fit_order(train, "doc_id"))
    pred = model.transform(test)
    conf = evaluate.confusion(pred)
    return one_row(documents.sparkSession, accuracy=evaluate.accuracy(pred).scalar(),
                   **{c: conf.select(c).scalar() for c in conf.columns})


def multiclass_job(documents: DataFrame) -> DataFrame:
    """A several-class forest job: the language of a document from its
    whole-text features, read from the texts once; accuracy and the most
    important feature."""
    feats = prep.document_features(documents, keep=("lang", F.length("text").alias("_len")))
    feats = feats.withColumn("avg_token_len", F.col("_len") / F.greatest(F.col("n_tokens"), F.lit(1.0)))
    cols = list(prep.DOCUMENT_FEATURES) + ["avg_token_len"]
    indexer = StringIndexer(inputCol="lang", outputCol="label",
                            stringOrderType="alphabetAsc")
    data = VectorAssembler(inputCols=cols, outputCol="fv").transform(cut_lineage(
        prep.hash_split(feats.where(F.col("lang").isNotNull()), "doc_id", [0.8, 0.2], SEED)))
    data = indexer.fit(data).transform(data)
    train, test = data.where("split = 0"), data.where("split = 1")
    model = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=NUM_TREES,
                                   maxDepth=committee.FOREST_MAX_DEPTH, seed=SEED).fit(
        committee.fit_order(train, "doc_id"))
    acc = evaluate.accuracy(model.transform(test)).scalar()
    imp = evaluate.feature_importance(documents.sparkSession, model.featureImportances)
    top = imp.orderBy(F.desc("importance"), "feature").limit(1).select("feature").scalar()
    return one_row(documents.sparkSession, accuracy=acc, num_classes=F.lit(model.numClasses),
                   top_feature=top)


def label_encoded_job(part: DataFrame) -> DataFrame:
    """Text columns through one shared dictionary, then a forest classifier."""
    enc = prep.shared_label_encode(part, ["p_brand", "p_type"])
    data = enc.select("p_partkey", F.col("p_brand_code").cast("double").alias("brand"),
                      F.col("p_type_code").cast("double").alias("type"),
                      F.col("p_retailprice").alias("price"),
                      F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("label"))
    data = VectorAssembler(inputCols=["brand", "type", "price"], outputCol="fv").transform(
        prep.hash_split(data, "p_partkey", [0.7, 0.3], SEED))
    train, test = data.where("split = 0"), data.where("split = 1")
    model = RandomForestClassifier(featuresCol="fv", labelCol="label", numTrees=NUM_TREES,
                                   maxDepth=committee.FOREST_MAX_DEPTH, maxBins=64,
                                   seed=SEED).fit(committee.fit_order(train, "p_partkey"))
    acc = evaluate.accuracy(model.transform(test)).scalar()
    imp = evaluate.feature_importance(part.sparkSession, model.featureImportances)
    top = imp.orderBy(F.desc("importance"), "feature").limit(1).select("feature").scalar()
    return one_row(part.sparkSession, accuracy=acc, top_feature=top)


def forest_loop(spark: SparkSession, points: DataFrame, kind: str,
                rounds: int = LOOP_ROUNDS, materialize: bool = False) -> DataFrame:
    """A full active-learning run with a forest committee, until every row of
    the pool is labelled; history without timings.

    Pool and test points are derived once, as every round reads them several
    times: ``materialize=True`` checkpoints them, for features that are expensive
    to derive (whole-text features); a large pool of plain columns is written as
    Parquet, which is read in columns.
    """
    if materialize:
        pool_points, test = (cut_lineage(part) for part in tables.train_test(points))
    else:
        pool_points, test = tables.written_train_test(points)
    start = pool.start_one_per_class(pool_points, LOOP_START, SEED)
    k = -(-(pool_points.count() - LOOP_START) // rounds)
    if kind == "random":
        strat = loop.random_strategy(SEED)
    elif kind == "uncertainty":
        strat = loop.uncertainty_strategy()
    elif kind == "density":
        reference = pool.fetch_unlabeled(pool_points, start, LOOP_START)
        total = cut_lineage(similarity.reference_total(reference))
        strat = loop.density_strategy(total)
    elif kind == "lal":
        labeled = pool.fetch_labeled(pool_points, start, LOOP_START)
        model = committee.fit_forest(labeled, NUM_TREES, SEED)
        votes = committee.forest_vote_arrays(model, labeled)
        standin = cut_lineage(lal.gain_training_standin(votes, labeled))
        regressor = lal.fit_gain_regressor(standin, num_trees=NUM_TREES, seed=SEED)
        strat = loop.lal_strategy(regressor)
    else:
        raise ValueError(f"unknown strategy {kind!r}")
    res = loop.run_loop(spark, pool_points, start, LOOP_START, strat, k, test=test,
                        fit_committee=True, num_trees=NUM_TREES, seed=SEED)
    return res.history.select("iteration", "n_labeled", "n_unlabeled",
                              F.round("accuracy", 6).alias("accuracy"))


#: Which rows give the means and deviations that the test file is scaled by.
SCALE_TEST_BY = ("train", "test")


def dataset_points(spark: SparkSession, train_path: str, test_path: str, sep: str = " ",
                   recode: str | None = "sign", scale_test_by: str = "train") -> tuple[DataFrame, DataFrame]:
    """A train and a test text file as scaled points: (pool, test).

    Lines are parsed in file order (ids from 0 in each file), labels recoded,
    features scaled to mean 0 and sample deviation 1.  The training file is
    scaled by itself, the test file by the training statistics, or by its own
    with ``scale_test_by="test"``.  Both tables are written once to the shared
    checkpoint folder, as every round reads them.
    """
    if scale_test_by not in SCALE_TEST_BY:
        raise ValueError(f"unknown scale_test_by {scale_test_by!r}")
    train, test = text.read_train_test(spark, train_path, test_path, sep, recode)
    scaled = prep.standard_scale(train, train), prep.standard_scale(train if scale_test_by == "train" else test, test)
    return cut_lineage(scaled[0]), cut_lineage(scaled[1])


def dataset_job(spark: SparkSession, train_path: str, test_path: str, strategy: loop.Strategy, n_start: int,
                rounds: int, *, seed: int = SEED, num_trees: int = NUM_TREES, fit_committee: bool = True,
                sep: str = " ", recode: str | None = "sign", scale_test_by: str = "train",
                state_path: str | None = None) -> tuple[loop.LoopResult, DataFrame]:
    """A whole run from two text files: text -> recode -> scale -> one labelled
    row per class -> rounds until the pool is empty.

    Returns the run and the scaled test table.  With ``fit_committee`` a forest
    is fitted in every round and the history holds its test accuracy;
    ``strategy`` may bring a fixed committee instead.  The batch size empties
    the pool in ``rounds`` rounds.  A killed run goes on in ``state_path``.
    """
    points, test = dataset_points(spark, train_path, test_path, sep, recode, scale_test_by)
    start = pool.start_one_per_class(points, n_start, seed)
    k = max(1, -(-(points.count() - n_start) // rounds))
    res = loop.run_loop(spark, points, start, n_start, strategy, k, test=test if fit_committee else None,
                        fit_committee=fit_committee, num_trees=num_trees, seed=seed, state_path=state_path)
    return res, test


def separable_points(orders: DataFrame) -> DataFrame:
    """Orders as an exactly separable task: one 0/1 feature equal to the label
    (status F), so the votes of every tree are known."""
    flag = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return orders.select(F.col("o_orderkey").alias("id"), F.array(flag).alias("features"), flag.alias("label"))


def separable_loop(spark: SparkSession, orders: DataFrame, rounds: int = LOOP_ROUNDS) -> loop.LoopResult:
    """The uncertainty loop with a forest on the separable task, from the
    smallest ids until the pool is empty.  All margins are equal, so batches
    follow the ids, and the accuracy is 1 in every round."""
    pool_points, test = tables.written_train_test(separable_points(orders))
    start = pool.start_first_k(pool_points, SEPARABLE_START)
    k = -(-(pool_points.count() - SEPARABLE_START) // rounds)
    return loop.run_loop(spark, pool_points, start, SEPARABLE_START, loop.uncertainty_strategy(), k,
                         test=test, fit_committee=True, num_trees=NUM_TREES, seed=SEED)


def separable_gain(orders: DataFrame, num_trees: int = REGRESSION_TREES) -> DataFrame:
    """The gain regressor where every state feature equals the gain: (id, prediction)."""
    train, test = tables.train_test(separable_points(orders))
    states = [F.col("label").alias(c) for c in lal.STATE_COLS]
    model = lal.fit_gain_regressor(train.select(*states, F.col("label").alias("gain")), num_trees, SEED)
    return lal.predict_gain(test.select("id", *states), model)


# Fixed values of the stepped gain task: every state feature is a level of the
# row times its weight, and the gain is the level's share.
GAIN_LEVELS = 8
GAIN_WEIGHTS = {"f1": 0.125, "f2": 0.0625, "f3": 0.25, "f6": 0.03125, "f8": 4.0}


def gain_file(spark: SparkSession, orders: DataFrame) -> str:
    """A gain table as text, a row per order: all state features vary, and each
    alone determines the gain, so what a fitted regressor predicts is known."""
    level = (F.col("o_orderkey") % GAIN_LEVELS).cast("double")
    cells = {p: level * F.lit(GAIN_WEIGHTS[c]) for p, c in zip(lal.TRAIN_FILE_COLUMNS, lal.STATE_COLS)}
    line = F.concat_ws(" ", *[cells.get(p, F.lit(0.0)).cast("string") for p in range(max(cells) + 1)],
                       (level / GAIN_LEVELS).cast("string"))
    path = scratch_path(spark, f"gain-levels-{uuid.uuid4().hex}")
    orders.select(line).write.text(path)
    return path


def stored_regressor_job(spark: SparkSession, orders: DataFrame, customers: DataFrame, k: int,
                         num_trees: int = REGRESSION_TREES) -> DataFrame:
    """File -> gain table -> load or train -> pick, twice: the first call fits
    and stores the regressor, the second finds it.  The pool is ``customers``,
    whose level grows with their balance; only the richest have the last one."""
    store = ModelStore(spark, scratch_path(spark, f"models-{uuid.uuid4().hex}"))
    path = gain_file(spark, orders)
    low, high = customers.select(F.min("c_acctbal"), F.max("c_acctbal")).first()
    share = (F.col("c_acctbal") - F.lit(low)) / F.lit(float(high - low) or 1.0)
    level = F.floor(share * F.lit(GAIN_LEVELS - 1)).cast("double")
    state = customers.select(F.col("c_custkey").alias("id"), *[(level * F.lit(w)).alias(c) for c, w in GAIN_WEIGHTS.items()])
    out = None
    for call in ("first", "second"):
        model, found = lal.stored_gain_regressor(text.read_gain_table(spark, path), store, num_trees, SEED)
        picks = lal.select_lal(state, model, k).select(
            F.lit(call).alias("call"), F.lit(found).alias("from_store"), "rank", "id", F.round("score", 6).alias("score"))
        out = picks if out is None else out.unionByName(picks)
    return out


def lal_one_selection(spark: SparkSession, points: DataFrame, num_trees: int = 50) -> DataFrame:
    """A single learned-gain selection: start with one labelled row per class,
    fit a ``num_trees`` committee, build the state features of every
    unlabelled row, predict their gain, pick the best.  Returns the pick."""
    pool_points, _ = tables.train_test(points)
    start = pool.start_one_per_class(pool_points, 2, SEED)
    labeled = cut_lineage(pool.fetch_labeled(pool_points, start, 2))
    unlabeled = pool.fetch_unlabeled(pool_points, labeled, 2)
    model = committee.fit_forest(labeled, num_trees, SEED)
    standin = lal.gain_training_standin(committee.forest_vote_arrays(model, labeled), labeled)
    regressor = lal.fit_gain_regressor(standin, num_trees=NUM_TREES, seed=SEED)
    state = lal.lal_state(committee.forest_vote_arrays(model, unlabeled), labeled)
    return lal.select_lal(state, regressor, 1)
