"""Registered queries: one Spark plan per operator group, plus SQL oracles.

Every query reads whole driver tables (``sf_dir``) and returns a DataFrame
whose computed columns carry the same names as the matching oracle SQL.
Doubles that come out of float arithmetic are rounded to 6 places on both
sides.  Queries whose result depends on a fitted forest have no oracle; the
tests check their invariants instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.functions import columns as C
from orchard.operators import committee, evaluate, joins, lal, pool, prep, ranking, select, similarity
from orchard.plans import jobs, loop
from orchard.session import cut_lineage, scratch_path
from orchard.sources import tables, text
from orchard.sources.models import ModelStore

# Fixed parameters of the registered queries.
START_K = 10           # size of the first-k start set
BATCH_K = 10           # batch size of the exact loops
ROUNDS = 5             # rounds of the exact loops until the pool is empty
SELECT_K = 20          # batch size of the single selections
LAL_K = 5
RANDOM_SEED = 42
START_SEED = 3
APPLY_SEED = 5
SPLIT_SEED = 11
EXHAUST_K = 12         # 490 pool rows -> 40 full batches and a short one
STUMPS = 10
HIT, ROUND_HIT = 0.4, 0.3   # least cosines of the similarity joins
# A whole-token decimal number (Java regex; \z = true end of input).
NUMERIC_TOKEN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

Query = Callable[[SparkSession, str], DataFrame]
R6 = 6


def _r(c, digits: int = R6):
    return F.round(c, digits)


def _points(spark, sf):
    return tables.embedding_points(spark, sf)


def _start(points):
    return pool.start_first_k(points, START_K)


def _unlabeled(points):
    return pool.fetch_unlabeled(points, _start(points), START_K)


def _labeled(points):
    return pool.fetch_labeled(points, _start(points), START_K)


# ===================================================== projections ========

def q_label_recode(spark, sf):
    emb = tables.read_table(spark, sf, "embeddings")
    sign = F.when(F.col("label") >= 5, F.lit(1)).otherwise(F.lit(-1))
    code = F.when(F.col("label") < 3, F.lit(2)).otherwise(F.lit(4))
    return emb.select(F.col("vec_id").alias("id"), sign.alias("raw_sign"),
                      C.recode_sign(sign).alias("y_sign"), code.alias("raw_code"),
                      C.recode_code(code, 2).alias("y_code"))


def q_strip_split_cast(spark, sf):
    docs = tables.read_table(spark, sf, "documents")
    toks = C.tokens("text")
    numeric = F.filter(toks, lambda t: t.rlike(NUMERIC_TOKEN))
    return docs.select(
        "doc_id", F.size(toks).alias("n_tokens"),
        F.try_element_at(toks, F.lit(1)).alias("first_token"),
        F.try_element_at(toks, F.lit(-1)).alias("last_token"),
        F.size(numeric).alias("n_numeric"),
        F.array_max(C.to_double_array(numeric)).alias("max_numeric"))


def q_props_cast(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    parts = C.split_fixed("props", ":")
    k = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "[} ]", "")
    return ev.select(F.col("event_id").alias("id"), k.try_cast("int").alias("k"),
                     F.col("value").cast("string").cast("double").alias("value"))


def q_text_round_trip(spark, sf):
    pts = _points(spark, sf)
    # render and parse in the same row: no join back to the source
    lines = pts.select("id", F.col("features").alias("orig"),
                       prep.labeled_line(quote_label=True).alias("line"))
    back = prep.parse_labeled_line(lines, F.col("line"), sep=" ", unquote=True, keep=("id", "orig"))
    return back.select("id", F.size("tokens").alias("n_fields"), "label",
                       _r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("feature_sum"),
                       (F.col("features") == F.col("orig")).alias("exact"))


def q_missing_filter(spark, sf):
    # orders as small CSV texts: some with a quoted header, a blank line or a ?
    o = tables.read_table(spark, sf, "orders")
    header = F.when(F.col("o_orderstatus") == "P", F.lit('"custkey","priority"\n')).otherwise(F.lit(""))
    blank = F.when(F.col("o_custkey") % 7 == 0, F.lit("\n")).otherwise(F.lit(""))
    prio = F.when(F.col("o_orderpriority").startswith("5"), F.lit("?")).otherwise(
        F.substring("o_orderpriority", 1, 1))
    text_col = F.concat(header, blank, F.col("o_custkey").cast("string"), F.lit(","), prio, F.lit("\n"),
                        F.col("o_orderkey").cast("string"), F.lit(",1"))
    return prep.clean_lines(o.select(F.col("o_orderkey").alias("doc_id"), text_col.alias("text")),
                            "doc_id", "text")


def q_class_distribution(spark, sf):
    lab = tables.read_table(spark, sf, "labels")
    return prep.class_counts(lab, ["quality", "toxic"])


def q_row_identity(spark, sf):
    emb = tables.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return ranking.index_rows(emb, [F.col("id")], name="row_index")


def q_first_n_sample(spark, sf):
    return prep.first_n(_points(spark, sf), 100).select("id", "label")


def _triples_out(df, vec="features"):
    tr = similarity.rows_to_triples(df, vec)
    return tr.select(F.col("i").alias("id"), F.col("j").cast("int").alias("dim"),
                     _r(F.col("value")).alias("value"))


def q_standard_scale(spark, sf):
    pts = _points(spark, sf)
    return _triples_out(prep.standard_scale(pts, pts))


def q_scale_train_apply_test(spark, sf):
    pts = _points(spark, sf)
    train, test = tables.train_test(pts)
    return _triples_out(prep.standard_scale(train, test))


def q_unit_vectors(spark, sf):
    pts = _points(spark, sf)
    ev = tables.read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.array(F.col("value") - F.floor("value"), F.lit(0.0)).alias("features"))
    a = _triples_out(similarity.unit_rows(pts)).withColumn("source", F.lit("embeddings"))
    b = _triples_out(similarity.unit_rows(ev)).withColumn("source", F.lit("events"))
    return a.unionByName(b)


def q_shared_label_encode(spark, sf):
    part = tables.read_table(spark, sf, "part")
    enc = prep.shared_label_encode(part, ["p_brand", "p_type"])
    return enc.select("p_partkey", F.col("p_brand_code"), F.col("p_type_code"))


def q_hash_split(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    return prep.hash_split(orders, "o_orderkey", [0.7, 0.3], SPLIT_SEED).select("o_orderkey", "split")


def q_random_permutation(spark, sf):
    ev = tables.read_table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return prep.random_permutation(ev, RANDOM_SEED)


def q_random_k(spark, sf):
    ev = tables.read_table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return select.select_random(ev, 100, RANDOM_SEED).select("rank", "id")


def q_one_random_per_class(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    return prep.one_random_per_class(ev, "event_id", "event_type", RANDOM_SEED)


def q_sorted_ints(spark, sf):
    orders = tables.read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("value"), F.col("o_orderkey").alias("id"))
    ranked = ranking.index_rows(orders, [F.col("value"), F.col("id")], name="position")
    return ranked.select("position", "value")


# ======================================================== file round trips =
# Data derived from the driver tables is written to the shared scratch folder
# with the sinks and read back with the sources, so the loaders run on whole
# tables.

def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _feature_sum(col="features"):
    return _r(F.aggregate(col, F.lit(0.0), lambda a, x: a + x))


def q_text_file_round_trip(spark, sf):
    path = _scratch(spark, "points-text")
    text.write_points_text(_points(spark, sf).orderBy("id"), path, sep=" ")
    back = text.read_labeled_text(spark, path)
    return back.select("id", F.size("features").alias("n_features"), "label",
                       _feature_sum().alias("feature_sum"))


def q_train_test_files(spark, sf):
    """A train and a test file, fields separated by exactly one space."""
    train, test = tables.train_test(_points(spark, sf))
    paths = [_scratch(spark, name) for name in ("train-text", "test-text")]
    for part, path in zip((train, test), paths):
        text.write_points_text(part.orderBy("id"), path, sep=" ")
    back = text.read_train_test(spark, *paths)
    cols = ["id", F.size("features").alias("n_features"), "label", _feature_sum().alias("feature_sum")]
    return back[0].select(F.lit("train").alias("part"), *cols).unionByName(
        back[1].select(F.lit("test").alias("part"), *cols))


def q_vectors_file(spark, sf):
    """Unlabelled vectors, one per line, from the unlabelled view of the points."""
    path = _scratch(spark, "vectors-text")
    view = text.unlabeled_view(_points(spark, sf)).orderBy("id")
    view.select(F.array_join(F.transform("features", lambda x: x.cast("string")), " ")).write.text(path)
    back = text.read_vectors(spark, path)
    return back.select("id", F.size("features").alias("n_features"), _feature_sum().alias("feature_sum"))


def q_round_log_table(spark, sf):
    """The batches of the random loop through the Parquet sink and back."""
    path = _scratch(spark, "round-log")
    text.write_table(q_loop_random(spark, sf), path)
    return spark.read.parquet(path)


def q_round_log(spark, sf):
    """The committed log of the random loop, read back from its folder."""
    pts, path = _points(spark, sf), _scratch(spark, "round-log-state")
    loop.run_loop(spark, pts, _start(pts), START_K, loop.random_strategy(RANDOM_SEED), _loop_k(pts), state_path=path)
    batches = loop.read_state(spark, path).where("labeled_at > 0").groupBy("labeled_at").agg(
        F.count(F.lit(1)).alias("batch_rows"))
    log = loop.read_log(spark, path)
    return log.join(batches, log["iteration"] == batches["labeled_at"]).select(
        "iteration", "n_labeled", "n_unlabeled", "batch_rows", (F.col("seconds") >= 0).alias("timed"))


def q_csv_supervised_job(spark, sf):
    """The supervised CSV job twice: fitted and stored, then found and reloaded."""
    store = ModelStore(spark, _scratch(spark, "csv-models"))
    path = jobs.orders_csv(spark, tables.read_table(spark, sf, "orders"))
    first, second = [jobs.csv_supervised_job(spark, path, "key", "status", "F", store) for _ in range(2)]
    return first.unionByName(second)


def _sign_files(spark, sf):
    """A train and a test file of the points, labels as -1 and 1."""
    sign = F.when(F.col("label") == 1, F.lit(1)).otherwise(F.lit(-1)).alias("label")
    paths = [_scratch(spark, name) for name in ("dataset-train", "dataset-test")]
    for part, path in zip(tables.train_test(_points(spark, sf)), paths):
        text.write_points_text(part.orderBy("id").select("id", "features", sign), path, sep=" ")
    return paths


def q_dataset_job(spark, sf):
    """Two text files to the last batch: recode, scaling, a start of every class,
    uncertainty rounds of a fixed committee; its accuracy on the scaled test file."""
    strat = loop.uncertainty_strategy(members=lambda u: committee.stump_vote_arrays(u, STUMPS))
    res, test = jobs.dataset_job(spark, *_sign_files(spark, sf), strat, START_K, ROUNDS, seed=START_SEED,
                                 fit_committee=False)
    pred = committee.predictions(committee.stump_vote_arrays(test, STUMPS), keep=("label",))
    return res.batches.select("iteration", "rank", "id", _r(evaluate.accuracy(pred).scalar()).alias("test_accuracy"))


def q_dataset_history(spark, sf):
    """The same run with a forest of its own in every round: sizes, and whether
    the round has an accuracy between 0 and 1 and a duration."""
    res, _ = jobs.dataset_job(spark, *_sign_files(spark, sf), loop.random_strategy(RANDOM_SEED), START_K,
                              jobs.LOOP_ROUNDS, seed=START_SEED, scale_test_by="test")
    return res.history.select("iteration", "n_labeled", "n_unlabeled", F.col("accuracy").between(0, 1).alias("measured"),
                              (F.col("seconds") >= 0).alias("timed"))


def q_csv_file_round_trip(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    prio = F.when(F.col("o_orderpriority").startswith("5"), F.lit("?")).otherwise(
        F.substring("o_orderpriority", 1, 1))
    rows = orders.select(F.col("o_totalprice").cast("string").alias("totalprice"),
                         F.col("o_custkey").cast("string").alias("custkey"),
                         prio.alias("priority"),
                         F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("status"))
    path = _scratch(spark, "orders-csv")
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    back = text.read_csv_points(spark, path, header=True, missing="?")
    return back.select(F.size("features").alias("n_features"), "label",
                       _feature_sum().alias("feature_sum"))


def q_triples_file(spark, sf):
    tri = similarity.rows_to_triples(_points(spark, sf))
    path = _scratch(spark, "triples-text")
    tri.select(F.concat_ws(" ", "i", "j", F.col("value").cast("string"))).write.text(path)
    return text.read_triples(spark, path)


def q_ints_file(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    # orders of status P are followed by a blank line
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_custkey").cast("string"), F.lit("\n"))) \
        .otherwise(F.col("o_custkey").cast("string"))
    path = _scratch(spark, "ints-text")
    orders.select(line).write.text(path)
    return ranking.value_positions(text.read_ints(spark, path), "value")


def _gain_file(spark, sf):
    st = _lal_state(_points(spark, sf))
    gain = F.abs(F.lit(0.5) - F.col("f1"))
    cols = ["f1", "f2", "f3", F.lit("0"), F.lit("0"), "f6", F.lit("0"), "f8", gain]
    line = F.concat_ws(" ", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    path = _scratch(spark, "gain-text")
    st.select(line).write.text(path)
    return path


def q_gain_table_file(spark, sf):
    g = text.read_gain_table(spark, _gain_file(spark, sf))
    return g.select(*[_r(F.col(c)).alias(c) for c in ("f1", "f2", "f3", "f6", "f8", "gain")])


def q_regression_table_file(spark, sf):
    g = text.read_regression_table(spark, _gain_file(spark, sf))
    return g.select(F.size("features").alias("n_features"), _feature_sum().alias("feature_sum"),
                    _r(F.col("gain")).alias("gain"))


# ======================================================== pool state ======

def q_start_first_k(spark, sf):
    pts = _points(spark, sf)
    return pool.pool_state(pts, _start(pts), START_K)


def q_start_one_per_class(spark, sf):
    pts = _points(spark, sf)
    return pool.pool_state(pts, pool.start_one_per_class(pts, START_K, START_SEED), START_K)


def q_fetch_labeled(spark, sf):
    return _labeled(_points(spark, sf)).select("id", "label")


def q_fetch_unlabeled(spark, sf):
    return _unlabeled(_points(spark, sf)).select("id", "label")


def _applied(pts):
    start = _start(pts)
    batch = select.select_random(pool.fetch_unlabeled(pts, start, START_K), BATCH_K, APPLY_SEED)
    return pool.apply_batch(start, batch, 1)


def q_apply_batch(spark, sf):
    pts = _points(spark, sf)
    return pool.pool_state(pts, _applied(pts), START_K + BATCH_K)


def q_reset_pool(spark, sf):
    pts = _points(spark, sf)
    return pool.pool_state(pts, pool.reset_pool(_applied(pts)), START_K + BATCH_K)


# ========================================================= committee ======

def _stumps(pts):
    return committee.stump_votes(pts, STUMPS)


def q_committee_votes(spark, sf):
    return _stumps(_points(spark, sf))


def q_vote_stats(spark, sf):
    st = committee.vote_stats(_stumps(_points(spark, sf)))
    return st.select("id", "n_votes", "sum_votes", _r(F.col("mean_vote")).alias("mean_vote"),
                     _r(F.col("sd_vote")).alias("sd_vote"), _r(F.col("p0")).alias("p0"))


def q_margin_scores(spark, sf):
    m = committee.margin_scores(_stumps(_points(spark, sf)))
    return m.select("id", _r(F.col("margin")).alias("margin"))


def q_half_entropy_scores(spark, sf):
    h = committee.half_entropy_scores(_stumps(_points(spark, sf)))
    return h.select("id", _r(F.col("half_entropy")).alias("half_entropy"))


def q_majority_vote(spark, sf):
    return committee.majority_vote(_stumps(_points(spark, sf)))


def _batch_out(b):
    return b.select("rank", "id", _r(F.col("score")).alias("score"))


def q_select_uncertain(spark, sf):
    pts = _points(spark, sf)
    arrays = committee.stump_vote_arrays(_unlabeled(pts), STUMPS)
    return _batch_out(select.select_uncertain(arrays, SELECT_K))


# ======================================================== similarity ======

def _triples_r(t):
    return t.select("i", "j", _r(F.col("value")).alias("value"))


def q_cosine_full(spark, sf):
    return _triples_r(similarity.cosine_full(_points(spark, sf)))


def q_cosine_upper(spark, sf):
    return _triples_r(similarity.cosine_upper(_points(spark, sf)))


def q_triples_transpose(spark, sf):
    return similarity.transpose(similarity.rows_to_triples(_points(spark, sf)))


def q_triples_to_rows(spark, sf):
    rows = similarity.triples_to_rows(similarity.rows_to_triples(_points(spark, sf)))
    return rows.select("id", F.size("features").alias("width"),
                       _r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"),
                       _r(C.l2_norm("features")).alias("norm"))


def q_triple_multiply(spark, sf):
    a = similarity.rows_to_triples(_points(spark, sf))
    return _triples_r(similarity.multiply_triples(a, similarity.transpose(a)))


def q_triple_column_similarity(spark, sf):
    a = similarity.rows_to_triples(_points(spark, sf))
    return _triples_r(similarity.column_similarities(a))


def q_cosine_join(spark, sf):
    """All pairs of vectors with a cosine of at least HIT."""
    return _triples_r(joins.cosine_join(_points(spark, sf), HIT))


def q_sparse_multiply(spark, sf):
    """Documents x word positions (word lengths) times positions x blocks of
    64 positions (a weight by place): two sparse matrices, whole texts."""
    docs = tables.read_table(spark, sf, "documents")
    words = docs.select(F.col("doc_id").alias("i"), F.posexplode(C.tokens("text")).alias("j", "word"))
    a = words.select("i", F.col("j").cast("bigint").alias("j"), F.length("word").cast("double").alias("value"))
    longest = docs.select(F.max(F.size(C.tokens("text")))).first()[0] or 0
    b = spark.range(longest).select(F.col("id").alias("i"), F.floor(F.col("id") / 64).alias("j"), F.pow(
        F.lit(2.0), -(F.col("id") % 8).cast("double")).alias("value"))
    return similarity.multiply_triples(a, b)


def q_density_rounds(spark, sf):
    """Row sums of the sparse similarity matrix (the hits of the cosine join),
    kept up while a random fifth of the pool leaves in each round."""
    pts = _points(spark, sf)
    upper = cut_lineage(joins.cosine_join(pts, ROUND_HIT))
    entries = upper.unionByName(similarity.transpose(upper))
    k = -(-pts.count() // ROUNDS)
    keys = pts.select("id", C.order_key("id", RANDOM_SEED).alias("score"))
    order = cut_lineage(loop.static_sequence(keys, k).select("id", "iteration"))
    sums, out = cut_lineage(similarity.row_sums(entries, order)), None
    for t in range(ROUNDS):
        part = sums.select(F.lit(t).alias("iteration"), "id", (_r(F.col("density")) + 0.0).alias("density"))
        out = part if out is None else out.unionByName(part)
        batch = order.where(F.col("iteration") == t + 1)
        sums = cut_lineage(similarity.shrink_row_sums(sums, entries, batch, k))
        entries = cut_lineage(similarity.drop_entries_of(entries, batch, k))
    return out


def q_drop_labeled_entries(spark, sf):
    # labelled rows leave before the product
    return _triples_r(similarity.cosine_full(_unlabeled(_points(spark, sf))))


def q_density_linear(spark, sf):
    pts = _points(spark, sf)
    d = similarity.density_linear(pts, reference=_unlabeled(pts))
    return d.select("id", _r(F.col("density")).alias("density"))


def q_density_row_sums(spark, sf):
    # the row sums of the similarity matrix, without the matrix
    unl = _unlabeled(_points(spark, sf))
    d = similarity.density_linear(unl, reference=unl)
    return d.select("id", _r(F.col("density")).alias("density"))


def q_select_density(spark, sf):
    pts = _points(spark, sf)
    unl = _unlabeled(pts)
    total = similarity.reference_total(unl)
    arrays = committee.stump_vote_arrays(unl, STUMPS)
    return _batch_out(select.select_density(arrays, total, SELECT_K, beta=1.0))


def q_select_density_squared(spark, sf):
    """Density weighted with exponent 2, the single best row."""
    unl = _unlabeled(_points(spark, sf))
    total = similarity.reference_total(unl)
    arrays = committee.stump_vote_arrays(unl, STUMPS)
    return _batch_out(select.select_density(arrays, total, 1, beta=2.0))


def q_select_density_table(spark, sf):
    """Uncertainty joined with a table of densities (J6)."""
    unl = _unlabeled(_points(spark, sf))
    density = similarity.density_linear(unl, reference=unl)
    arrays = committee.stump_vote_arrays(unl, STUMPS)
    return _batch_out(select.select_density(arrays, density, SELECT_K, beta=1.0))


def q_vector_sum(spark, sf):
    tot = similarity.sum_vector(_points(spark, sf))
    return tot.select(F.posexplode("total").alias("dim", "total")).select(
        F.col("dim").cast("int").alias("dim"), _r(F.col("total")).alias("total"))


# =============================================================== LAL ======

def _lal_state(pts):
    return lal.lal_state(committee.stump_vote_arrays(_unlabeled(pts), STUMPS), _labeled(pts))


def q_lal_state(spark, sf):
    st = _lal_state(_points(spark, sf))
    return st.select("id", _r(F.col("f1")).alias("f1"), _r(F.col("f2")).alias("f2"),
                     _r(F.col("f3")).alias("f3"), _r(F.col("f6")).alias("f6"), "f8")


def q_select_lal_linear(spark, sf):
    return _batch_out(lal.select_lal_linear(_lal_state(_points(spark, sf)), LAL_K))


# ======================================================== evaluation ======

def _stump_predictions(spark, sf):
    return committee.predictions(committee.stump_vote_arrays(_points(spark, sf), STUMPS), keep=("label",))


def q_accuracy(spark, sf):
    return evaluate.accuracy(_stump_predictions(spark, sf)).select(_r(F.col("accuracy")).alias("accuracy"))


def q_test_error(spark, sf):
    return evaluate.test_error(_stump_predictions(spark, sf)).select(
        _r(F.col("test_error")).alias("test_error"))


def q_misclassified(spark, sf):
    return evaluate.misclassified(_stump_predictions(spark, sf)).select("id", "label", "prediction")


def q_mse(spark, sf):
    pred = _stump_predictions(spark, sf).withColumnRenamed("score", "gain_hat")
    return evaluate.mse(pred, "label", "gain_hat").select(_r(F.col("mse")).alias("mse"))


def q_confusion(spark, sf):
    return evaluate.confusion(_stump_predictions(spark, sf))


def q_auc(spark, sf):
    return evaluate.auc(_stump_predictions(spark, sf)).select(_r(F.col("auc")).alias("auc"))


# ============================================================== loops ======

def _loop_k(pts):
    """A batch size that empties the pool in ROUNDS rounds."""
    return -(-(pts.count() - START_K) // ROUNDS)


def q_loop_random(spark, sf):
    pts = _points(spark, sf)
    res = loop.run_loop(spark, pts, _start(pts), START_K, loop.random_strategy(RANDOM_SEED), _loop_k(pts))
    return res.batches


def q_loop_uncertain_fixed_committee(spark, sf):
    pts = _points(spark, sf)
    strat = loop.uncertainty_strategy(members=lambda u: committee.stump_vote_arrays(u, STUMPS))
    res = loop.run_loop(spark, pts, _start(pts), START_K, strat, _loop_k(pts))
    return res.batches


def q_loop_history_fixed_committee(spark, sf):
    pts = _points(spark, sf)
    strat = loop.uncertainty_strategy(members=lambda u: committee.stump_vote_arrays(u, STUMPS))
    res = loop.run_loop(spark, pts, _start(pts), START_K, strat, _loop_k(pts))
    return res.history.select("iteration", "n_labeled", "n_unlabeled")


def q_loop_density_fixed_committee(spark, sf):
    """Density-weighted rounds: the reference total of the initially unlabelled
    rows is computed once; each round scores the remaining pool in one pass."""
    pts = _points(spark, sf)
    total = similarity.reference_total(_unlabeled(pts))
    strat = loop.density_strategy(total, members=lambda u: committee.stump_vote_arrays(u, STUMPS))
    res = loop.run_loop(spark, pts, _start(pts), START_K, strat, _loop_k(pts))
    return res.batches


def q_loop_lal_linear_fixed_committee(spark, sf):
    """LAL rounds with the linear stand-in gain."""
    pts = _points(spark, sf)
    strat = loop.lal_strategy(None, members=lambda u: committee.stump_vote_arrays(u, STUMPS))
    res = loop.run_loop(spark, pts, _start(pts), START_K, strat, _loop_k(pts))
    return res.batches


def q_sequence_to_exhaustion(spark, sf):
    """Random labelling of the whole pool, k at a time, down to a short last batch.

    Random keys do not depend on the labelled set, so the loop collapses to
    one distributed ranking (``loop.static_sequence``); the test suite checks
    it against the round-by-round loop.
    """
    unl = _unlabeled(_points(spark, sf))
    keys = unl.select("id", C.order_key("id", RANDOM_SEED).alias("score"))
    return loop.static_sequence(keys, EXHAUST_K)


def q_lal_one_selection(spark, sf):
    """One LAL pick from a pool with two labelled rows (one per class)."""
    return jobs.lal_one_selection(spark, _points(spark, sf))


# ====================================================== forest (rows) ======

def q_forest_votes(spark, sf):
    return jobs.forest_votes_job(_points(spark, sf))


def q_forest_accuracy(spark, sf):
    return jobs.forest_fit_evaluate(_points(spark, sf))


def q_forest_importance(spark, sf):
    return jobs.forest_importance(_points(spark, sf))


def q_forest_regression_mse(spark, sf):
    return jobs.regression_job(tables.read_table(spark, sf, "orders"))


def q_quality_forest(spark, sf):
    return jobs.quality_job(tables.read_table(spark, sf, "documents"),
                            tables.read_table(spark, sf, "labels"))


def q_multiclass_forest(spark, sf):
    return jobs.multiclass_job(tables.read_table(spark, sf, "documents"))


def q_label_encoded_forest(spark, sf):
    return jobs.label_encoded_job(tables.read_table(spark, sf, "part"))


def _orders(spark, sf):
    return tables.read_table(spark, sf, "orders")


def q_forest_separable_votes(spark, sf):
    return jobs.forest_votes_job(jobs.separable_points(_orders(spark, sf)))


def q_forest_separable_metrics(spark, sf):
    return jobs.forest_fit_evaluate(jobs.separable_points(_orders(spark, sf)))


def q_forest_separable_importance(spark, sf):
    return jobs.forest_importance(jobs.separable_points(_orders(spark, sf)))


def q_gain_regressor_separable(spark, sf):
    return jobs.separable_gain(_orders(spark, sf)).select("id", _r(F.col("prediction")).alias("prediction"))


def q_gain_regressor_stored(spark, sf):
    """The regressor fitted from a file of thousands of rows, stored, found again."""
    return jobs.stored_regressor_job(spark, _orders(spark, sf), tables.read_table(spark, sf, "customer"), LAL_K)


def q_loop_separable_history(spark, sf):
    return jobs.separable_loop(spark, _orders(spark, sf)).history.drop("seconds")


def q_loop_separable_batches(spark, sf):
    return jobs.separable_loop(spark, _orders(spark, sf)).batches


def q_loop_uncertain_forest(spark, sf):
    return jobs.forest_loop(spark, tables.document_points(spark, sf), "uncertainty", materialize=True)


def q_loop_density_forest(spark, sf):
    return jobs.forest_loop(spark, tables.document_points(spark, sf), "density", materialize=True)


def q_loop_random_forest(spark, sf):
    return jobs.forest_loop(spark, tables.document_points(spark, sf), "random", materialize=True)


def q_loop_uncertain_orders_forest(spark, sf):
    """The uncertainty loop over the large ``orders`` pool."""
    return jobs.forest_loop(spark, tables.order_points(spark, sf), "uncertainty")


def q_loop_lal_forest(spark, sf):
    return jobs.forest_loop(spark, tables.document_points(spark, sf), "lal", materialize=True)


QUERIES: dict[str, Query] = {
    "label_recode": q_label_recode,
    "strip_split_cast": q_strip_split_cast,
    "props_cast": q_props_cast,
    "text_round_trip": q_text_round_trip,
    "missing_filter": q_missing_filter,
    "class_distribution": q_class_distribution,
    "row_identity": q_row_identity,
    "first_n_sample": q_first_n_sample,
    "standard_scale": q_standard_scale,
    "scale_train_apply_test": q_scale_train_apply_test,
    "unit_vectors": q_unit_vectors,
    "shared_label_encode": q_shared_label_encode,
    "hash_split": q_hash_split,
    "random_permutation": q_random_permutation,
    "random_k": q_random_k,
    "one_random_per_class": q_one_random_per_class,
    "sorted_ints": q_sorted_ints,
    "text_file_round_trip": q_text_file_round_trip,
    "train_test_files": q_train_test_files,
    "vectors_file": q_vectors_file,
    "round_log_table": q_round_log_table,
    "round_log": q_round_log,
    "csv_supervised_job": q_csv_supervised_job,
    "dataset_job": q_dataset_job,
    "dataset_history": q_dataset_history,
    "csv_file_round_trip": q_csv_file_round_trip,
    "triples_file": q_triples_file,
    "ints_file": q_ints_file,
    "gain_table_file": q_gain_table_file,
    "regression_table_file": q_regression_table_file,
    "start_first_k": q_start_first_k,
    "start_one_per_class": q_start_one_per_class,
    "fetch_labeled": q_fetch_labeled,
    "fetch_unlabeled": q_fetch_unlabeled,
    "apply_batch": q_apply_batch,
    "reset_pool": q_reset_pool,
    "committee_votes": q_committee_votes,
    "vote_stats": q_vote_stats,
    "margin_scores": q_margin_scores,
    "half_entropy_scores": q_half_entropy_scores,
    "majority_vote": q_majority_vote,
    "select_uncertain": q_select_uncertain,
    "cosine_full": q_cosine_full,
    "cosine_upper": q_cosine_upper,
    "triples_transpose": q_triples_transpose,
    "triples_to_rows": q_triples_to_rows,
    "triple_multiply": q_triple_multiply,
    "triple_column_similarity": q_triple_column_similarity,
    "cosine_join": q_cosine_join,
    "sparse_multiply": q_sparse_multiply,
    "density_rounds": q_density_rounds,
    "drop_labeled_entries": q_drop_labeled_entries,
    "density_linear": q_density_linear,
    "density_row_sums": q_density_row_sums,
    "select_density": q_select_density,
    "select_density_squared": q_select_density_squared,
    "select_density_table": q_select_density_table,
    "vector_sum": q_vector_sum,
    "lal_state": q_lal_state,
    "select_lal_linear": q_select_lal_linear,
    "accuracy": q_accuracy,
    "test_error": q_test_error,
    "misclassified": q_misclassified,
    "mse": q_mse,
    "confusion": q_confusion,
    "auc": q_auc,
    "loop_random": q_loop_random,
    "loop_uncertain_fixed_committee": q_loop_uncertain_fixed_committee,
    "loop_history_fixed_committee": q_loop_history_fixed_committee,
    "loop_density_fixed_committee": q_loop_density_fixed_committee,
    "loop_lal_linear_fixed_committee": q_loop_lal_linear_fixed_committee,
    "sequence_to_exhaustion": q_sequence_to_exhaustion,
    "forest_votes": q_forest_votes,
    "forest_accuracy": q_forest_accuracy,
    "forest_importance": q_forest_importance,
    "forest_regression_mse": q_forest_regression_mse,
    "quality_forest": q_quality_forest,
    "label_encoded_forest": q_label_encoded_forest,
    "multiclass_forest": q_multiclass_forest,
    "forest_separable_votes": q_forest_separable_votes,
    "forest_separable_metrics": q_forest_separable_metrics,
    "forest_separable_importance": q_forest_separable_importance,
    "gain_regressor_separable": q_gain_regressor_separable,
    "gain_regressor_stored": q_gain_regressor_stored,
    "loop_separable_history": q_loop_separable_history,
    "loop_separable_batches": q_loop_separable_batches,
    "loop_random_forest": q_loop_random_forest,
    "loop_uncertain_forest": q_loop_uncertain_forest,
    "loop_density_forest": q_loop_density_forest,
    "loop_lal_forest": q_loop_lal_forest,
    "loop_uncertain_orders_forest": q_loop_uncertain_orders_forest,
    "lal_one_selection": q_lal_one_selection,
}
