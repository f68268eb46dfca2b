"""Query strategies: score the unlabelled rows, hand out the best k.

A pick of a fixed k ends in ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: a per-partition top-k, then a merge in one task.  A
batch that is a share of the pool (``share=True``, as the round loop asks) would
send that share through the one task, so it is selected in place instead:
quantile sketches with map-side combine narrow the score key to a cut-off, exact
counts check it, and only the rows up to it are range-partitioned and numbered
(``smallest_k``).  Ties are broken by id, and scores are rounded to 9 places
before sorting so float noise cannot swap near-equal rows.

Batch schema: ``rank INT, id BIGINT, score DOUBLE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.functions.columns import binary_entropy, half_entropy, margin, numeric_key, order_key, score_key
from orchard.operators.committee import stats_of
from orchard.operators.ranking import index_rows
from orchard.operators.similarity import density_from_total
from orchard.session import cut_lineage

# Narrowing stops when the rows left are at most this many times the rows wanted.
NARROW = 4
# Relative rank accuracy of the quantile sketches.
SKETCH = 10_000


def cut_off(rows: DataFrame, codes: tuple[str, ...], k: int, narrow: int = NARROW):
    """A condition that holds for the k smallest rows by ``codes`` and for at
    most about ``narrow * k`` rows in all.

    codes: numeric columns that never decrease along the order, most
    significant first; a tie at the cut-off of one goes on to the next.
    ``rows`` is read twice a step and should be narrow and materialised; only
    the cut-off and three counts reach the driver.
    """
    below, inside, need = F.lit(False), F.lit(True), k
    for code in codes:
        size = rows.where(inside).count()
        slack = 2
        while size > narrow * need:
            share = min(1.0, need / size + slack / SKETCH)
            at = rows.where(inside).select(F.percentile_approx(code, share, SKETCH)).first()[0]
            n_below, n_upto = rows.where(inside).select(
                F.count_if(F.col(code) < F.lit(at)), F.count_if(F.col(code) <= F.lit(at))).first()
            if n_upto < need:
                slack *= 4
            elif n_below < need:
                # the k-th row is among the ties at the cut-off
                below = below | (inside & (F.col(code) < F.lit(at)))
                inside, size, need = inside & (F.col(code) == F.lit(at)), n_upto - n_below, need - n_below
                break
            elif n_below < size:
                inside, size = inside & (F.col(code) < F.lit(at)), n_below
            else:
                break
        if size <= narrow * need:
            break
    return below | inside


def smallest_k(rows: DataFrame, k: int, key, codes: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """rank, id and ``keep`` of the k rows with the smallest (``key``, id),
    for a k that grows with the table: no step puts them into one task."""
    names = tuple(f"_code{i}" for i in range(len(codes)))
    narrow = cut_lineage(rows.select("id", key.alias("_key"), *keep, *[
        c.alias(n) for n, c in zip(names, codes)]))
    kept = narrow.where(cut_off(narrow, names, k)) if k > 0 else narrow.limit(0)
    placed = index_rows(kept.select("id", "_key", *keep), [F.col("_key"), F.col("id")], name="_at")
    return placed.where(F.col("_at") < k).select((F.col("_at") + 1).cast("int").alias("rank"), "id", *keep)


def top_k(scores: DataFrame, k: int, descending: bool = False, key_col: str = "score",
          carry: tuple[str, ...] = (), share: bool = False) -> DataFrame:
    """Best k rows of ``scores(id, score, *carry)``; rank 1 is the best.

    ``carry`` columns (e.g. features, label) ride along with the k winners,
    so a caller needs no second pass over the pool to fetch them.  ``share``:
    k grows with the pool; the pick stays distributed and carries nothing.
    """
    if share:
        rows, key = scores.select("id", F.col(key_col).alias("score")), score_key("score")
        # undefined scores are the worst
        key = F.when(key.isNull() | F.isnan(key), F.lit(float("inf"))).otherwise(
            F.lit(0.0) - key if descending else key)
        return smallest_k(rows, k, key, [key, F.col("id").cast("double")], ("score",))
    key = score_key(key_col)
    order = [key.desc() if descending else key.asc(), F.col("id").asc()]
    best = scores.select("id", F.col(key_col).alias("score"), *carry).orderBy(*order).limit(k)
    # the window runs over at most k rows (after the limit)
    rank = F.row_number().over(Window.orderBy(*[
        (score_key("score").desc() if descending else score_key("score").asc()), F.col("id")]))
    return best.select(rank.cast("int").alias("rank"), "id", "score", *carry)


def select_random(unlabeled: DataFrame, k: int, seed: int,
                  carry: tuple[str, ...] = (), share: bool = False) -> DataFrame:
    """Seeded random k: the k smallest md5(id:seed) keys."""
    if share:
        picked = smallest_k(unlabeled, k, order_key("id", seed), [numeric_key("id", seed).cast("double")])
        return picked.select("rank", "id", F.lit(None).cast("double").alias("score"))
    keyed = unlabeled.select("id", order_key("id", seed).alias("key"), *carry)
    best = keyed.orderBy("key", "id").limit(k)
    rank = F.row_number().over(Window.orderBy("key", "id"))
    return best.select(rank.cast("int").alias("rank"), "id",
                       F.lit(None).cast("double").alias("score"), *carry)


def uncertainty_scores(votes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """scores(id, score) with score = |0.5 - p0|; smaller is more uncertain."""
    return stats_of(votes, keep=carry).select("id", margin("p0").alias("score"), *carry)


def select_uncertain(votes: DataFrame, k: int, carry: tuple[str, ...] = (), share: bool = False) -> DataFrame:
    return top_k(uncertainty_scores(votes, carry), k, descending=False, carry=carry, share=share)


def density_scores(votes: DataFrame, density: DataFrame, beta: float = 1.0,
                   carry: tuple[str, ...] = (), mean: bool = False,
                   entropy: str = "half") -> DataFrame:
    """score = entropy(p0) * density ** beta (missing density -> 0).

    ``entropy='half'`` is -p0*log2(p0), the original, asymmetric form;
    ``'full'`` is the binary entropy of p0.

    ``density`` is either a table ``(id, density)`` (joined on id) or the
    one-row reference sum vector ``(total)`` of ``similarity.reference_total``;
    then ``votes`` must be per-row vote arrays that still carry ``features``,
    and density is computed in the same projection as the votes: no join.
    """
    ent = {"half": half_entropy, "full": binary_entropy}[entropy]
    if "total" in density.columns:
        framed = density_from_total(votes, density, mean=mean)
        joined = stats_of(framed, keep=("density", *carry)).select(
            "id", ent("p0").alias("u"), "density", *carry)
    else:
        stats = stats_of(votes, keep=carry).select("id", ent("p0").alias("u"), *carry)
        joined = stats.join(density.select("id", "density"), "id", "left")
    d = F.coalesce(F.col("density"), F.lit(0.0))
    weight = d if beta == 1.0 else F.pow(d, F.lit(float(beta)))
    return joined.select("id", (F.col("u") * weight).alias("score"), *carry)


def select_density(votes: DataFrame, density: DataFrame, k: int, beta: float = 1.0,
                   carry: tuple[str, ...] = (), mean: bool = False,
                   entropy: str = "half", share: bool = False) -> DataFrame:
    """Densest-and-uncertain first; ``mean=True`` averages instead of summing
    the similarities (only with the one-row total)."""
    return top_k(density_scores(votes, density, beta, carry, mean, entropy), k, descending=True,
                 carry=carry, share=share)


def select_by_prediction(predicted: DataFrame, k: int = 1, prediction_col: str = "prediction",
                         carry: tuple[str, ...] = (), share: bool = False) -> DataFrame:
    """Largest predicted gain first (argmax for k = 1), ties by id."""
    scores = predicted.select("id", F.col(prediction_col).alias("score"), *carry)
    return top_k(scores, k, descending=True, carry=carry, share=share)
