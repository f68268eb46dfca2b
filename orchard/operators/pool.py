"""Pool state: which rows are labelled, and since which round.

The state is kept as ``labeled(id, labeled_at)`` - the labelled rows only.
An active-learning run labels few rows (labels cost human work), and the
driver always knows an upper bound on how many: the start size plus the batch
sizes handed out so far.  While that bound times the row width is under
``BROADCAST_BYTES`` the labelled table is broadcast into the semi/anti joins below, so the large
point table is never shuffled for them; beyond it the planner (with AQE)
picks a shuffled join.  ``pool_state`` renders the full (id, labeled_at) view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.functions.columns import numeric_key
from orchard.session import BROADCAST_BYTES

# Bytes of a row of ids and rounds (the sides joined here).
STATE_ROW_BYTES = 32


def bounded_side(df: DataFrame, bound: int | None, row_bytes: int = STATE_ROW_BYTES) -> DataFrame:
    """Broadcast a side only when its rows, a bound known on the driver, times
    their width stay under a byte limit; otherwise the planner chooses."""
    if bound is not None and bound * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


# ------------------------------------------------------------ start -------

def start_first_k(points: DataFrame, k: int) -> DataFrame:
    """The k smallest ids are the start set (labeled_at = 0).  Top-k, no sort of the pool."""
    first = points.select("id").orderBy("id").limit(k)
    return first.select("id", F.lit(0).alias("labeled_at"))


def start_one_per_class(points: DataFrame, n_start: int, seed: int) -> DataFrame:
    """One seeded-random row of each class, then random rows up to ``n_start``.

    The per-class pick is the id of the smallest numeric key of each label: a
    hash aggregate with map-side combine, so a class holding most rows costs
    nothing extra.  The fill comes from the 2 n_start smallest keys (a top-k):
    at most n_start of them can be class picks, which drop out of the union of
    the two small tables.
    """
    keyed = points.select("id", "label", numeric_key("id", seed).alias("key"))
    per_class = keyed.groupBy("label").agg(F.min_by("id", "key").alias("id"), F.min("key").alias("key"))
    extra = keyed.select("id", "key").orderBy("key", "id").limit(2 * n_start)
    # class picks first, then the random fill, cut at n_start in that order
    ranked = per_class.select("id", F.lit(0).alias("grp"), "key").unionByName(
        extra.select("id", F.lit(1).alias("grp"), "key")).groupBy("id").agg(
        F.min("grp").alias("grp"), F.min("key").alias("key"))
    top = ranked.orderBy("grp", "key", "id").limit(n_start)
    return top.select("id", F.lit(0).alias("labeled_at"))


def reset_pool(labeled: DataFrame) -> DataFrame:
    """Back to the start state: keep what was labelled in round 0."""
    return labeled.where(F.col("labeled_at") == 0)


# ------------------------------------------------------------ fetch -------

def fetch_labeled(points: DataFrame, labeled: DataFrame, bound: int | None = None) -> DataFrame:
    return points.join(bounded_side(labeled.select("id"), bound), "id", "left_semi")


def fetch_unlabeled(points: DataFrame, labeled: DataFrame, bound: int | None = None) -> DataFrame:
    return points.join(bounded_side(labeled.select("id"), bound), "id", "left_anti")


def pool_state(points: DataFrame, labeled: DataFrame, bound: int | None = None) -> DataFrame:
    """Full view: every id with its labelling round, NULL when unlabelled."""
    return points.select("id").join(bounded_side(labeled, bound), "id", "left")


# ------------------------------------------------------------ update ------

def apply_batch(labeled: DataFrame, batch: DataFrame, iteration: int) -> DataFrame:
    """Move the ids of ``batch`` into the labelled set at round ``iteration``.

    Ids already labelled keep their first round.
    """
    new = batch.select("id", F.lit(iteration).alias("labeled_at"))
    new = new.join(labeled.select("id"), "id", "left_anti")
    return labeled.unionByName(new)
