"""The driver's Parquet tables and the point views derived from them.

Schemas used throughout (see FIXTURES.md):

    points      id BIGINT, features ARRAY<DOUBLE>, label DOUBLE
    pool_state  id BIGINT, labeled_at INT (NULL = unlabelled)
    votes       id BIGINT, tree INT, vote DOUBLE
    scores      id BIGINT, score DOUBLE
    triples     i BIGINT, j BIGINT, value DOUBLE
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.functions.columns import as_double_array, hash_bucket
from orchard.session import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the embeddings point view: classes 0-4 form label 1.
POSITIVE_BELOW = 5
# Fixed values of the train/test split used by the round loops: md5 bucket
# of id with this seed, out of TEST_BUCKETS, bucket 0 is the test table.
SPLIT_SEED = 7
TEST_BUCKETS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as points: id, float vector cast to double, 0/1 label."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        as_double_array("embedding").alias("features"),
        F.when(F.col("label") < POSITIVE_BELOW, F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
    )


def document_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` joined to ``documents``: whole-text features, label = quality.

    An unbalanced, learnable binary task (most documents are of quality 1).
    """
    from orchard.operators.prep import DOCUMENT_FEATURES, document_features
    docs = document_features(read_table(spark, sf_dir, "documents"))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id")
    return joined.select(F.col("doc_id").alias("id"),
                         F.array(*[F.col(c).cast("double") for c in DOCUMENT_FEATURES]).alias("features"),
                         F.col("quality").cast("double").alias("label"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a large pool: order attributes as features, label = status F.

    Fixed values: prices in units of 100,000, years counted from 1992.
    """
    o = read_table(spark, sf_dir, "orders")
    feats = F.array(
        (F.col("o_totalprice") / 100000.0).cast("double"),
        (F.year("o_orderdate") - 1992).cast("double"),
        F.month("o_orderdate").cast("double"),
        F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("double"), F.lit(0.0)),
        (F.col("o_custkey") / 100000.0).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), feats.alias("features"),
                    F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"))


def is_test(id_col="id") -> "F.Column":
    return hash_bucket(id_col, SPLIT_SEED, TEST_BUCKETS) == 0


def train_test(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deterministic split of a point table into (pool, test)."""
    return points.where(~is_test()), points.where(is_test())


def written_train_test(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``train_test`` of a table written once, as Parquet in the shared checkpoint
    folder: what reads both often derives neither the points nor the split again."""
    spark = points.sparkSession
    path = scratch_path(spark, f"points-{uuid.uuid4().hex}")
    split = points.withColumn("_test", is_test())
    split.write.partitionBy("_test").parquet(path)
    back = spark.read.schema(split.schema).parquet(path).select(*split.columns)
    return back.where(~F.col("_test")).drop("_test"), back.where("_test").drop("_test")
