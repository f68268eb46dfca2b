"""Delimited-text and CSV sources, text and Parquet sinks.

Loaders return the point schema ``(id BIGINT, features ARRAY<DOUBLE>,
label DOUBLE)`` or a narrower one.  Rows without a key get a consecutive id
in file order (by path, then line),
computed by ``ranking.scan_order_index`` without a sort.  Schemas are
declared, never inferred, so no extra pass over the data is spent on
inference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orchard.functions.columns import WHITESPACE, recode_code, recode_sign, to_double_array, tokens
from orchard.operators.lal import STATE_COLS, TRAIN_FILE_COLUMNS
from orchard.operators.prep import parse_labeled_line, render_labeled_line
from orchard.operators.ranking import scan_order_index

POINT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.DoubleType()),
])
TRIPLE_TEXT_SCHEMA = "i BIGINT, j BIGINT, value DOUBLE"


def _recoded(points: DataFrame, recode: str | None, zero_code=None) -> DataFrame:
    if recode is None:
        return points
    if recode == "sign":
        label = recode_sign("label")
    elif recode == "code":
        label = recode_code("label", zero_code)
    else:
        raise ValueError(f"unknown recode {recode!r}")
    return points.withColumn("label", label)


def read_labeled_text(spark: SparkSession, path: str, sep: str | None = None,
                      recode: str | None = None, zero_code=None) -> DataFrame:
    """Labelled points from text, last token the label.

    ``sep=None``: strip and split on whitespace runs (A1); a literal ``sep``
    such as ``" "`` splits on exactly that (A2).  ``recode='sign'`` maps -1 to
    0 and the rest to 1; ``recode='code'`` maps ``zero_code`` to 0.
    """
    lines = spark.read.text(path)
    lines = lines.where(F.length(F.trim("value")) > 0) if sep is None else lines.where(F.col("value") != "")
    keyed = scan_order_index(lines, name="id")
    parsed = parse_labeled_line(keyed, F.col("value"), sep=sep)
    return _recoded(parsed.select("id", "features", "label"), recode, zero_code)


def read_train_test(spark: SparkSession, train_path: str, test_path: str,
                    sep: str | None = " ", recode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A train / test pair of labelled text files (same format)."""
    return (read_labeled_text(spark, train_path, sep, recode),
            read_labeled_text(spark, test_path, sep, recode))


def read_vectors(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Unlabelled vectors, one per line (A5): ``(id, features)``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    keyed = scan_order_index(lines, name="id")
    toks = tokens("value", WHITESPACE) if sep is None else F.split("value", sep)
    return keyed.select("id", to_double_array(toks).alias("features"))


def unlabeled_view(points: DataFrame) -> DataFrame:
    """The unlabelled view of a labelled table (A6): drop the label."""
    return points.select("id", "features")


def read_csv_points(spark: SparkSession, path: str, header: bool = True,
                    missing: str | None = None, recode: str | None = None, zero_code=None,
                    drop_columns: Sequence[int] = ()) -> DataFrame:
    """Comma-separated points, last column the label (A3, A4).

    Quoted header and quoted fields are handled by the CSV reader.  With
    ``missing='?'`` that marker reads as NULL and rows holding one are dropped
    (C1).  ``drop_columns`` removes leading id-like columns by position.
    """
    reader = spark.read.option("header", header).option("quote", '"')
    if missing is not None:
        reader = reader.option("nullValue", missing)
    raw = reader.csv(path)
    if missing is not None:
        raw = raw.dropna()
    cols = [c for k, c in enumerate(raw.columns) if k not in set(drop_columns)]
    label_col = cols[-1]
    feats = F.array(*[F.col(c).try_cast("double") for c in cols[:-1]])
    keyed = scan_order_index(raw, name="id")
    out = keyed.select("id", feats.alias("features"), F.col(label_col).try_cast("double").alias("label"))
    return _recoded(out, recode, zero_code)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate entries ``i j value`` separated by single spaces (A7)."""
    return spark.read.csv(path, sep=" ", schema=TRIPLE_TEXT_SCHEMA)


def read_ints(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One integer (BIGINT) per line, blank lines skipped; a line that is no
    integer is an error, not a missing value (A8).  A file that splits into
    fewer than ``min_partitions`` tasks is dealt out over that many."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if min_partitions and lines.select(F.spark_partition_id().alias("p")).distinct().count() < min_partitions:
        lines = lines.repartition(min_partitions)
    number = F.trim("value").try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not an integer: "), F.col("value"))).cast("bigint")
    return lines.select(F.coalesce(number, bad).alias("value"))


def points_from_rows(spark: SparkSession, rows: Sequence[tuple[float, Sequence[float]]]) -> DataFrame:
    """A small in-memory source (A9): ``[(label, [x, ...]), ...]`` -> points."""
    data = [(k, [float(x) for x in feats], float(label)) for k, (label, feats) in enumerate(rows)]
    return spark.createDataFrame(data, POINT_SCHEMA)


def read_gain_table(spark: SparkSession, path: str,
                    feature_positions: Sequence[int] = TRAIN_FILE_COLUMNS,
                    names: Sequence[str] = STATE_COLS) -> DataFrame:
    """Regressor training text (A10): chosen columns as state features,
    the last column as ``gain``; single-space separated."""
    lines = spark.read.text(path).where(F.col("value") != "")
    toks = F.split(F.trim("value"), " ")
    cols = [F.try_element_at(toks, F.lit(p + 1)).try_cast("double").alias(n)
            for p, n in zip(feature_positions, names)]
    return lines.select(*cols, F.try_element_at(toks, F.lit(-1)).try_cast("double").alias("gain"))


def read_regression_table(spark: SparkSession, path: str) -> DataFrame:
    """Regressor training text with every column a feature but the last (A11)."""
    lines = spark.read.text(path).where(F.col("value") != "")
    keyed = scan_order_index(lines, name="id")
    parsed = parse_labeled_line(keyed, F.col("value"), sep=" ")
    return parsed.select("id", "features", F.col("label").alias("gain"))


def write_points_text(points: DataFrame, path: str, sep: str = " ") -> None:
    """Points as delimited text, label last (A14)."""
    render_labeled_line(points, sep).select("line").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Histories, batches and other result tables as Parquet (A15)."""
    df.write.mode("overwrite").parquet(path)
