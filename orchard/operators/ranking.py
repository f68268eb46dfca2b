"""Global positions without a single-partition window.

``row_number() over (order by ...)`` with no partition clause moves every row
into one task.  These helpers give the same numbers the distributed way, as
``zipWithIndex`` does: range-partition and sort, number rows inside each
partition, then add the row count of all earlier partitions.  The table of
per-partition counts has one row per partition, so it is bounded by the
partition count and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.session import cut_lineage

_PID = "_orchard_pid"
_LOCAL = "_orchard_local"


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(tagged: DataFrame, count_col: str | None = None,
             sum_cols: Sequence[str] = ()) -> DataFrame:
    """Per partition: rows (and column totals) of all earlier partitions."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.sum(c).alias(f"_t_{c}") for c in sum_cols]
    per_part = tagged.groupBy(_PID).agg(*aggs)
    earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(_PID), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off_rows")]
    cols += [F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}")
             for c in sum_cols]
    return per_part.select(*cols)


def index_rows(df: DataFrame, order_cols: Sequence, name: str = "row_index",
               partitions: int | None = None) -> DataFrame:
    """Add a 0-based consecutive position in ``order_cols`` order.

    ``order_cols`` must be a total order (end it with a unique key) for the
    result to be repeatable.  The tagged table is checkpointed, so the
    numbering is fixed even if executors are lost afterwards.
    """
    n = _num_partitions(df, partitions)
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ordered.select("*", F.spark_partition_id().alias(_PID),
                            F.monotonically_increasing_id().alias(_LOCAL))
    tagged = cut_lineage(tagged)
    offsets = _offsets(tagged)
    local = F.col(_LOCAL) - F.shiftleft(F.col(_PID).cast("bigint"), 33)
    out = tagged.join(F.broadcast(offsets), _PID)
    return out.select(*df.columns, (F.col("_off_rows") + local).alias(name))


def scan_order_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number rows in file order: by file path, then by position in the file.

    No sort and no write: one pass counts rows per file split, a second
    assigns ``offset + position``.  ``df`` must be a file scan (plus filters):
    its splits are known by file and start, so the numbers depend neither on
    how splits are packed into tasks nor on their size, and any re-run of a
    lost task sees the same rows in the same order.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_orchard_file"),
                       F.col("_metadata.file_block_start").alias("_orchard_block"),
                       F.monotonically_increasing_id().alias(_LOCAL))
    split = ["_orchard_file", "_orchard_block"]
    per_split = tagged.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"), F.min(_LOCAL).alias("_first"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select(*split, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
                               .alias("_shift"))
    # one row per file split
    out = tagged.join(F.broadcast(offsets), split)
    return out.select((F.col(_LOCAL) + F.col("_shift")).alias(name), *df.columns)


def running_sums(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                 partitions: int | None = None, suffix: str = "_cum",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of numeric ``value_cols`` in ``order_cols`` order.

    Meant for narrow tables (a few numeric columns): one window per range of a
    range partitioning, then the offsets of the ranges are added.
    """
    n = _num_partitions(df, partitions)
    narrow = df.select(*order_cols, *carry, *value_cols)
    tagged = cut_lineage(narrow.repartitionByRange(n, *order_cols).withColumn(_PID, F.spark_partition_id()))
    so_far = Window.partitionBy(_PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(F.col(c).cast("double")).over(so_far).alias(f"{c}_local")
                                 for c in value_cols])
    out = local.join(F.broadcast(_offsets(tagged, sum_cols=value_cols)), _PID)
    return out.select(*order_cols, *carry, *value_cols,
                      *[(F.col(f"_off_{c}") + F.col(f"{c}_local")).alias(f"{c}{suffix}")
                        for c in value_cols])


#: Longest array that value positions are expanded through.
POSITION_CHUNK = 1 << 16


def value_positions(df: DataFrame, column: str, chunk: int = POSITION_CHUNK) -> DataFrame:
    """``(position, column)``: the 0-based positions of all rows in ascending
    order of one column, equal values beside each other.

    Equal rows are interchangeable, so a value is counted (with map-side
    combine) instead of sorted and owns the run of positions after all smaller
    values.  Runs are split by powers of ``chunk`` and dealt out again before
    the last split, so a value that holds most of the rows fills many tasks and
    no array is longer than ``chunk`` (up to ``chunk`` ** 3 rows of a value).
    NULL comes first; an empty table gives no rows.
    """
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ends = running_sums(counts, ["_value"], ["_n"])
    stop = F.col("_n_cum").cast("bigint") - 1
    runs = ends.select("_value", (stop + 1 - F.col("_n")).alias("_first"), stop.alias("_last"))
    for step in (chunk * chunk, chunk):
        runs = runs.select("_value", "_last", F.explode(
            F.sequence("_first", "_last", F.lit(step).cast("bigint"))).alias("_first")).select(
            "_value", "_first", F.least("_last", F.col("_first") + (step - 1)).alias("_last"))
    spread = runs.repartition(_num_partitions(df, None), "_first")
    return spread.select(F.explode(F.sequence("_first", "_last")).alias("position"),
                         F.col("_value").alias(column))
