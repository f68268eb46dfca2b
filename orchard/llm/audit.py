"""Filter interaction audit by incremental retraction streaming.

The document files are read as a stream that stops when all files are done
(available now), some files a micro-batch.  Five filters judge every text;
four look at the text alone and give it a mask of failed filters, the fifth
fails a text that equals a smaller id's text anywhere in the table.

State is keyed by text (a 128-bit hash): the smallest id so far and the rows
that hold it; about ``BUCKET_TEXTS`` texts by hash share one state value, a
small Arrow table, so that a bucket is updated at once.  Every row that comes in counts under its mask with the fifth
filter failed; the holders of the smallest id are counted without it.  When a
smaller id arrives in a later micro-batch, the earlier holders' counts are
retracted (-1 under the passing mask, +1 under the failing one) and the new
holders' added.  A micro-batch appends its net changes of the part counters,
one small table a batch; their sum does not depend on the order of the files.

A frequent text costs little: before the shuffle each task keeps only the
smallest id per text of an Arrow batch and sends the other rows on as finished
counts.  State lives in the session's state store (about 60 bytes a distinct
text; choose RocksDB where that does not fit the executors' heaps) and its
checkpoints in the shared folder, so a lost executor resumes.  Batches are written to folders named by
their number, so a repeated one replaces itself.

The counters (at most parts x 32 masks x 4 label pairs) then answer all 120
orders of the filters at once.

Defined cases: a null text is empty; a null part is the empty string; a null id
is neither smaller nor larger than any other, so its row passes the fifth
filter and fails no other row; rows that repeat an id and a text share the
smallest id, all pass; several labels of one id: the largest; documents without
labels count for neither; texts are taken whole; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orchard.session import cut_lineage, scratch_path

#: Fixed values of the filters: least words, least share of distinct words and
#: largest share of capitals (percent), marks.
LEAST_WORDS, DISTINCT_PCT, CAPITALS_PCT = 200, 50, 2
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
FILTERS = "ABCDE"
#: The bit of the filter on copies.
COPY = 1 << 4
#: Micro-batches that the files are dealt out to, about.
BATCHES = 4
#: Rows of the table for each bucket of texts in state.
BUCKET_TEXTS = 1024
_ROW = "bucket long, k1 long, k2 long, id long, part string, mask int, good int, toxic int, n long"
_DELTA = "part string, mask int, good int, toxic int, n long"
_CELL = ["part", "mask", "good", "toxic"]
_TEXT = ["k1", "k2"]
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t])
                    for n, t in (c.split() for c in _ROW.split(", "))])


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = data.split()  # white space of bytes: \x20 and \x09 to \x0D
    points = len(data.decode("utf-8")) if not data.isascii() else len(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PCT * len(words)) << 1
            | (100 * capitals > CAPITALS_PCT * points) << 2 | (_MARKS.search(data) is not None) << 3)


def _judge(batches):
    """(id, part, text) -> (id, part, k1, k2, mask)."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            some = batch.slice(first, 512)
            texts = [t or b"" for t in some.column(2).to_pylist()]
            key = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts),
                                np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.array([text_mask(t) for t in texts], pa.int32())], names=["id", "part", "k1", "k2", "mask"])


def _smallest_first(buckets: int):
    """Of each Arrow batch: the rows with the smallest id of their text; rows
    without an id and all others as finished counts under negative buckets,
    which hold no state."""

    def part(batches):
        import pandas as pd
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pandas()
            ids = batch.column("id")
            known = pd.Series(ids.is_valid().to_numpy(zero_copy_only=False))
            ids = pd.Series(ids.fill_null(0).to_numpy())
            least = ids.where(known, np.iinfo("int64").max).groupby([rows["k1"], rows["k2"]]).transform("min")
            open_ = known & (ids == least)
            rows["id"] = ids
            rows["bucket"] = rows["k1"] % buckets
            # a row without an id passes, one above its text's smallest id fails
            rows["mask"] = rows["mask"] | np.where(known & ~open_, COPY, 0).astype("int32")
            closed = rows[~open_].groupby(_CELL, as_index=False).size().rename(columns={"size": "n"})
            closed = closed.assign(bucket=-1 - np.arange(len(closed)) % 64, k1=0, k2=0, id=0)
            for frame in (rows[open_].assign(n=1), closed):
                if len(frame):
                    yield pa.RecordBatch.from_pandas(frame[_ARROW.names], schema=_ARROW, preserve_index=False)

    return part


def _update(key, frames, state: GroupState):
    """Changes of the part counters by the new rows of one bucket of texts."""
    import pandas as pd
    new = pd.concat(list(frames))
    if key[0] < 0:
        yield new.groupby(_CELL, as_index=False)["n"].sum()
        return
    old = state.getOption
    held = pa.ipc.open_stream(old[0]).read_pandas() if old is not None else new.iloc[:0]
    rows = pd.concat([held.assign(old=True), new.assign(old=False)], ignore_index=True)
    holds = rows["id"] == rows.groupby(_TEXT)["id"].transform("min")
    came, went = rows[~rows["old"]], rows[rows["old"] & ~holds]
    out = pd.concat([
        came.assign(mask=came["mask"] | np.where(holds[came.index], 0, COPY)),
        went.assign(n=-went["n"]), went.assign(mask=went["mask"] | COPY)])  # retraction
    keep = rows[holds].groupby(["bucket", *_TEXT, "id", *_CELL], as_index=False)["n"].sum()
    table = pa.Table.from_pandas(keep[_ARROW.names], schema=_ARROW, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW) as writer:
        writer.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))
    yield out.groupby(_CELL, as_index=False)["n"].sum()


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES,
             files_per_batch: int | None = None) -> DataFrame:
    """part, mask, good, toxic, n: rows of the Parquet table at ``path`` by the
    filters they fail, from a stream over its files."""
    path = path.rstrip("/")
    table = spark.read.parquet(path)
    files = files_per_batch or max(1, -(-len(table.inputFiles()) // batches))
    base = scratch_path(spark, f"audit-{uuid.uuid4().hex}")
    marks = cut_lineage(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    # as a pattern: a stream takes a plain path for a folder, but the table may be one file
    pattern = f"{path[:-1]}[{path[-1]}]"
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    judged = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit(
        "")).alias("part"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _judge, "id long, part string, k1 long, k2 long, mask int")
    rows = judged.join(marks, "id", "left").select(
        "id", "part", "k1", "k2", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # the row count comes from the files' footers
    buckets = max(1, table.count() // BUCKET_TEXTS)
    changes = rows.mapInArrow(_smallest_first(buckets), _ROW).groupBy("bucket").applyInPandasWithState(
        _update, _DELTA, "held binary", "update", GroupStateTimeout.NoTimeout)

    def append(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).coalesce(1).write.mode(
            "overwrite").parquet(f"{base}/changes/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).foreachBatch(append).start().awaitTermination()
    schema = f"{_DELTA}, batch int"
    written = spark.read.schema(schema).parquet(f"{base}/changes") if files and table.inputFiles() else \
        spark.createDataFrame([], schema)
    return written.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters."""
    shares = 120  # orders; a filter comes first among m failed ones in 120 / m of them
    steps = [(order, s + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:s]))
             for order in map("".join, itertools.permutations(FILTERS)) for s, f in enumerate(order)]
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "earlier"), x)) for x in steps])),
                        "array<struct<filter_order:string,step:int,bit:int,earlier:int>>")
    cells = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias(
        "good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    each = cells.select("*", F.explode(table).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long")

    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        total(fails, F.col("n") * F.lit(shares) / F.bit_count("mask")).alias("shapley"))
