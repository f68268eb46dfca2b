"""Helpers shared by the document operators: reading, training split, checked
broadcast, Arrow text slices and vectorised word hashes, connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.session import cut_lineage
from orchard.sources.tables import read_table

#: Rows whose crc32(id as text) has this remainder are held out of training.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
#: Bytes of rows that a broadcast side may hold; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes of text handled at once inside a task (one longer text is one slice).
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch that are turned into results at once.
SLICE_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for rows kept out of training; a null id counts as a training row."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    rest = F.crc32(c.cast("string").cast("binary")) % F.lit(HELD_OUT_MODULUS)
    return F.coalesce(rest == HELD_OUT_REMAINDER, F.lit(False))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows times ``row_bytes``
    fit ``limit``; otherwise ``df`` itself, so that the join shuffles.  Both
    ways give the same rows."""
    if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit:
        return F.broadcast(df)
    return df


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, offsets) of whole texts, about
    ``slice_bytes`` at a time; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    bufs = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(bufs[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + slice_bytes, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def row_slices(batches):
    """Arrow batches in pieces of at most SLICE_ROWS rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a run of bytes outside ``space`` (byte values), A-Z lower-cased;
    bytes of 128 and more always belong to words, so UTF-8 needs no decoding.
    A word's hash is a polynomial over a fixed random byte table, taken from
    one prefix sum over the slice.
    """

    def __init__(self, space: bytes):
        rng = np.random.default_rng(20240229)
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        table[65:91] = table[97:123]
        self.is_space = np.zeros(256, bool)
        self.is_space[list(space)] = True
        table[self.is_space] = 0
        self.table = table
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("powers", _BASE), ("inverses", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """(hash of each word, index of each document's first word, n + 1)."""
        n_docs = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
        self._grow(len(data) + 1)
        inside = ~self.is_space[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        doc_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[doc_starts] = inside[doc_starts]
        starts = np.flatnonzero(first)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[:len(data)], dtype=np.uint64, out=sums[1:])
        # space bytes weigh 0, so the sum up to the next start ends at the word's end
        bounds = np.append(starts, len(data))
        hashes = (sums[bounds[1:]] - sums[bounds[:-1]]) * self.inverses[starts]
        return mix64(hashes + _GOLDEN), np.searchsorted(starts, offsets)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` consecutive words from each position (length n - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, (k * int(_GOLDEN)) % (1 << 64), np.uint64)
    for j in range(k):
        h = h * _BASE + words[j:j + n]
    return mix64(h)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge table (a, b): component = smallest node
    that can be reached.  Nodes without an edge are not listed.

    Alternating large-star / small-star rounds.  A round is two aggregations
    with map-side combine and two joins, so a node with very many edges is
    split like any skewed join key; each round's edges are checkpointed, and
    only two numbers per round reach the driver.
    """
    e = cut_lineage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def signature(d):
        return d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        e.select("v", "v").distinct())
