"""Exact top-k search by inner product on a pivot-distance index.

Index.  Pivots are the centres of a k-means run over a bounded sample
(``SAMPLE`` vectors in hash order, a documented parameter); every vector, of
the sample or not, is keyed by its nearest pivot and its distance to it.  The
distances of a pivot are cut into ``BINS`` equal bins, and neighbouring bins
become one annulus until it holds ``ANNULUS_ROWS`` rows.  An annulus keeps its
number of rows, least and largest distance and largest squared norm: at most
pivots x bins such rows reach the driver, whatever the table's size.

Search.  For a query q, a vector x and x's pivot p the triangle inequality
gives |q - x| >= |d(q, p) - d(x, p)|, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2,
so an annulus has an upper bound on the scores in it.  Each query expands the
annuli in the order of their bounds, a few more in each round (``STEPS``), and
stops when the best bound left is below its k-th score so far; a round in which
no query expands an annulus ends the search.  The result is exact.

A round is one shuffle: members and queries meet by tile (annulus, chunk of at
most about ``ANNULUS_ROWS`` members, bucket of about ``QUERY_ROWS`` queries),
so neither a frequent vector nor a frequent annulus makes a large task; a tile
hands on k rows a query.  Single vectors, never packed blocks, travel.

Vectors are integers, floor(scale * x); sums of products are exact in doubles
below 2^53 and use 64-bit integers beyond.

Defined cases: a vector that is null, holds a null or a non-finite component,
or has a null id takes no part; vectors of different lengths are filled with
zeros, an empty one is all zeros; components of 2^31 and more raise an error;
ties go to smaller ids; rows that repeat an id count one by one as candidates,
and the smallest of their vectors is the query; extra columns are ignored; an
empty table and a table without queries give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import broadcast_if_small
from orchard.session import cut_lineage

SCALE = 256.0
#: Index parameters: sampled vectors, pivots and rounds of the k-means fit,
#: distance bins of a pivot, rows of an annulus or chunk, queries of a tile.
SAMPLE, PIVOTS, FIT_ROUNDS = 4096, 64, 8
BINS, ANNULUS_ROWS, QUERY_ROWS = 64, 4096, 16384
#: Annuli that a query has expanded after each round; the last takes the rest.
STEPS = (4, 32)
#: Queries scored at once inside a task.
_SLICE = 256


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): the rows that take part, vectors as 32-bit integers padded
    to one width."""
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = max(1, kept.agg(F.max(F.size("v"))).first()[0] or 0)

    def part(batches):
        for batch in batches:
            v = batch.column(1)
            lengths = v.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False))
            if len(flat) and np.abs(flat).max() >= 1 << 31:
                raise ValueError("a scaled vector component does not fit 32 bits")
            full = np.zeros((len(lengths), width), np.int32)
            full[np.arange(width) < lengths[:, None]] = flat.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in full], pa.binary())],
                                             names=["id", "vec"])

    return kept.mapInArrow(part, "id long, vec binary")


def _matrix(column) -> np.ndarray:
    """The vectors of a binary column, one row each."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(sq, 0))


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of a k-means run over ``sample`` vectors."""
    rows = vectors.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).select("vec").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    x = np.unique(_matrix(rows.column(0)).astype(float), axis=0)
    x = np.random.default_rng(11).permutation(x)
    centres = x[:pivots].copy()
    for _ in range(FIT_ROUNDS):
        near = _distances(x, centres).argmin(1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = x[near == i].mean(0)
    return centres


class Annuli:
    """Per annulus: pivot, least and largest distance, largest squared norm,
    chunks of members.  Plain arrays, shipped to the tasks."""

    def __init__(self, pivots, pivot, lo, hi, norm, chunks):
        self.pivots, self.pivot, self.lo, self.hi, self.norm, self.chunks = pivots, pivot, lo, hi, norm, chunks

    def __len__(self):
        return len(self.pivot)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound on every query's scores inside every annulus."""
        d = _distances(queries, self.pivots)[:, self.pivot]
        gap = np.maximum(np.maximum(d - self.hi, self.lo - d), 0)
        both = (queries * queries).sum(1)[:, None] + self.norm
        # distances are rounded: the slack keeps the bound one from above
        return (both - gap * gap) / 2 + 1e-6 * (both + 1)


class PivotIndex:
    """members (id, vec, annulus, chunk) of all vectors, and their annuli."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE,
                 annulus_rows: int = ANNULUS_ROWS):
        centres = fit_pivots(vectors, pivots, sample)

        def key(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1)).astype(float)
                    d = _distances(x, centres)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]),
                         pa.array((x * x).sum(1))], names=["id", "vec", "pivot", "dist", "norm"])

        keyed = cut_lineage(vectors.mapInArrow(
            key, "id long, vec binary, pivot int, dist double, norm double"))
        width = (keyed.agg(F.max("dist")).first()[0] or 0.0) / BINS or 1.0
        keyed = keyed.withColumn("bin", F.least(F.floor(F.col("dist") / width), F.lit(BINS - 1)).cast("int"))
        # at most pivots x bins rows
        bins = keyed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("dist").alias("lo"),
                                                 F.max("dist").alias("hi"), F.max("norm").alias("norm")).toPandas()
        bins = bins.sort_values(["pivot", "bin"]).reset_index(drop=True)
        annulus, rows, number = [], 0, -1
        for at, b in enumerate(bins.itertuples()):
            if at == 0 or b.pivot != bins["pivot"][at - 1] or rows >= annulus_rows:
                number, rows = number + 1, 0
            rows += b.n
            annulus.append(number)
        bins["annulus"] = annulus
        each = bins.groupby("annulus").agg(pivot=("pivot", "first"), n=("n", "sum"), lo=("lo", "min"),
                                           hi=("hi", "max"), norm=("norm", "max"))
        chunks = np.maximum(1, -(-each["n"].to_numpy() // annulus_rows))
        self.annuli = Annuli(centres, *(each[c].to_numpy() for c in ("pivot", "lo", "hi", "norm")), chunks)
        spark = vectors.sparkSession
        which = spark.createDataFrame([(int(p), int(b), int(a), int(chunks[a])) for p, b, a in zip(
            bins["pivot"], bins["bin"], annulus)], "pivot int, bin int, annulus int, chunks int")
        self.members = keyed.join(F.broadcast(which), ["pivot", "bin"]).select(
            "id", "vec", "annulus", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int").alias("chunk"))


def _tile_best(k: int):
    """Rows sorted by tile, members before queries -> best k of each query."""

    def best(ids, x, qid, q):
        out = []
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2 ** 53
        kind = np.float64 if exact else np.int64
        x = x.astype(kind)
        for first in range(0, len(qid), _SLICE):
            some = qid[first:first + _SLICE]
            scores = q[first:first + _SLICE].astype(kind) @ x.T
            least = np.partition(scores, max(0, len(ids) - k - 1), axis=1)[:, max(0, len(ids) - k - 1)]
            for row, own, low in zip(scores, some.tolist(), least):
                at = np.flatnonzero((row >= low) & (ids != own))
                if len(at) < k:
                    at = np.flatnonzero(ids != own)
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
                out.append((own, ids[at], row[at].astype(np.int64)))
        return out

    def part(batches):
        tile, ids, x, ready = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, tag = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.flatnonzero((np.diff(t) != 0) | (np.diff(tag) != 0)) + 1
            found = []
            for a, b in zip(np.concatenate([[0], at]), np.concatenate([at, [len(t)]])):
                if t[a] != tile:
                    tile, ids, x, ready = t[a], [], [], None
                own, vec = batch.column(2).slice(a, b - a).to_numpy(), _matrix(batch.column(3).slice(a, b - a))
                if tag[a] == 0:
                    ids.append(own)
                    x.append(vec)
                elif ids:
                    ready = ready or (np.concatenate(ids), np.concatenate(x))
                    found += best(*ready, own, vec)
            if found:
                n = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([f[0] for f in found], np.int64), n)),
                     pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                    names=["query_id", "vec_id", "score"])

    return part


def search(index: PivotIndex, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products
    of every query (id, vec) with the indexed vectors of another id."""
    q = cut_lineage(queries.groupBy("id").agg(F.min("vec").alias("vec")))
    buckets = max(1, -(-q.count() // query_rows))
    annuli, total = index.annuli, len(index.annuli)
    order = [F.col("score").desc(), F.col("vec_id")]
    kth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    best, low = None, q.select("id", F.lit(None).cast("long").alias("least"))
    none = q.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                    F.col("id").alias("score")).limit(0)
    if not total:
        return none
    first = 0
    for last in [*(s for s in STEPS if s < total), total]:
        ask = q.join(low, "id", "left") if first else q.join(low, "id")

        def expand(batches, first=first, last=last):
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE):
                    some = batch.slice(start, _SLICE)
                    bound = annuli.bounds(_matrix(some.column(1)).astype(float))
                    by = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    least = some.column(2).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
                    wanted = np.take_along_axis(bound, by, 1) >= least[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1),
                         pa.array([b[w].tolist() for b, w in zip(by, wanted)], pa.list_(pa.int32()))],
                        names=["id", "vec", "annuli"])

        sizes = F.array(*[F.lit(int(c)) for c in annuli.chunks])
        asked = cut_lineage(ask.select("id", "vec", "least").mapInArrow(
            expand, "id long, vec binary, annuli array<int>").where(F.size("annuli") > 0))
        wanted = asked.select(F.explode("annuli").alias("annulus")).distinct()  # at most pivots x bins rows
        if wanted.isEmpty():
            break
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        right = asked.select("id", "vec", bucket.alias("bucket"), F.explode("annuli").alias("annulus")).select(
            "annulus", F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("annulus")) - 1)).alias("chunk"),
            "bucket", F.lit(1).alias("tag"), "id", "vec")
        left = index.members.join(broadcast_if_small(wanted, 16), "annulus").select(
            "annulus", "chunk", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
            F.lit(0).alias("tag"), "id", "vec")
        rows = left.union(right)
        tile = (F.col("annulus").cast("long") * int(max(annuli.chunks)) + F.col("chunk")) * buckets + F.col("bucket")
        rows = rows.select(tile.alias("tile"), "tag", "id", "vec").repartition("tile").sortWithinPartitions(
            "tile", "tag")
        found = rows.mapInArrow(_tile_best(k), "query_id long, vec_id long, score long")
        found = found if best is None else found.union(best)
        best = cut_lineage(found.withColumn("rank", kth).where(F.col("rank") <= k).drop("rank"))
        low = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(
            F.col("n") == k).select(F.col("query_id").alias("id"), "least")
        first = last
    if best is None:
        return none
    return best.select("query_id", kth.cast("int").alias("rank"), "vec_id", "score")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", **parameters) -> DataFrame:
    """The ``k`` best candidates of every row whose id is divisible by ``every``."""
    vectors = cut_lineage(integer_vectors(rows, id_col, vec_col))
    index = PivotIndex(vectors, **parameters)
    return search(index, vectors.where(F.col("id") % every == 0), k)
