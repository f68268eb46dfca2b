"""Exact cosine join above a threshold: the similar pairs, not the matrix.

Rows are dealt into tiles of like vectors: the nearest of some pivots (centres
of a k-means run over a bounded sample), and within a pivot a hash chunk of
about ``tile_rows`` rows.  Unit vectors with a cosine of t or more are at most
sqrt(2 - 2 t) apart, so two tiles whose centroids are farther apart than that
plus both radii hold no such pair: they are skipped, first by pivot (at most
pivots^2 pairs), then tile by tile.  The tile pairs that remain are multiplied,
and only their hits leave the task, so the output grows with the hits.

Tiles travel in groups of neighbours, a row once for each group it meets: the
number of groups follows from the cores, not from the rows, until a group would
hold more than GROUP_BYTES.  Inside a task the tiles are still skipped one by one.

How much can be skipped is a matter of the data: groups of like vectors skip
most tiles, vectors without any structure none.  ``CosineJoin.report`` tells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.operators.pool import bounded_side
from orchard.operators.similarity import DEFAULT_TILE_ROWS, GROUP_BYTES, TASKS, TRIPLE_SCHEMA, unit_rows
from orchard.session import cut_lineage, parallelism

# Vectors the pivots are fitted on, pivots, rounds of the fit.
SAMPLE, PIVOTS, FIT_ROUNDS = 4096, 64, 5
# Hits handed on at once.
HITS = 1 << 20
# What rounding may take from a distance or a cosine.
SLACK = 1e-9


def _distance(a, b):
    """|a - b| of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def fit_pivots(units: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE):
    """Centres of a k-means run over ``sample`` rows in hash order."""
    import numpy as np
    rows = units.orderBy(F.xxhash64("id"), "id").limit(sample).select("features").toPandas()["features"]
    if not len(rows):
        return np.zeros((0, 0))
    x = np.unique(np.stack(rows.to_numpy()).astype(float), axis=0)
    x = np.random.default_rng(7).permutation(x)
    # each further start is the vector farthest from those before it
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen].copy()
    for _ in range(FIT_ROUNDS):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for p in range(len(centres)):
            if (near == p).any():
                centres[p] = x[near == p].mean(0)
    return centres


class CosineJoin:
    """Tiles of a point table and the tile pairs that can reach ``threshold``."""

    def __init__(self, points: DataFrame, threshold: float, tile_rows: int = DEFAULT_TILE_ROWS,
                 pivots: int = PIVOTS, sample: int = SAMPLE):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.threshold = threshold
        spark = points.sparkSession
        units = cut_lineage(unit_rows(points.where("id is not null and features is not null")))
        centres = fit_pivots(units, pivots, sample)

        def nearest(frames):
            import numpy as np
            for f in frames:
                if len(f):
                    x = np.stack(f["features"].to_numpy()).astype(float)
                    near = (-2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
                    yield f.assign(pivot=near.astype("int32"))

        keyed = cut_lineage(units.mapInPandas(nearest, "id long, features array<double>, pivot int"))
        # at most ``pivots`` rows
        counts = {r["pivot"]: r["count"] for r in keyed.groupBy("pivot").count().collect()}
        first, deal = 0, []
        for p, n in sorted(counts.items()):
            chunks = -(-n // tile_rows)
            deal.append((p, first, chunks))
            first += chunks
        self.n_tiles = first
        # enough pairs of groups for every core; of one size limit however many rows
        by_bytes = -(-8 * sum(counts.values()) * centres.shape[-1] // GROUP_BYTES)
        self.n_groups = max(by_bytes, math.ceil(math.sqrt(2 * TASKS * parallelism(spark))))
        dealt = F.broadcast(spark.createDataFrame(deal, "pivot int, first long, chunks long"))
        self.members = cut_lineage(keyed.join(dealt, "pivot").select("id", "features", "pivot", (
            F.col("first") + F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("tile")))
        self.pairs = cut_lineage(self._tile_pairs(spark))

    def _tile_pairs(self, spark) -> DataFrame:
        """(ta, tb), ta <= tb, of the tiles that can hold a hit."""
        reach = F.lit((2 - 2 * self.threshold) ** 0.5 + SLACK)

        def balls(key):
            """Centroid and radius of every group of the members."""
            mean = self.members.select(key, F.posexplode("features").alias("at", "x")).groupBy(key, "at").agg(
                F.avg("x").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(
                    "at", "x"))), lambda e: e["x"]).alias("centre"))
            return self.members.join(mean, key).groupBy(key, "centre").agg(
                F.max(_distance("features", "centre")).alias("radius"))

        def side(balls, key, x):
            return balls.select(F.col(key).alias(f"{key}_{x}"), F.col("centre").alias(f"c{x}"),
                                F.col("radius").alias(f"r{x}"))

        near = _distance("ca", "cb") <= F.col("ra") + F.col("rb") + reach
        # at most ``pivots`` rows: their pairs are made here
        rows = balls("pivot").collect()
        met = [(a["pivot"], b["pivot"]) for a in rows for b in rows if a["pivot"] <= b["pivot"] and math.dist(
            a["centre"], b["centre"]) <= a["radius"] + b["radius"] + (2 - 2 * self.threshold) ** 0.5 + SLACK]
        pivots = spark.createDataFrame(met, "pivot_a int, pivot_b int")
        of_tile = self.members.select("tile", "pivot").distinct()
        tiles = cut_lineage(balls("tile").join(of_tile, "tile"))
        a = side(tiles, "tile", "a").join(tiles.select(F.col("tile").alias("tile_a"), F.col("pivot").alias(
            "pivot_a")), "tile_a")
        b = side(tiles, "tile", "b").join(tiles.select(F.col("tile").alias("tile_b"), F.col("pivot").alias(
            "pivot_b")), "tile_b")
        return a.join(F.broadcast(pivots), "pivot_a").join(b, "pivot_b").where(
            near & (F.col("tile_a") <= F.col("tile_b"))).select(
            F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb"))

    def report(self) -> DataFrame:
        """One row: tiles, tile pairs, pairs compared and skipped."""
        total = self.n_tiles * (self.n_tiles + 1) // 2
        return self.pairs.agg(F.count("*").alias("compared")).select(
            F.lit(self.n_tiles).cast("long").alias("tiles"), F.lit(total).cast("long").alias("tile_pairs"),
            "compared", (F.lit(total) - F.col("compared")).alias("skipped"))

    def dealt(self) -> DataFrame:
        """The members as they travel: a copy of a row for each pair of groups
        of tiles (ga, gb), ga <= gb, that its own is in and that may hold a hit."""
        per = max(1, -(-self.n_tiles // self.n_groups))
        met = self.pairs.select(F.expr(f"ta div {per}").alias("ga"), F.expr(f"tb div {per}").alias("gb")).distinct()
        both = met.select(F.col("ga").alias("own"), "ga", "gb").unionByName(
            met.where("ga < gb").select(F.col("gb").alias("own"), "ga", "gb"))
        return self.members.select("id", "features", "tile", F.expr(f"tile div {per}").alias("own")).join(
            bounded_side(both, self.n_groups * self.n_groups), "own")

    def hits(self) -> DataFrame:
        """triples(i, j, value), i < j, value = cosine of at least the threshold."""
        return self.dealt().groupBy("ga", "gb").applyInPandas(_group_hits(self.threshold), TRIPLE_SCHEMA)


def _group_hits(threshold: float):
    """Function of a pair of groups of tiles: the hits of the tile pairs, a tile
    of the one with a tile of the other, that are near enough to hold any."""

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        ids, tile, own, x, first, last = [], [], [], [], None, None
        for f in frames:
            if len(f):
                first, last = int(f["ga"].iloc[0]), int(f["gb"].iloc[0])
                ids.append(f["id"].to_numpy(dtype="int64"))
                tile.append(f["tile"].to_numpy(dtype="int64"))
                own.append(f["own"].to_numpy(dtype="int64"))
                x.append(np.stack(f["features"].to_numpy()).astype("float64", copy=False))
        if not ids:
            return
        ids, tile, own, x = (np.concatenate(c) for c in (ids, tile, own, x))

        def balls(group):
            """tile, ids, vectors, centre and radius of every tile of a group."""
            at = np.flatnonzero(own == group)
            at = at[np.argsort(tile[at], kind="stable")]
            out = []
            for rows in np.split(at, np.flatnonzero(np.diff(tile[at])) + 1):
                if len(rows):
                    centre = x[rows].mean(0)
                    out.append((tile[rows[0]], ids[rows], x[rows], centre,
                                np.sqrt(((x[rows] - centre) ** 2).sum(1).max())))
            return out

        left = balls(first)
        right = left if first == last else balls(last)
        reach, found, n = (2 - 2 * threshold) ** 0.5 + SLACK, [], 0
        for ta, i, a, ca, ra in left:
            for tb, j, b, cb, rb in right:
                if ta > tb or np.sqrt(((ca - cb) ** 2).sum()) > ra + rb + reach:
                    continue
                v = a @ b.T
                keep = v >= threshold - SLACK
                if ta == tb:
                    keep &= i[:, None] < j[None, :]
                r, c = np.nonzero(keep)
                found.append(pd.DataFrame({"i": np.minimum(i[r], j[c]), "j": np.maximum(i[r], j[c]), "value": v[r, c]}))
                n += len(r)
                if n >= HITS:
                    yield pd.concat(found)
                    found, n = [], 0
        if n:
            yield pd.concat(found)

    return fn


def cosine_join(points: DataFrame, threshold: float, **parameters) -> DataFrame:
    """triples(i, j, value): all pairs i < j of points with a cosine of at
    least ``threshold``.  Points without an id or vector take no part, zero
    vectors have no partner; ids are unique."""
    return CosineJoin(points, threshold, **parameters).hits()
