"""Matrices as tables, cosine similarity and density.

Matrices are long-form ``triples(i, j, value)`` or row tables
``(id, features ARRAY<DOUBLE>)``.

Products (``U . V^T``) are computed tile by tile.  Rows are hashed into
groups, and a task multiplies a pair of groups (a, b), one tile of about
``tile_rows`` rows by another, with NumPy.  A row travels once for each pair its
group is in: the number of groups follows from the cores, not from the rows,
until a group would hold more than GROUP_BYTES.  A task therefore holds at most
two groups and emits at most ``2 * tile_rows**2`` entries at once, however large
the matrix, and for a symmetric product only groups with a <= b meet.  The
output itself has n^2 entries: these operators are for users who want the matrix.
Entries leave a square of tiles in the order of their values, so that columnar
files hold equal ones (as rounded ones often are) in few bytes.
Density does not need it: ``density_linear`` uses
    sum_j u_i . u_j = u_i . (sum_j u_j)
which costs one pass and one d-long vector (d = feature width).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orchard.functions.columns import dot, l2_norm, unit_vector
from orchard.session import BROADCAST_BYTES, cut_lineage, parallelism

TRIPLE_SCHEMA = T.StructType([T.StructField("i", T.LongType()),
                              T.StructField("j", T.LongType()),
                              T.StructField("value", T.DoubleType())])
DEFAULT_TILE_ROWS = 1024
# Tiles on a side of the square whose entries are put in order.
ORDERED_TILES = 3
# Bytes of the vectors of a group of tiles, tasks a core.
GROUP_BYTES, TASKS = 64 << 20, 4
# Inner indices of one block of a sparse product.
INNER_BLOCK = 4096
# An inner index that makes more products than this is multiplied in blocks.
HEAVY_PAIRS = 1 << 16
# Bytes of a row that holds one id, of a matrix entry, of an entry packed into its row.
ID_BYTES, ENTRY_BYTES, PACKED_BYTES = 16, 24, 16


# ------------------------------------------------------ conversions -------

def rows_to_triples(points: DataFrame, vec: str = "features") -> DataFrame:
    """One entry per (row, position); positions are 0-based."""
    ex = points.select(F.col("id").alias("i"), F.posexplode(vec).alias("j", "value"))
    return ex.select("i", F.col("j").cast("bigint").alias("j"), F.col("value").cast("double"))


def transpose(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def summed(triples: DataFrame) -> DataFrame:
    """One entry per (i, j): repeated entries add up."""
    return triples.groupBy("i", "j").agg(F.sum("value").alias("value"))


def triples_to_rows(triples: DataFrame, width: int | None = None) -> DataFrame:
    """Dense rows ``(id, features)``; missing entries are 0, repeated ones add up.

    The width defaults to 1 + the largest j (one scalar read back).  A row is
    its sorted entries with the gaps before each and after the last filled.
    """
    if width is None:
        width = triples.select(F.max("j") + 1).first()[0]
    grouped = summed(triples).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("e"))

    def zeros(n):
        return F.array_repeat(F.lit(0.0), n.cast("int"))

    filled = F.flatten(F.transform("e", lambda x, k: F.concat(
        zeros(x["j"] - F.coalesce(F.get("e", k - 1)["j"], F.lit(-1)) - 1), F.array(x["value"]))))
    tail = zeros(F.lit(int(width or 0) - 1) - F.element_at("e", -1)["j"])
    return grouped.select(F.col("i").alias("id"), F.concat(filled, tail).alias("features"))


# ------------------------------------------------------ tile product ------
def _tiles(n: int, tile_rows: int, parallelism: int) -> int:
    by_size = math.ceil(max(n, 1) / tile_rows)
    # enough tile pairs to keep every core busy even for a small matrix
    by_cores = math.ceil(math.sqrt(2 * max(parallelism, 1)))
    return max(1, min(max(by_size, by_cores), max(n, 1)))


def _tile_id(tiles: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col("id")), F.lit(tiles)).cast("int")


def _groups(n: int, size: int, par: int, pairs_per_group: float) -> int:
    """Groups of ``n`` rows of ``size`` bytes in all: enough pairs of groups for
    every core, however many rows, and at most GROUP_BYTES in a group."""
    by_cores = math.ceil(math.sqrt(TASKS * max(par, 1) / pairs_per_group))
    return max(1, min(max(-(-size // GROUP_BYTES), by_cores), max(n, 1)))


def _empty_triples():
    import numpy as np
    import pandas as pd
    return pd.DataFrame({"i": np.array([], dtype="int64"), "j": np.array([], dtype="int64"),
                         "value": np.array([], dtype="float64")})


def _tile_dot(left, right):
    """(row ids, column ids, all products) of two tiles, row-major."""
    import numpy as np
    a_ids = left["id"].to_numpy(dtype="int64")
    b_ids = right["rid"].to_numpy(dtype="int64")
    a = np.stack(left["v"].to_numpy()).astype("float64", copy=False)
    b = np.stack(right["rv"].to_numpy()).astype("float64", copy=False)
    return np.repeat(a_ids, len(b_ids)), np.tile(b_ids, len(a_ids)), (a @ b.T).ravel()


def self_product(rows: DataFrame, mode: str = "full", vec: str = "features",
                 tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Entries of ``X . X^T`` for a row table X ``(id, vec)``.

    mode ``full``: all (i, j);  ``strict_upper``: only i < j.  Only pairs of
    groups (a, b) with a <= b are multiplied; for ``full`` the off-diagonal
    tiles are mirrored on output.
    """
    n, entries = rows.agg(F.count(F.lit(1)), F.sum(F.size(vec))).first()
    groups = _groups(n, 8 * (entries or 0), parallelism(rows.sparkSession), 0.5)
    # a copy of a row for each pair of groups that its own is in
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = rows.select("id", F.col(vec).alias("v"), _tile_id(groups).alias("own"), other.alias("other")).select(
        "id", "v", "own", F.least("own", "other").alias("ga"), F.greatest("own", "other").alias("gb"))
    return dealt.groupBy("ga", "gb").applyInPandas(_group_products(mode == "strict_upper", tile_rows), TRIPLE_SCHEMA)


def _by_value(values, size: int):
    """Places of the values in ascending order, ``size`` at a time."""
    import numpy as np
    order = np.argsort(values)
    for k in range(0, len(order), size):
        yield order[k:k + size]


def _group_products(strict: bool, tile_rows: int):
    """Function of a pair of groups: the products of the rows of the one with
    those of the other, a square of tiles at a time."""
    side = tile_rows * ORDERED_TILES

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        ids, own, x, first, last = [], [], [], 0, 0
        for f in frames:
            if len(f):
                first, last = int(f["ga"].iloc[0]), int(f["gb"].iloc[0])
                ids.append(f["id"].to_numpy(dtype="int64"))
                own.append(f["own"].to_numpy())
                x.append(np.stack(f["v"].to_numpy()).astype("float64", copy=False))
        if not ids:
            return
        ids, own, x = np.concatenate(ids), np.concatenate(own), np.concatenate(x)

        def tiles(group):
            at = np.flatnonzero(own == group)
            return [at[k:k + side] for k in range(0, len(at), side)]

        left, same = tiles(first), first == last
        right = left if same else tiles(last)
        for m, a in enumerate(left):
            for b in right[m:] if same else right:
                diagonal, products = a is b, (x[a] @ x[b].T).ravel()
                for at in _by_value(products, tile_rows ** 2):
                    row, col = np.divmod(at, len(b))
                    ii, jj, vv = ids[a][row], ids[b][col], products[at]
                    if strict:
                        # each unordered pair of an off-diagonal pair of tiles occurs once
                        keep = ii < jj if diagonal else ii != jj
                        ii, jj, vv = ii[keep], jj[keep], vv[keep]
                        yield pd.DataFrame({"i": np.minimum(ii, jj), "j": np.maximum(ii, jj), "value": vv})
                    elif diagonal:
                        yield pd.DataFrame({"i": ii, "j": jj, "value": vv})
                    else:
                        yield pd.DataFrame({"i": np.concatenate([ii, jj]), "j": np.concatenate([jj, ii]),
                                            "value": np.concatenate([vv, vv])})

    return fn


def product(left_rows: DataFrame, right_rows: DataFrame, vec: str = "features",
            tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Entries of ``L . R^T`` of two row tables: value(i, j) = dot(L row i, R row j).

    With a bounded right side (the labelled rows, say) the output grows with
    the left side alone.
    """
    par = parallelism(left_rows.sparkSession)
    tl = _tiles(left_rows.count(), tile_rows, par)
    tr = _tiles(right_rows.count(), tile_rows, par)
    left = left_rows.select("id", F.col(vec).alias("v"), _tile_id(tl).alias("ta"),
                            F.explode(F.sequence(F.lit(0), F.lit(tr - 1))).alias("tb"))
    right = right_rows.select(F.col("id").alias("rid"), F.col(vec).alias("rv"),
                              F.explode(F.sequence(F.lit(0), F.lit(tl - 1))).alias("ta"),
                              _tile_id(tr).alias("tb"))

    def fn(a, b):
        import pandas as pd
        if len(a) == 0 or len(b) == 0:
            return _empty_triples()
        ii, jj, vv = _tile_dot(a, b)
        return pd.DataFrame({"i": ii, "j": jj, "value": vv})

    return left.groupBy("ta", "tb").cogroup(right.groupBy("ta", "tb")).applyInPandas(fn, TRIPLE_SCHEMA)


def _block_products(tile_rows: int):
    """Function of a pair of groups of packed rows and columns that share one
    block of inner indices: their products, only where both have an entry at an
    index, a square of tiles at a time."""

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        got = {True: [], False: []}
        for f in frames:
            for side in got:
                part = f[f["of_a"] == side]
                if len(part):
                    got[side].append((part["key"].to_numpy(), part["inner"].map(len).to_numpy(),
                                      np.concatenate(part["inner"].to_numpy()),
                                      np.concatenate(part["v"].to_numpy()).astype("float64")))
        if not got[True] or not got[False]:
            return
        (rows, n, j, x), (cols, m, i, y) = ([np.concatenate(c) for c in zip(*got[s])] for s in (True, False))
        inner = np.intersect1d(j, i)
        # dense tiles of many inner indices stay small
        side = tile_rows * min(max(INNER_BLOCK // max(len(inner), 1), 1), ORDERED_TILES)

        def tiles(keys, lengths, at, v):
            """Keys of a tile, its entries at the inner indices, where it has one."""
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for k in range(0, len(keys), side):
                some, part = keys[k:k + side], slice(ends[k], ends[min(k + side, len(keys))])
                row = np.repeat(np.arange(len(some)), lengths[k:k + side])
                keep = np.isin(at[part], inner)
                row, place = row[keep], np.searchsorted(inner, at[part][keep])
                dense, met = np.zeros((len(some), len(inner))), np.zeros((len(some), len(inner)), "float32")
                dense[row, place], met[row, place] = v[part][keep], 1
                yield some, dense, met

        for r, a, met_a in tiles(rows, n, j, x):
            for c, b, met_b in tiles(cols, m, i, y):
                met = np.flatnonzero(met_a @ met_b.T)
                products = (a @ b.T).ravel()[met]
                for at in _by_value(products, tile_rows ** 2):
                    p, q = np.divmod(met[at], len(c))
                    yield pd.DataFrame({"i": r[p], "j": c[q], "value": products[at]})

    return fn


def multiply_triples(a: DataFrame, b: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS,
                     inner_block: int = INNER_BLOCK, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """C = A . B for sparse matrices given as triples (A is n x m, B is m x p).

    An inner index with x entries in A and y in B makes x * y products.  Light
    indices (at most ``heavy_pairs`` products) are joined on the index and
    summed by (i, j) with map-side combine: no entry is copied.  Heavy ones are
    multiplied in blocks, dense tiles being what they make; the partial sums of
    both meet in one aggregation, unless one block makes all of them.  Repeated
    entries add up first.

    Where no index has more entries in B than blocks would make copies of an
    entry of A, and B is small enough to broadcast, A is not moved: its entries
    are multiplied where they are read and leave combined by (i, j), repeated
    ones adding up there.
    """
    b = cut_lineage(summed(b))
    n_b, widest = b.groupBy("i").agg(F.count(F.lit(1)).alias("y")).agg(F.sum("y"), F.max("y")).first()
    if (n_b or 0) * ENTRY_BYTES <= BROADCAST_BYTES:
        columns = b.select("j").distinct().count()
        if (widest or 0) <= _tiles(columns, tile_rows, parallelism(b.sparkSession)):
            return _join_product(a, F.broadcast(b))
    a = cut_lineage(summed(a))
    of_a = a.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    of_b = b.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    is_heavy = F.col("x") * F.col("y") > heavy_pairs
    met = cut_lineage(of_a.join(of_b, "k").select("k", is_heavy.alias("heavy"), F.floor(
        F.col("k") / inner_block).alias("block")))
    n_heavy, n_light, lowest, highest = met.agg(
        F.count_if("heavy"), F.count_if(~F.col("heavy")), *(f(F.when(F.col("heavy"), F.col("block"))) for f in (
            F.min, F.max))).first()
    if not n_heavy:
        return _join_product(a, b)
    heavy = met.where("heavy").select("k")
    side = F.broadcast(heavy) if n_heavy * ID_BYTES <= BROADCAST_BYTES else heavy
    of_j, of_i = side.withColumnRenamed("k", "j"), side.withColumnRenamed("k", "i")
    blocks = _block_sums(a.join(of_j, "j", "left_semi"), b.join(of_i, "i", "left_semi"), tile_rows, inner_block)
    if not n_light and lowest == highest:
        return blocks                           # an (i, j) is made once: nothing to sum
    light = _join_product(a.join(of_j, "j", "left_anti"), b.join(of_i, "i", "left_anti"))
    return summed(light.unionByName(blocks))


def _join_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of the entries that meet at an inner index, summed by (i, j)."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("col"), F.col("value").alias("rv"))
    met = a.select("i", F.col("j").alias("k"), "value").join(right, "k")
    return summed(met.select("i", F.col("col").alias("j"), (F.col("value") * F.col("rv")).alias("value")))


def _block_sums(a: DataFrame, b: DataFrame, tile_rows: int, inner_block: int) -> DataFrame:
    """Partial products per block of inner indices and pair of groups of rows of
    A and columns of B, whose entries travel packed."""
    par = parallelism(a.sparkSession)

    def packed(triples, key, inner):
        block = F.floor(F.col(inner) / inner_block).alias("block")
        return triples.groupBy(F.col(key).alias("key"), block).agg(F.collect_list(F.struct(
            F.col(inner).alias("k"), "value")).alias("e")).select("key", "block", F.col("e.k").alias("inner"),
                                                                  F.col("e.value").alias("v"))

    def groups(triples, key):
        entries, keys = triples.agg(F.count(F.lit(1)), F.approx_count_distinct(key)).first()
        return _groups(keys, PACKED_BYTES * entries, par, 1)

    def group(n):
        return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")

    def copies(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    ga, gb = groups(a, "i"), groups(b, "j")
    left = packed(a, "i", "j").select(F.lit(True).alias("of_a"), "*", group(ga).alias("ga"), copies(gb).alias("gb"))
    right = packed(b, "j", "i").select(F.lit(False).alias("of_a"), "*", group(gb).alias("gb"), copies(ga).alias("ga"))
    return left.unionByName(right).groupBy("ga", "gb", "block").applyInPandas(
        _block_products(tile_rows), TRIPLE_SCHEMA)


# ---------------------------------------------------------- cosine --------

def unit_rows(points: DataFrame, vec: str = "features") -> DataFrame:
    """(id, features / ||features||): the norm is its own projection, O(d) per row."""
    normed = points.select("id", F.col(vec).alias("_v"), l2_norm(vec).alias("_norm"))
    return normed.select("id", unit_vector("_v", "_norm").alias("features"))


def cosine_full(points: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """All entries of the cosine matrix, diagonal included."""
    return self_product(unit_rows(points), "full", tile_rows=tile_rows)


def cosine_upper(points: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Entries with i < j only (the column-similarity layout)."""
    return self_product(unit_rows(points), "strict_upper", tile_rows=tile_rows)


def column_similarities(triples: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Cosine between the columns of the transpose of a triple matrix, i < j.

    Columns of the transpose are the rows of the matrix as loaded: their unit
    rows (norms from the summed entries) times their transpose.  Pairs that
    share no index are 0 and not listed.
    """
    once = summed(triples)
    norms = once.groupBy("i").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    unit = once.join(norms, "i").select("i", "j", F.when(F.col("norm") == 0, 0.0).otherwise(
        F.col("value") / F.col("norm")).alias("value"))
    return multiply_triples(unit, transpose(unit), tile_rows).where("i < j")


def drop_entries_of(triples: DataFrame, ids: DataFrame, bound: int | None = None) -> DataFrame:
    """Remove entries whose row or column is in ``ids(id)``.

    To keep such entries out of a similarity matrix, drop the rows before the
    product instead.
    """
    side = ids.select("id")
    if bound is not None and bound * ID_BYTES <= BROADCAST_BYTES:
        side = F.broadcast(side)
    out = triples.join(side.withColumnRenamed("id", "i"), "i", "left_anti")
    return out.join(side.withColumnRenamed("id", "j"), "j", "left_anti").select("i", "j", "value")


def row_sums(triples: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """density(id) = sum of the entries of each row i; with an index set
    ``ids(id)``, for exactly its rows: those without entries have 0."""
    sums = triples.groupBy(F.col("i").alias("id")).agg(F.sum("value").alias("density"))
    if ids is None:
        return sums
    return ids.select("id").join(sums, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def shrink_row_sums(sums: DataFrame, triples: DataFrame, removed: DataFrame,
                    bound: int | None = None) -> DataFrame:
    """``row_sums`` after the rows and columns ``removed(id)`` left ``triples``.

    Only the entries of the removed columns are read again and subtracted; all
    other sums are kept up as they are.  A row that loses its last entry
    comes back to 0 but for rounding.
    """
    side = removed.select("id")
    if bound is not None and bound * ID_BYTES <= BROADCAST_BYTES:
        side = F.broadcast(side)
    gone = triples.join(side.withColumnRenamed("id", "j"), "j", "left_semi").join(
        side.withColumnRenamed("id", "i"), "i", "left_anti")
    loss = gone.groupBy(F.col("i").alias("id")).agg(F.sum("value").alias("loss"))
    return sums.join(side, "id", "left_anti").join(loss, "id", "left").select(
        "id", (F.col("density") - F.coalesce("loss", F.lit(0.0))).alias("density"))


# --------------------------------------------------------- density --------

def sum_vector(points: DataFrame, vec: str = "features") -> DataFrame:
    """One row: the element-wise sum of all vectors, as ``total ARRAY<DOUBLE>``.

    posexplode + sum per position: the aggregate has one group per position
    (the width), combined map-side.
    """
    per_dim = points.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim") \
        .agg(F.sum("x").alias("s"))
    return per_dim.select(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))),
                                      lambda e: e["s"]).alias("total"))


def reference_total(reference: DataFrame, vec: str = "features") -> DataFrame:
    """One row ``(total, n_ref)``: sum of the unit vectors of the reference set.

    Entries are exploded raw and divided by the row's norm afterwards, so
    the unit vector is never materialised as an array.
    """
    normed = reference.select(F.col(vec).alias("_v"), l2_norm(vec).alias("_norm"))
    entries = normed.select(F.posexplode("_v").alias("dim", "x"), "_norm")
    unit = F.when(F.col("_norm") == 0, F.lit(0.0)).otherwise(F.col("x") / F.col("_norm"))
    per_dim = entries.groupBy("dim").agg(F.sum(unit).alias("s"))
    tot = per_dim.select(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))),
                                     lambda e: e["s"]).alias("total"))
    n_ref = reference.select(F.count(F.lit(1))).scalar()
    return tot.select("total", n_ref.alias("n_ref"))


def shrink_total(total: DataFrame, removed: DataFrame, vec: str = "features") -> DataFrame:
    """The reference total after ``removed`` rows left the reference set.

    total(current) = total(initial) - sum of the removed rows' unit vectors;
    ``removed`` is small (the rows labelled so far), so this costs a d-row
    aggregate over it instead of a pass over the pool.
    """
    gone = reference_total(removed, vec)
    both = total.select("total", "n_ref", gone.select("total").scalar().alias("_g"),
                        gone.select("n_ref").scalar().alias("_gn"))
    diff = F.zip_with("total", F.coalesce("_g", F.array().cast("array<double>")),
                      lambda a, b: a - F.coalesce(b, F.lit(0.0)))
    return both.select(diff.alias("total"), (F.col("n_ref") - F.col("_gn")).alias("n_ref"))


def density_from_total(frame: DataFrame, total: DataFrame, include_self: bool = True,
                       reference: DataFrame | None = None, mean: bool = False,
                       vec: str = "features") -> DataFrame:
    """``frame`` plus ``density`` = u_i . total, one projection, O(d) per row.

    The one-row total enters as a scalar subquery column (no join, no
    collect).  ``include_self=False`` drops the 1.0 a row contributes to its
    own density when it is in ``reference`` (that needs one join on id).
    """
    normed = frame.select("*", l2_norm(vec).alias("_norm"),
                          total.select("total").scalar().alias("_total"))
    units = unit_vector(vec, "_norm")
    dens = normed.select("*", F.coalesce(dot(units, "_total"), F.lit(0.0)).alias("_d"))
    if not include_self:
        ref = (reference if reference is not None else frame).select(
            "id", F.lit(True).alias("_in_ref"))
        dens = dens.join(ref, "id", "left").withColumn(
            "_d", F.col("_d") - F.when(F.col("_in_ref") & (F.col("_norm") > 0), 1.0).otherwise(0.0))
    if mean:
        dens = dens.withColumn("_d", F.try_divide(F.col("_d"), total.select("n_ref").scalar()))
    return dens.select(*frame.columns, F.col("_d").alias("density"))


def density_linear(points: DataFrame, reference: DataFrame | None = None,
                   include_self: bool = True, mean: bool = False) -> DataFrame:
    """density(i) = sum over j in reference of cos(i, j), in O(n * d).

    ``reference`` is a point table (default: all of ``points``).  With
    ``include_self=False`` a row that is in the reference drops its own 1.0.
    """
    ref = points if reference is None else reference
    total = reference_total(ref)
    out = density_from_total(points.select("id", "features"), total, include_self, ref, mean)
    return out.select("id", "density")
