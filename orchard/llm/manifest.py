"""Merkle manifest of a document table: one leaf per row, a tree per source, a
tree over the sources, and for every leaf its proof up to the root.

Leaf coordinates by bitmap ranks.  A source's ids are a bitmap, kept as its
non-empty 64-bit words only: words merge by ``bit_or`` with map-side combine.
A directory gives every word the number of leaves before it: popcounts are
summed inside superblocks of 2^``SUPER_BITS`` words, then over the superblocks
(``ranking.running_sums``, no single-task window).  A leaf's position in its
source is the directory's count plus the popcount of the word's bits below its
own; leaves are never sorted.  A word with repeated ids counts its leaves
instead of its bits, and only its own few leaves are ordered.

Levels by keyed slot arrays.  Leaf p is slot p mod 16 of run p div 16; runs are
grouped by (source, run), hashed, and are the nodes of the next level.  Going
down again, every child takes over its parent's path: one {before, after} pair
of joined digests a level.  A leaf's proof and its recomputed root come from
that path; a verified row really hashes up to the root.

Every shuffle is keyed by (source, word) or (source, run), at most 64 ids or 16
nodes a group, so a hot source is split evenly.  Texts are read once.  Equal
rows are counted before anything else and expanded at the end.

Defined cases: null fields are ``-``; null ids come first in their source, in
the order of their leaves (a bitmap over the leaf's first 32 bits); rows that
repeat an id are ordered by leaf, equal rows are interchangeable; the distinct
leaves of one (source, id) meet in one task; the null source comes first, the
others bytewise; extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm.common import broadcast_if_small
from orchard.operators.ranking import index_rows, running_sums
from orchard.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, words of a superblock (a power of two), equal rows
#: expanded at once, and how often a text is tampered with.
FAN_OUT, SUPER_BITS, COPIES, TAMPER_EVERY = 16, 10, 4096, 5
_WORD = ["src", "zone", "word"]


def field(c: Column) -> Column:
    """UTF-8 byte count, ``:`` and value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame) -> DataFrame:
    """(src, doc_id, leaf, changed, n): distinct rows and how often they occur.

    ``src`` orders and separates sources (null first); ``changed`` is the leaf
    of the tampered text, null where the text is not tampered with.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    kept = [field(F.col(c)) for c in FIELDS[:-1]]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.col("doc_id").cast("long").alias("doc_id"), digest(*kept, field(F.col("text"))).alias("leaf"),
        F.when(tampered, digest(*kept, field(_lowered(F.col("text"))))).alias("changed")).groupBy(
        "src", "doc_id", "leaf", "changed").agg(F.count("*").alias("n"))


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``pos``, the place of the first copy in the source; the
    sources' leaf counts)."""
    # null ids: a bitmap of their own over the leaf's first 32 bits
    place = F.coalesce("doc_id", F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long"))
    rows = cut_lineage(rows.withColumns({
        "zone": F.col("doc_id").isNotNull().cast("int"), "word": F.shiftright(place, 6),
        "bit": place.bitwiseAND(F.lit(63)).cast("int")}))
    one = F.expr("shiftleft(1L, bit)")
    words = rows.withColumn("one", one).groupBy(*_WORD).agg(
        F.expr("bit_or(one)").alias("bits"), F.sum("n").alias("leaves"))
    words = words.withColumn("super", F.shiftright("word", SUPER_BITS))
    block = ["src", "zone", "super"]
    inside = Window.partitionBy(*block).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    words = cut_lineage(words.withColumn("inside", F.coalesce(F.sum("leaves").over(inside), F.lit(0))))
    # superblocks in order: leaves before each one in all sources, less those of earlier sources
    supers = cut_lineage(running_sums(words.groupBy(*block).agg(F.sum("leaves").alias("n")), block, ["n"]).select(
        *block, (F.col("n_cum") - F.col("n")).cast("long").alias("before"), "n"))
    sources = cut_lineage(supers.groupBy("src").agg(F.min("before").alias("first"), F.sum("n").cast("long").alias("n")))
    starts = supers.join(broadcast_if_small(sources.select("src", "first"), 64), "src").select(
        *block, (F.col("before") - F.col("first")).alias("start"))
    directory = words.join(broadcast_if_small(starts, 64), block).select(
        *_WORD, "bits", (F.col("start") + F.col("inside")).alias("start"),
        (F.col("leaves") != F.bit_count("bits")).alias("repeats"))
    found = rows.join(directory, _WORD)
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    plain = found.where("not repeats").withColumn("pos", F.col("start") + below)
    earlier = Window.partitionBy(*_WORD).orderBy("bit", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    crowded = found.where("repeats").withColumn(
        "pos", F.col("start") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return plain.union(crowded).select("src", "pos", "doc_id", "leaf", "changed", "n"), sources


def _expanded(rows: DataFrame) -> DataFrame:
    """One row per leaf: a repeated one takes consecutive places, unfolded in
    bounded pieces."""
    single = rows.where("n = 1").drop("n")
    pieces = rows.where("n > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(
        COPIES).cast("long"))).alias("at"))
    copies = pieces.select("src", F.explode(F.sequence(F.col("pos") + F.col("at"), F.col("pos") + F.least(
        F.col("at") + COPIES, F.col("n")) - 1)).alias("pos"), "doc_id", "leaf", "changed")
    return single.unionByName(copies)


def _runs(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Slot arrays of the runs: (src, pos = run, slots, hash = H of the run)."""
    run = nodes.groupBy("src", F.shiftright("pos", 4).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos").bitwiseAND(F.lit(FAN_OUT - 1)).alias("slot"), "hash", *carry))).alias("slots"))
    return run.withColumn("hash", F.sha2(F.array_join(F.transform("slots", lambda s: s["hash"]), ""), 256))


def _children(runs: DataFrame, paths: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Children of the runs with their paths: their own run's digests before
    and after them, then the parent's path."""
    parents = paths.select("src", "pos", "path", "root", "subroot")
    hashes = F.transform("slots", lambda s: s["hash"])
    rows = runs.drop("hash").join(parents, ["src", "pos"]).withColumn("hashes", hashes)
    rows = rows.select("*", F.posexplode("slots").alias("at", "s"))
    step = F.struct(F.array_join(F.slice("hashes", 1, F.col("at")), "").alias("before"),
                    F.array_join(F.slice("hashes", F.col("at") + 2, FAN_OUT), "").alias("after"))
    return rows.select("src", (F.shiftleft("pos", 4) + F.col("s.slot")).alias("pos"),
                       F.col("s.hash").alias("hash"), *[F.col(f"s.{c}").alias(c) for c in carry],
                       F.concat(F.array(step), F.col("path")).alias("path"), "root", "subroot")


def _levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(runs of each level, finished tops).  nodes: (src, pos, hash, left),
    ``left`` the nodes of the group at this level."""
    runs, tops = [], []
    while True:
        tops.append(nodes.where("left = 1"))
        if most <= 1:
            return runs, tops
        more = nodes.where("left > 1")
        run = _runs(more, ("left",))
        run = cut_lineage(run.withColumn("left", F.expr(f"(slots[0].left + {FAN_OUT - 1}) div {FAN_OUT}")))
        runs.append(run)
        nodes, most = run.select("src", "pos", "hash", "left"), -(-most // FAN_OUT)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed, sources = coordinates(leaves(docs))
    most = sources.agg(F.max("n")).first()[0] or 0
    rows = _expanded(placed).withColumnRenamed("leaf", "hash").join(
        broadcast_if_small(sources.select("src", F.col("n").alias("left")), 64), "src")
    # the leaves' runs carry what the result needs; a lone leaf has no run
    carry = ("doc_id", "changed")
    rows = cut_lineage(rows)
    first = cut_lineage(_runs(rows.where("left > 1"), ("left", *carry)).withColumn(
        "left", F.expr(f"(slots[0].left + {FAN_OUT - 1}) div {FAN_OUT}")))
    alone = rows.where("left = 1")
    upper = first.select("src", "pos", "hash", "left")
    runs, tops = _levels(upper, -(-most // FAN_OUT))
    subroots = alone.select("src", "hash")
    for top in tops:
        subroots = subroots.union(top.select("src", "hash"))
    # the same over the sources: one group, placed by their order
    subroots = index_rows(subroots, [F.col("src")], name="place")
    n_sources = sources.count()
    roots = cut_lineage(subroots.select(F.lit("").alias("src"), F.col("place").alias("pos"), "hash",
                                        F.lit(n_sources).cast("long").alias("left"), F.col("src").alias("name")))
    base = _runs(roots, ("name", "left")).withColumn(
        "left", F.expr(f"(slots[0].left + {FAN_OUT - 1}) div {FAN_OUT}"))
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    if n_sources > 1:
        base = cut_lineage(base)
        above, top = _levels(base.select("src", "pos", "hash", "left"), -(-n_sources // FAN_OUT))
        paths = top[-1].select("src", "pos", "hash", nothing.alias("path"), F.col("hash").alias("root"),
                               F.lit("").alias("subroot"))
        for run in reversed(above):
            paths = _children(run.drop("left"), paths)
        named = _children(base.drop("left"), paths, ("name",)).select(
            F.col("name").alias("src"), F.lit(0).cast("long").alias("pos"), "hash", "path", "root",
            F.col("hash").alias("subroot"))
    else:
        named = roots.select(F.col("name").alias("src"), F.lit(0).cast("long").alias("pos"), "hash",
                             nothing.alias("path"), F.col("hash").alias("root"), F.col("hash").alias("subroot"))
    named = cut_lineage(named)
    # down again: a level's nodes are the children of the level above and the tops that end there
    paths = None
    for top, run in zip(reversed(tops), [None, *reversed(runs)]):
        own = named.join(top.select("src"), "src", "left_semi")
        below = None if run is None else _children(run.drop("left"), paths)
        own = own.select("src", "pos", "path", "root", "subroot")
        paths = own if below is None else own.unionByName(below.select(own.columns))
        paths = cut_lineage(paths)
    found = _children(first.drop("left"), paths, carry)
    single = alone.drop("left").join(named.drop("hash", "pos"), "src")
    found = found.unionByName(single.select(found.columns))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    fold = F.aggregate("path", F.coalesce("changed", "hash"), lambda h, p: F.sha2(F.concat(
        p["before"], h, p["after"]), 256))
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
                        fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
