"""Near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard.

A document's set holds its distinct ``SHINGLE``-word shingles (fewer words:
the whole sequence as one; none: empty).  Two documents link when their sets'
Jaccard similarity is at least ``threshold``.

1. One hash function orders all shingles; a document keeps its ``k`` smallest
   values (a set of at most k is kept whole).  Documents with equal sets
   collapse to their smallest id first, so exact copies cost nothing later.
2. Inverted lists of retained values propose pairs.  Linked pairs share at
   least ``m`` retained values (m = 30 of 64: a pair at 0.8 shares 51 on
   average, fewer than 30 with a chance below 1e-9), so each document only
   needs its k - m + 1 rarest values in the lists (rarest over the whole
   corpus, one order for all): a passage shared by many documents drops out
   of the lists of those that hold it beside other text.  A list is kept per
   size class, as linked sets differ by a factor of 1/threshold at most.
3. Lists never emit all their pairs.  First every member is paired with the
   list's centre, the member with the smallest share of shingles that no
   other listed document has; verified links are merged into components.
   Then only members of different components are paired, through the rarest
   shingles of their full sets and the positions these have in both.
4. The union sketch estimates each candidate's similarity and drops those
   that cannot be linked; full sets of both texts verify the rest.

Links inside a component that is already joined are not needed for the
result and are not verified; no link between components is lost.

Defined cases: null or word-less text has 0 shingles and links with nothing;
a null id is kept and never linked; rows that repeat an id are one node;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import (WordHasher, broadcast_if_small, connected_components, row_slices,
                                run_hashes, text_slices)
from orchard.session import cut_lineage

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def shared_at_least(k: int, threshold: float) -> int:
    """Retained values that linked documents share but for a chance below 1e-9
    (binomial lower tail at ``threshold``)."""
    tail, m = 0.0, 0
    while m < k:
        tail += math.comb(k, m) * threshold ** m * (1 - threshold) ** (k - m)
        if tail > 1e-9:
            return max(1, m)
        m += 1
    return max(1, m)


def shingle_sets(texts, hasher: WordHasher, shingle: int):
    """Yield the sorted distinct shingle hashes of each text, in order."""
    for _, _, data, offsets in text_slices(texts):
        words, first = hasher.words(data, offsets)
        grams = run_hashes(words, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= shingle:
                yield np.unique(grams[a:b - shingle + 1])
            else:
                yield run_hashes(words[a:b], n) if n else words[:0]


def sketches(docs: DataFrame, k: int, shingle: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch): set size, 128-bit set key, k smallest values."""

    def part(batches):
        hasher = WordHasher(WHITE_SPACE)
        for batch in row_slices(batches):
            n, keys, flat, lens = [], [], [], []
            for s in shingle_sets(batch.column(1), hasher, shingle):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                flat.append(s[:k].copy())
                lens.append(min(k, len(s)))
            if not n:
                continue
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            values = np.concatenate(flat).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["doc_id", "n", "k1", "k2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        part, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def _list_members(reps: DataFrame, k: int, m: int, step: float) -> DataFrame:
    """(value, class, doc_id, n): each document under its rarest values, in its
    own size class and the next larger one."""
    postings = reps.select("doc_id", "n", F.explode("sketch").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(frequent, "value")
    size = F.least(F.col("n"), F.lit(k))
    # whole sets (n < k) share at least 0.75 n values; sketches share at least m
    needed = F.when(F.col("n") < k, F.ceil(F.lit(0.75) * F.col("n"))).otherwise(F.lit(m))
    per_doc = shared.groupBy("doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # values that only this document has are its rarest: they come first
    room = size - needed + 1 - (size - F.size("vs"))
    kept = per_doc.select("doc_id", "n", room.cast("int").alias("room"), "vs").where("room > 0").select(
        "doc_id", "n", F.explode(F.expr("slice(vs, 1, room)")).alias("x"))
    cls = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(step))).cast("int")
    return kept.select(F.col("x.value").alias("value"), "doc_id", "n",
                       F.explode(F.array(cls, cls + 1)).alias("class"))


def _near(pairs: DataFrame, reps: DataFrame, k: int, m: int) -> DataFrame:
    """Pairs (a, b) whose union sketch holds at least m / k common values."""
    sk = reps.select(F.col("doc_id"), "sketch")
    both = pairs.join(sk.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sk.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where(common * k >= F.size(union) * m).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, threshold_pct: int, shingle: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids, 16), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def part(batches):
        hasher = WordHasher(WHITE_SPACE)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sets = zip(shingle_sets(batch.column(2), hasher, shingle),
                       shingle_sets(batch.column(3), hasher, shingle))
            for i, (x, y) in enumerate(sets):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= threshold_pct * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(part, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, n, value): the full shingle sets of the documents ``ids``,
    one row per shingle; ``key`` tells texts with the same id apart."""

    def part(batches):
        hasher = WordHasher(WHITE_SPACE)
        for batch in row_slices(batches):
            sets = list(shingle_sets(batch.column(1), hasher, shingle))
            if sets:
                n = np.array([len(x) for x in sets])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                key = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=7).digest()) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(key, pa.int64()), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["doc_id", "key", "n", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        broadcast_if_small(ids.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    return texts.mapInArrow(part, "doc_id long, key long, n long, values array<long>").select(
        "doc_id", "key", "n", F.explode("values").alias("value"))


def _unique_counts(active: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, u): shingles of an active document that no other active one
    has, over full sets.  0 for an id that stands for several texts."""
    ids = active.groupBy("doc_id").agg(F.count("*").alias("texts"))
    owners = _full_sets(ids, docs, shingle).groupBy("value").agg(
        F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1")
    counts = owners.groupBy("doc_id").agg(F.count("*").alias("u"))
    return ids.join(counts, "doc_id", "left").select(
        "doc_id", F.when(F.col("texts") == 1, F.coalesce("u", F.lit(0))).otherwise(0).alias("u"))


def _may_link(na, ua, nb, ub, threshold_pct: int):
    """Whether sets of these sizes and unique counts can reach the threshold:
    the intersection holds no unique shingle of either side."""
    common = F.least(na - ua, nb - ub)
    return common * 100 >= (na + nb - common) * threshold_pct


def _across(members: DataFrame, components: DataFrame, docs: DataFrame, threshold_pct: int,
            shingle: int) -> DataFrame:
    """Candidate pairs among list members that lie in different components.

    Documents of lists that hold several components are compared anew through
    their full sets, ordered from the rarest shingle among them: linked sets
    share one of the first n - ceil(t n) + 1, and at a first common shingle
    the remaining positions must still allow the needed intersection.
    """
    labelled = members.select("value", "class", "doc_id").join(
        components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    open_lists = labelled.groupBy("value", "class").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value", "class")
    left = cut_lineage(labelled.join(open_lists, ["value", "class"]).select("doc_id", "component").distinct())

    rows = cut_lineage(_full_sets(left, docs, shingle))
    frequent = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per_doc = rows.join(frequent, "value").groupBy("doc_id", "key", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    # shingles that only this document has are its rarest: they come first
    alone = F.col("n") - F.size("vs")
    room = F.col("n") - F.ceil(F.col("n") * threshold_pct / 100) + 1 - alone
    prefixes = cut_lineage(per_doc.select(
        "doc_id", "n", alone.alias("alone"), room.cast("int").alias("room"), "vs").where("room > 0").select(
        "doc_id", "n", "alone", F.posexplode(F.expr("slice(vs, 1, room)")).alias("at", "x")).select(
        "doc_id", "n", (F.col("alone") + F.col("at") + 1).alias("at"), F.col("x.value").alias("value")).join(
        left, "doc_id"))

    def side(x):
        return prefixes.select("value", *[F.col(c).alias(c[0] + x) for c in ("doc_id", "n", "at", "component")])

    common = 1 + F.least(F.col("na") - F.col("aa"), F.col("nb") - F.col("ab"))
    return side("a").join(side("b"), "value").where(
        (F.col("da") < F.col("db")) & (F.col("ca") != F.col("cb"))
        & (common * 100 >= (F.col("na") + F.col("nb") - common) * threshold_pct)).select(
        F.col("da").alias("a"), F.col("db").alias("b")).distinct()


def components_of(docs: DataFrame, k: int = 64, threshold_pct: int = 80, shingle: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    threshold = threshold_pct / 100
    m = shared_at_least(k, threshold)
    sk = cut_lineage(sketches(docs, k, shingle))
    valid = sk.where("n > 0 and doc_id is not null")
    classes = valid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    keyed = valid.join(classes, ["k1", "k2"])
    copies = keyed.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = keyed.where("doc_id = rep").select("doc_id", "n", "sketch")
    listed = cut_lineage(_list_members(reps, k, m, 1 / threshold))
    active = cut_lineage(reps.join(broadcast_if_small(listed.select("doc_id").distinct(), 16),
                                   "doc_id", "left_semi"))
    # a set whose unique shingles pass 1 - t of it cannot reach the threshold
    members = cut_lineage(listed.join(_unique_counts(active, docs, shingle), "doc_id").where(
        (F.col("n") - F.col("u")) * 100 >= F.col("n") * threshold_pct))

    # a list's centre is the member with the smallest share of unique shingles
    order = F.struct((F.col("u") / F.col("n")).alias("share"), "doc_id", "n", "u")
    centre = members.groupBy("value", "class").agg(F.min(order).alias("c"), F.count("*").alias("size")).where(
        "size > 1").select("value", "class", "c")
    spokes = members.join(centre, ["value", "class"]).where(
        (F.col("doc_id") != F.col("c.doc_id"))
        & _may_link(F.col("n"), F.col("u"), F.col("c.n"), F.col("c.u"), threshold_pct)).select(
        F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
    first = cut_lineage(_verified(_near(spokes, active, k, m), docs, threshold_pct, shingle))
    rest = _across(members, cut_lineage(connected_components(first)), docs, threshold_pct, shingle)
    second = _verified(_near(rest, active, k, m), docs, threshold_pct, shingle)
    component = connected_components(first.union(second).union(copies))
    out = sk.select("doc_id", F.col("n").alias("n_shingles")).join(
        component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component_id).alias("kept"))
