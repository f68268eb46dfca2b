"""Document fingerprints by winnowing, in DataFrame functions only.

Text is lower-cased and cut at white space into words; a run of more than
``PIECE`` characters counts as several words, so texts without spaces have
k-grams too.  Of the hashes of all k-grams the minimum of each window of
``width`` k-grams is kept (rightmost on ties) with its position, so two texts
that share a run of width + k - 1 words share a fingerprint of it.

A fingerprint as text: ``position:hash`` entries, comma-joined, in order.
Likeness is the Jaccard similarity of two fingerprints' hashes; two texts
without words are alike (1), one with and one without are not (0).

Neighbours (the next document in ascending id order) are found without a
global window: ids are cut into ranges at percentiles, one window runs inside
each range, and each range also gets a copy of the document that follows it.

Defined cases: null texts are empty; null ids come first; rows that repeat an
id are ordered by a hash of their text; extra columns are ignored; a single
document is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.llm import winnow
from orchard.session import cut_lineage

PIECE = 16
#: Documents of one range, and the most ranges there are.
RANGE_ROWS, MAX_RANGES = 1500, 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))


def with_fingerprint(df: DataFrame, text: str, to: str, k: int, width: int) -> DataFrame:
    """``df`` plus ``to``: array<bigint> of fingerprint codes (hash, position)."""
    w, c = f"_{to}_words", f"_{to}_codes"
    return (df.withColumn(w, words_of(F.col(text)))
            .withColumn(c, winnow.gram_codes(F.col(w), k))
            .withColumn(to, F.array_distinct(winnow.window_minima(F.col(c), width)))
            .drop(w, c))


def as_text(codes: Column) -> Column:
    return F.concat_ws(",", F.transform(codes, lambda x: F.concat(
        winnow.position_of(x).cast("string"), F.lit(":"), F.hex(winnow.hash_of(x)))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    x = F.array_distinct(F.transform(a, winnow.hash_of))
    y = F.array_distinct(F.transform(b, winnow.hash_of))
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _range_of(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the id, found in two steps (coarse, fine)."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1::step]]).cast("array<bigint>")
    every = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    up_to = F.size(F.filter(coarse, lambda b: b <= id_col)) * step
    rest = F.size(F.filter(F.slice(every, up_to + 1, step), lambda b: b <= id_col))
    return F.when(id_col.isNull(), 0).otherwise(up_to + rest)


def next_documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` (doc_id, carry ...) plus ``next_<column>`` of the next document
    in ascending id order; the last one's next is the first."""
    rows = docs.withColumn("_tie", F.xxhash64("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000)).first()[0] \
        if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("_range", _range_of(F.col("doc_id"), bounds) if bounds else F.lit(0))
    # one row per range: its first document, and the range before it
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_tie")
    firsts = rows.groupBy("_range").agg(F.min(order).alias("f"))
    w = Window.orderBy("_range")
    firsts = cut_lineage(firsts.select(
        F.col("f.doc_id").alias("_fid"), F.col("f._tie").alias("_ftie"), F.col("_range").alias("_own"),
        F.lag("_range").over(w).alias("_before"),
        F.max("_range").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last")))
    marked = rows.join(F.broadcast(firsts), rows["doc_id"].eqNullSafe(firsts["_fid"])
                       & (rows["_tie"] == firsts["_ftie"]) & (rows["_range"] == firsts["_own"]), "left")
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    there = F.struct(F.coalesce("_before", "_last").alias("r"), F.lit(1).alias("copy"))
    placed = marked.withColumn("_at", F.explode(F.when(F.col("_own").isNull(), F.array(here))
                                                .otherwise(F.array(here, there))))
    w = Window.partitionBy("_at.r").orderBy("_at.copy", F.col("doc_id").asc_nulls_first(), "_tie")
    placed = placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return placed.where("_at.copy = 0").select(*docs.columns, *[f"next_{c}" for c in carry])


def fingerprints_with_edits(documents: DataFrame, k: int = 5, width: int = 16) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter
    replaced by the start of the next document's text), and their likeness."""
    docs = with_fingerprint(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")),
        "text", "codes", k, width)
    near = next_documents(docs, ["text", "codes"])
    n = F.length("text")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.floor(n / 4).cast("int"))
    near = near.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - F.col("_cut")),
        F.substring(F.col("next_text"), F.lit(1), F.col("_cut"))))
    near = with_fingerprint(near, "edited", "edited_codes", k, width)
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"), as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
