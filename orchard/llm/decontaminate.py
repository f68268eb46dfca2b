"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII
characters.  A window is ``window`` consecutive words of a benchmark item (a
shorter item is one window); every document word inside an occurrence of a
window is hit.

For windows of L words, k = ceil(L / 2) and winnowing windows of L - k + 1
k-grams make sure that each shared span of L words holds a common fingerprint
at the same place.  Document fingerprints meet the benchmark's fingerprint
hashes, hits are extended to the windows around them, and those windows' words
are compared with the benchmark's as text, so no hash decides a hit.
Fingerprint hashes (8 bytes each) are broadcast within a checked size and
shuffled beyond it; so are the benchmark's windows.

Defined cases: null texts have no words; items without words have no window;
an item without id marks its words as hit but is not counted or listed;
items that share an id are one item; rows that repeat an id are judged by
their own texts; ties of fingerprints go right; extra columns are ignored;
without documents the result is empty, without items nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm import winnow
from orchard.llm.common import broadcast_if_small
from orchard.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text):
    """Words of a text in order, A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _window_hits(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, start, length, item_id): occurrences in documents of
    the items' windows of ``length`` words."""
    k = (length + 1) // 2
    width = length - k + 1
    windows = cut_lineage(items.select(
        "item_id", F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.size("words") - length + 1),
            lambda s: F.concat_ws(" ", F.slice("words", s, length)))).alias("window")).distinct())

    def prints(df):
        words = F.when(F.size("words") >= length, F.col("words")).otherwise(F.array().cast("array<string>"))
        coded = df.withColumn("long_enough", words).withColumn(
            "codes", winnow.gram_codes(F.col("long_enough"), k))
        return coded.withColumn("prints", F.array_distinct(winnow.window_minima(F.col("codes"), width)))

    marks = cut_lineage(prints(items).select(F.explode_outer("prints").alias("code")).select(
        winnow.hash_of(F.col("code")).alias("h")).distinct())
    # outer explodes: an inner one would repeat its array's expression as a filter
    found = prints(docs).select("doc_id", "text_hash", "words", F.explode_outer("prints").alias("code")).select(
        "doc_id", "text_hash", "words", winnow.position_of(F.col("code")).cast("int").alias("at"),
        winnow.hash_of(F.col("code")).alias("h"))
    small = broadcast_if_small(marks, 8)
    if small is marks:
        # a benchmark beyond the broadcast size: only the hashes travel, not the words
        keys = found.select("doc_id", "text_hash", "at", "h").join(marks, "h", "left_semi")
        places = keys.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("ats")).select(
            F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "ats")
        hits = docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
                         ).select("doc_id", "text_hash", "words", F.explode("ats").alias("at"))
    else:
        hits = found.join(small, "h", "left_semi")
    starts = F.sequence(F.greatest(F.col("at") - (width - 1), F.lit(0)),
                        F.least(F.col("at"), F.size("words") - length))
    around = hits.where(F.greatest(F.col("at") - (width - 1), F.lit(0))
                        <= F.least(F.col("at"), F.size("words") - length)).select(
        "doc_id", "text_hash", F.explode_outer(F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.concat_ws(" ", F.slice("words", s + 1, length)).alias("window")))).alias("w"))
    return around.select("doc_id", "text_hash", "w.start", "w.window").join(
        broadcast_if_small(windows, 64 + 16 * length), "window").select(
        "doc_id", "text_hash", "start", F.lit(length).alias("length"), "item_id")


def hits_of(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame | None:
    """One row per contaminated text: hit_id, hit_hash (of the text), n_hit,
    n_items, items_sha256.  None if no item has a word."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    items = cut_lineage(benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(
        F.size("words") > 0))
    # lengths of windows: at most ``window`` different numbers
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]
    hits = None
    for length in sorted(lengths):
        size = F.size("words")
        own = items.where(size >= window) if length == window else items.where(size == length)
        part = _window_hits(docs, own, length)
        hits = part if hits is None else hits.union(part)
    if hits is None:
        return None
    spans = F.flatten(F.transform(F.col("spans"), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    return hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.collect_set("item_id").alias("items")).select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
        F.size(F.array_distinct(spans)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256)
        .alias("items_sha256"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    hits = hits_of(documents, benchmark, window)
    counted = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count(
        F.coalesce("text", F.lit("")), F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"))
    none, zero = F.sha2(F.lit(""), 256), F.lit(0).cast("long")
    if hits is None:
        return counted.select("doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"),
                              none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    return counted.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id"))
                        & (F.col("text_hash") == F.col("hit_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
