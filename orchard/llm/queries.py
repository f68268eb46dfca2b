"""Registered queries of the document operators: query name -> callable.

Each applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.llm import (audit, chat, decontaminate, fingerprint, language, manifest, mixing, neardup, secret_scan,
                         tokens, topk, toxicity, urls)
from orchard.llm.common import documents
from orchard.session import cut_lineage, scratch_path
from orchard.sources.tables import read_table

#: Fixed values of the registered queries.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
PIECES = "piece_bpe_32k.model"
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
MIX_DIMS = ["source", "lang", "topic"]
#: Target shares follow these powers of a category's own tokens.
MIX_POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}
#: A quarter of the tokens: within what every category can give.
MIX_BUDGET, MIX_SWEEPS = 0.25, 10


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in id order and read back."""
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    tokens.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.token_digests(tokens.read_tokens(spark, path))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op3_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprint.fingerprints_with_edits(documents(spark, sf_dir))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    return decontaminate.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked probabilities of all documents and the documents they draw."""
    # texts are read once; the narrow table serves the cells and the draw
    docs = cut_lineage(documents(spark, sf_dir).select(
        "doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"),
        mixing.token_count(F.col("text")).alias("n_tokens")))
    out = mixing.mix(docs, MIX_DIMS, MIX_POWERS, MIX_BUDGET, sweeps=MIX_SWEEPS, bounded=True)
    return out.withColumn("probability", F.round("probability", 6))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from each participant's perspective; the
    mask as start-end pairs, comma-joined."""
    out = chat.rotations(read_table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.concat_ws(",", F.transform("mask", lambda m: F.concat_ws(
        "-", m["start"].cast("string"), m["end"].cast("string")))))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the longest rule that fits it."""
    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.scan(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows that are not held out."""
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(docs, public_tokenizers.path(PIECES)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 80 % Jaccard."""
    return neardup.components_of(documents(spark, sf_dir), shingle=4)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every 50th vector by integer inner product."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over the stream of document files."""
    return audit.audit(audit.counters(spark, f"{sf_dir.rstrip('/')}/documents.parquet",
                                      read_table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document."""
    return manifest.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_files, op2_toxicity, op3_winnowing_fingerprints, op4_benchmark_decontamination,
        op5_source_mixing, op6_chat_rotation, op7_url_filter, op8_secret_scan, op9_language_id,
        op10_minhash_near_dedup, op11_exact_topk, op12_filter_audit, op13_merkle_manifest)
}
