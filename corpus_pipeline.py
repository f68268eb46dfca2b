"""Corpus pipeline: documents in, token files out, one operator per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
stage's documents.  All but the last stage return the columns of documents.

A stage keeps or drops whole rows: language ID drops documents without a
language, near-dedup keeps the smallest id of each group, decontamination
drops documents that hold a benchmark window, mixing drops by the calibrated
probabilities (and writes what each category had, was to have and is drawn with
to ``mixing-report-*`` in the checkpoint folder).  The last stage writes the token files and returns their rows.
Null ids and rows that repeat an id are kept or dropped by their own text,
except in near-dedup, where rows of one id are one document.  Extra columns of
documents pass through unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orchard.llm import decontaminate, language, mixing, neardup, tokens
from orchard.llm.common import broadcast_if_small, documents
from orchard.llm.queries import END_ID, MIX_DIMS, MIX_POWERS, MIX_SWEEPS, PIECES, TOKENIZER
from orchard.session import cut_lineage, scratch_path
from orchard.sources.tables import read_table

#: Most tokens that mixing asks for, as a share of the tokens it is given; it
#: draws at the largest budget up to this one at which its targets hold.
BUDGET = 1.0
#: Documents of an Arrow batch, where the session has Spark's default: a batch of
#: whole texts is held by the executor and its Python worker at once.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    model = language.train(docs, public_tokenizers.path(PIECES))
    pred, score = mixing.fresh(docs, "lang_pred"), mixing.fresh(docs, "score")
    return language.with_prediction(docs, model, pred, score).where(
        F.col(pred) != language.UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each near-duplicate group."""
    dropped = cut_lineage(neardup.components_of(docs).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(broadcast_if_small(dropped, 16), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    hits = decontaminate.hits_of(docs, read_table(spark, sf_dir, "benchmark"))
    if hits is None:
        return docs
    hits = broadcast_if_small(cut_lineage(hits.select("hit_id", "hit_hash")), 32)
    text_hash = mixing.fresh(docs, "_text_hash")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(hits["hit_id"]) & (keyed[text_hash] == hits["hit_hash"])
    return keyed.join(hits, same, "left_anti").select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by probabilities raked to source, language and topic."""
    topic, n, p, drawn = (mixing.fresh(docs, c) for c in ("topic", "n_tokens", "probability", "sampled"))
    weighed = docs.withColumns({topic: mixing.topic_of(F.col("text")), n: mixing.token_count(F.col("text"))})
    dims = [topic if d == "topic" else d for d in MIX_DIMS]
    powers = {topic if d == "topic" else d: v for d, v in MIX_POWERS.items()}
    return mixing.mix(weighed, dims, powers, BUDGET, sweeps=MIX_SWEEPS, hold=True, tokens=n, probability=p, sampled=drawn,
                      report=scratch_path(spark, f"mixing-report-{uuid.uuid4().hex}")).where(F.col(drawn)).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; return their rows: doc_id, start, n_tokens, ids."""
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    tokens.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids")


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing_to_targets),
    ("token_files", token_files),
]

#: The language model's and the tokenizer's results have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
