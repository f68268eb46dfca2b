"""Cases of the findings of round 3: sweeps that shuffled a small table of cells,
and pieces that were encoded anew whenever the cache was full."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orchard.llm import mixing, tokens
from orchard.llm.queries import END_ID, TOKENIZER


def _tasks(spark, group, run):
    """What ``run`` returns, and the tasks of its stages."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    infos = [tracker.getStageInfo(s) for s in stages]
    return out, sum(i.numCompletedTasks for i in infos if i)


def _weighed(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice("aaabc"), rng.choice(["x"] * 5 + ["y", None]), rng.randrange(1, 50)) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")


def test_sweeps_over_few_cells_shuffle_nothing(spark, monkeypatch):
    dims, powers = ["source", "lang"], {"source": 0.5, "lang": 0.2}
    docs = _weighed(spark)

    def run():
        return {r["doc_id"]: r["probability"] for r in mixing.mix(docs, dims, powers, 1.0, hold=True, sweeps=4).collect()}

    with_few, tasks = _tasks(spark, "few-cells", run)
    assert tasks < 400
    # larger tables stay dealt out by category, with the same probabilities
    monkeypatch.setattr(mixing, "GATHERED", 3)
    spread, more = _tasks(spark, "many-cells", run)
    assert more > 2 * tasks
    assert spread == pytest.approx(with_few, rel=1e-9)


def test_known_pieces_are_not_encoded_anew_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    path = public_tokenizers.path(TOKENIZER)
    encoder, plain = tokens.CachedEncoder(path, END_ID), Tokenizer.from_file(path)
    asked, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts, **how: asked.extend(" ".join(texts).split()) or encode(texts, **how))
    rng = random.Random(5)
    for _ in range(30):
        words = ["".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(30)]
        text = " ".join(["Often,", "véry", *words, "it's", "7..", "met"])
        want = np.array([*plain.encode(text, add_special_tokens=False).ids, END_ID], "<i4").tobytes()
        assert encoder.encode(text) == want
        assert len(encoder.pieces) + len(getattr(encoder, "older", ())) < 2 * (40 + 40)
    assert [asked.count(p) for p in ("often", "véry", "met")] == [1, 1, 1]
