"""Cases that earlier versions got wrong: whole-text ids, repeats and folding
in trigram queries, long words and pieces, clashing columns."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orchard.llm import language, mixing, secret_scan, tokens, toxicity
from orchard.llm.queries import END_ID, PIECES, TOKENIZER


def test_ids_equal_the_plain_encoding_of_whole_texts():
    encoder = tokens.CachedEncoder(public_tokenizers.path(TOKENIZER), END_ID)
    plain = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rng = random.Random(3)
    chars = [chr(c) for c in (*range(0x250), *range(0x2010, 0x203b), 0x300, 0x301, 0x3a3, 0x3c3, 0x212b, 0x1e9e,
                              0x1f600, 0x4e2d, 0xac00, 0x2028, 0x180e, 0x200b, 0xfb01)]
    common = [*"abcABC019 .,'!-\n\t", "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "İ", "İ.", "é", "Ÿ", "ſ"]
    texts = ["x<|endoftext|>y", "İ.", "", " ", "a" * 5000, "x1" * 3000, "É,é é"]
    texts += ["".join(rng.choice(common if rng.random() < 0.7 else chars) for _ in range(rng.randrange(1, 16)))
              for _ in range(8000)]
    for t in texts:
        want = np.array([*plain.encode(t, add_special_tokens=False).ids, END_ID], "<i4").tobytes()
        assert encoder.encode(t) == want, repr(t)


@pytest.mark.parametrize("rule,texts", [
    (r"[ab]{2}cd", ["aacd", "abcd", "bbcd", "acd"]), (r"(?:x|yz){1,2}end", ["xyzend", "xend", "yzxend", "end"]),
    (r"(?i)task_[0-9]+", ["TAſk_1", "tasK_2", "task_3"]), (r"(?ia)task_[0-9]+", ["taſk_1", "TASK_2"]),
    (r"(?i:bird)[0-9]", ["bırd1", "BIRD2"])])
def test_trigram_queries_lose_no_match(rule, texts):
    query = secret_scan.trigram_query(rule)
    for t in texts:
        if re.search(rule, t):
            low = "".join(c.lower() if c.isascii() else c for c in t)
            assert all(any(all(g in low for g in alt) for alt in clause) for clause in query), (rule, t)


def test_long_words_and_long_pieces_are_summed_whole():
    pieces = ["▁a", "ab", "ba", "abababababababab", "b"]           # one piece of 16 characters
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((len(pieces), 2)), np.zeros(2)])
    table = language.PieceTable(pieces)

    def brute(word, lang):
        """Forward sums with exact scaling."""
        sums, scale = [1.0], 0.0
        for end in range(1, len(word) + 1):
            x = 0.0
            for m in range(1, min(16, end) + 1):
                part = word[end - m:end]
                p = probs[pieces.index(part), lang] if part in pieces else language.RARE if m == 1 else 0.0
                x += sums[end - m] * p
            sums.append(x)
            if x < 1e-30:
                sums, scale = [s * 1e30 for s in sums], scale - math.log(1e30)
        return math.log(sums[-1]) + scale

    words = ["▁" + "ab" * n for n in (3, 15, 16, 17, 40, 400)] + ["▁a" + "x" * 300]
    for w, row in zip(words, language.forward(table, probs, words)):
        assert row == pytest.approx([brute(w, 0), brute(w, 1)], rel=1e-9), len(w)
    assert max(map(len, language.vocabulary(public_tokenizers.path(PIECES)))) > 12


def test_pipeline_stages_leave_clashing_columns_alone(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "*", "77 AS score", "'mine' AS topic", "'keep' AS sampled", "1.5D AS probability", "'x' AS lang_pred",
        "5 AS n_tokens", "'h' AS _text_hash")
    odd = spark.createDataFrame([(-1, None, None, None, None), (None, "no id at all here", "en", None, 3),
                                 (-2, "same id one text", "en", "s", 1), (-2, "same id other words", "en", "s", 1),
                                 (-3, "Word " * 40000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.selectExpr("*", "78 AS score", "'mine' AS topic", "'keep' AS sampled", "1.5D AS probability",
                         "'x' AS lang_pred", "5 AS n_tokens", "'h' AS _text_hash")
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.exceptAll(docs).count() == 0 and out.count() > 0, name


def test_mixing_report_holds_every_marginal(spark, tmp_path):
    rows = [(i, "ab"[i % 4 == 0], 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    path = str(tmp_path / "report")
    out = mixing.mix(df, ["source"], {"source": 0.0}, 1.0, hold=True, report=path)
    assert out.where("probability > 1").count() == 0
    got = {r["category"]: r for r in spark.read.parquet(path).collect()}
    assert set(got) == {"a", "b"} and all(r["dim"] == "source" for r in got.values())
    assert got["b"]["before"] == pytest.approx(0.25) and got["b"]["target"] == pytest.approx(0.5)
    assert got["b"]["drawn"] == pytest.approx(0.5, abs=1e-3) and got["a"]["budget"] == pytest.approx(0.5, rel=0.01)


def test_toxicity_ratios_against_counting(spark):
    """Ratios and score of a small table by plain counting, no hashing."""
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(6)) + (" foul" if toxic else " fine")))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    known = [(t, m) for (i, t), (_, m) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(m == c for _, m in known) for c in (0, 1)]

    def grams(text):
        s = f" {text} "
        return {s[i:i + k] for k in toxicity.ORDERS for i in range(len(s) - k + 1)}

    count = {}
    for t, m in known:
        for g in grams(t):
            count.setdefault(g, [0, 0])[m] += 1
    kept = set()
    for g, c in count.items():
        common = sum(c) / sum(n)
        error = math.sqrt(common * (1 - common) * (1 / n[0] + 1 / n[1]))
        if abs(c[1] / n[1] - c[0] / n[0]) >= toxicity.LEAST_Z * max(error, 1e-12):
            kept.add(g)
    # one hash bucket a gram here: the features that count are the same in number
    assert len(model.vocabulary.kept) == len(kept) > 0
    for t, m in known[:50]:
        z = model.intercept + model.weights[model.vocabulary.positions(t)].sum()
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)))
        assert (model.score(t) >= 0.3) == bool(m)
