"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public
vocabulary.  The probability of a word is the sum, over all ways to cut it
into pieces, of the products of the pieces' probabilities (forward algorithm);
a text's log-probability is the sum over its words, and the language with the
largest one is predicted.

Text is lower-cased and cut into runs of letters, each with the vocabulary's
word-start mark; runs longer than ``MAX_RUN`` are scored in parts.  A letter
that is no piece of its own has a small fixed probability, so every word has a
segmentation.

Training: pieces start from their counts as substrings of the training words
and are re-estimated by ``em_rounds`` rounds of expectation-maximisation over
the languages' word counts, spread over the cluster.  The words come from a
sample of about ``docs_per_language`` documents of each language (chosen by a
hash of id and text), a documented bound; the vocabulary bounds the model.

Defined cases: null texts and texts without a letter are ``und`` with score
0; ties go to the language that sorts first; without training rows all texts
are ``und``; extra columns are ignored; rows that repeat an id are scored one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orchard.llm.common import held_out, mix64, text_slices
from orchard.session import cut_lineage

UNDETERMINED = "und"
START = "▁"           # word-start mark of the vocabulary
MAX_RUN = 32               # longest words that are handled together
RARE = 1e-7                # probability of a letter outside the vocabulary
CACHE_WORDS = 100_000      # words whose scores a task keeps
TEXT_BYTES = 1 << 20       # text whose new words are scored together
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_PREFIX_BITS = 20


def vocabulary(path: str) -> list[str]:
    """The usable pieces: letters only, after an optional word-start mark."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p != START and _LETTERS.fullmatch(p.removeprefix(START)))


class PieceTable:
    """Lookup of substrings of many words at once among the pieces."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.max_len = max(map(len, pieces), default=1)
        self.powers = np.array([pow(_BASE, i, 1 << 64) for i in range(self.max_len + 1)], np.uint64)
        keys = np.zeros(self.size, np.uint64)
        for length in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == length]
            keys[at] = self.keys(self.codes([pieces[i] for i in at], length), 0, length)
        self.order = np.append(np.argsort(keys), self.size)
        self.sorted = np.append(np.sort(keys), np.uint64(0))
        prefix = self.sorted[:-1] >> np.uint64(64 - _PREFIX_BITS)
        self.first = np.searchsorted(prefix, np.arange(1 << _PREFIX_BITS)).astype(np.int32)
        self.longest = int(np.bincount(prefix.astype(np.int64), minlength=1).max()) if self.size else 1

    @staticmethod
    def codes(words: list[str], width: int) -> np.ndarray:
        """Code points, one row per word, zero after its end."""
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(words), width), np.uint64)
        out[np.arange(width) < lens[:, None]] = joined
        return out

    def keys(self, codes: np.ndarray, start: int, length: int) -> np.ndarray:
        h = codes[:, start]
        for j in range(1, length):
            h = h * self.powers[1] + codes[:, start + j]
        return self.finish(h, length)

    def finish(self, h: np.ndarray, length: int) -> np.ndarray:
        return mix64(h + self.powers[length])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece number of each key, ``size`` where there is none.  Pieces are
        sorted by key; the upper bits of a key give the first candidate."""
        at = self.first[keys >> np.uint64(64 - _PREFIX_BITS)]
        out = np.where(self.sorted[at] == keys, self.order[at], self.size)
        for step in range(1, self.longest):
            at = np.minimum(at + 1, len(self.sorted) - 1)
            out = np.where(self.sorted[at] == keys, self.order[at], out)
        return out


def runs(words) -> list[str]:
    """Words with the start mark, in parts of at most MAX_RUN characters: for
    the expected counts of training, where a longer word counts as its parts."""
    out = []
    for w in words:
        w = START + w
        out.extend(w[i:i + MAX_RUN] for i in range(0, len(w), MAX_RUN))
    return out


#: Words are handled together up to these lengths, and this many at once.
_LENGTHS, _TOGETHER = (6, 10, 16, MAX_RUN), 10_000


def _groups(words: list[str]):
    """(places of the words, their lengths, padded code points) of words of
    similar length.  Padding is no letter, so no piece crosses a word's end."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for width in _LENGTHS:
        at = np.flatnonzero((lens > low) & (lens <= width))
        for some in np.array_split(at, -(-len(at) // _TOGETHER)) if len(at) else ():
            yield some, lens[some], PieceTable.codes([words[i] for i in some], width)
        low = width


def _lattice(table: PieceTable, codes: np.ndarray):
    """(start, length, piece number per word) of all substrings."""
    width = codes.shape[1]
    for start in range(width):
        h = codes[:, start]
        for m in range(1, min(table.max_len, width - start) + 1):
            if m > 1:
                h = h * table.powers[1] + codes[:, start + m - 1]
            yield start, m, table.find(table.finish(h, m))


def forward(table: PieceTable, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language, all segmentations summed.

    ``probs``: pieces x languages, one more row for what is no piece.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for at, lens, codes in _groups(words):
        alpha = np.zeros((codes.shape[1] + 1, len(at), probs.shape[1]))
        alpha[0] = 1
        for start, m, piece in _lattice(table, codes):
            if m == 1:
                alpha[start + 1] += alpha[start] * np.where((piece == table.size)[:, None], RARE, probs[piece])
            else:
                hit = np.flatnonzero(piece < table.size)
                if len(hit):
                    alpha[start + m, hit] += alpha[start, hit] * probs[piece[hit]]
        out[at] = np.log(alpha[lens, np.arange(len(at))])
    for i, word in enumerate(words):
        if len(word) > MAX_RUN:
            out[i] = _forward_long(table, probs, word)
    return out


def _forward_long(table: PieceTable, probs: np.ndarray, word: str) -> np.ndarray:
    """The same sum for one word of any length: only the forward sums of the
    last ``max_len`` places are kept, scaled to stay within range."""
    codes, n, longest = PieceTable.codes([word], len(word))[0], len(word), table.max_len
    piece, h = np.full((longest, n), table.size), codes
    for m in range(1, min(longest, n) + 1):
        if m > 1:
            h = h[:-1] * table.powers[1] + codes[m - 1:]
        piece[m - 1, :n - m + 1] = table.find(table.finish(h, m))
    recent, scale = np.zeros((longest, probs.shape[1])), np.zeros(probs.shape[1])
    recent[0] = 1
    for end in range(1, n + 1):
        m = np.arange(1, min(longest, end) + 1)
        found = piece[m - 1, end - m]
        weight = probs[found]
        if found[0] == table.size:
            weight[0] = RARE
        total = (recent[:len(m)] * weight).sum(0)
        recent = np.vstack([total, recent[:-1]])
        if end % 8 == 0:
            top = recent.max(0)
            recent, scale = recent / top, scale + np.log(top)
    return np.log(recent[0]) + scale


def expected_counts(table: PieceTable, probs: np.ndarray, words: list[str], language: np.ndarray,
                    counts: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words seen ``counts``
    times in the language of their row: forward and backward sums."""
    n_lang = probs.shape[1]
    total = np.zeros((table.size + 1) * n_lang)
    for at, lens, codes in _groups(words):
        lang, width, every = language[at], codes.shape[1], np.arange(len(at))
        edges = []
        for start, m, piece in _lattice(table, codes):
            hit = np.flatnonzero(piece < table.size) if m > 1 else every
            if len(hit):
                own = probs[piece[hit], lang[hit]]
                own = np.where(piece[hit] == table.size, RARE, own) if m == 1 else own
                edges.append((start, m, hit, piece[hit], own))
        alpha, beta = np.zeros((width + 1, len(at))), np.zeros((width + 1, len(at)))
        alpha[0] = beta[lens, every] = 1
        for start, m, hit, _, own in edges:
            alpha[start + m, hit] += alpha[start, hit] * own
        for start, m, hit, _, own in reversed(edges):
            beta[start, hit] += own * beta[start + m, hit]
        weight = counts[at] / alpha[lens, every]
        for start, m, hit, piece, own in edges:
            total += np.bincount(piece * n_lang + lang[hit],
                                 weight[hit] * alpha[start, hit] * own * beta[start + m, hit], len(total))
    return total.reshape(-1, n_lang)


class LanguageModel:
    """Languages and their piece probabilities (bounded by the vocabulary)."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs


def train(docs: DataFrame, vocabulary_path: str, docs_per_language: int = 500,
          em_rounds: int = 1) -> LanguageModel:
    """A model of the languages in ``lang`` of the rows that are not held out."""
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = {r["lang"]: min(1.0, docs_per_language / r["n"]) for r in sizes}
    rates = spark.createDataFrame([(k, languages.index(k), v) for k, v in share.items()],
                                  "lang string, language int, rate double")
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(rates), "lang").where(lot < F.col("rate")).select("language", "text")

    def count_words(batches):
        from collections import Counter
        for batch in batches:
            seen: dict[int, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            if flat:
                lang, word, n = zip(*flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                    names=["language", "word", "n"])

    words = cut_lineage(sample.mapInArrow(count_words, "language int, word string, n long").groupBy(
        "language", "word").agg(F.sum("n").alias("n")).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "word"))
    probs = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    probs[-1] = 0
    for _ in range(em_rounds + 1):
        probs = _re_estimate(words, pieces, probs)
    return LanguageModel(languages, pieces, probs)


def _re_estimate(words: DataFrame, pieces: list[str], probs: np.ndarray) -> np.ndarray:
    """One round: expected counts on the cluster, normalised here with a small
    prior (the sums are pieces x languages, bounded by the vocabulary)."""
    n_lang = probs.shape[1]

    def part(batches):
        table = PieceTable(pieces)
        total = np.zeros((table.size + 1, n_lang))
        for batch in batches:
            parts = [(r, i, c) for i, w, c in zip(*[x.to_pylist() for x in batch.columns]) for r in runs([w])]
            if parts:
                words, lang, n = zip(*parts)
                total += expected_counts(table, probs, list(words), np.array(lang), np.array(n, float))
        piece, language = np.nonzero(total[:table.size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(total[piece, language])],
            names=["piece", "language", "n"])

    sums = words.mapInArrow(part, "piece int, language int, n double").groupBy("piece", "language").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(pieces) + 1, n_lang))
    counts[sums["piece"], sums["language"]] = sums["n"]
    counts[:-1] += 0.01
    return np.vstack([counts[:-1] / counts[:-1].sum(0), np.zeros(n_lang)])


def _predictor(model: LanguageModel, text_column: int, names: tuple[str, str]):
    """Arrow batches to the same batches with the prediction and its score."""
    languages, pieces, probs = model.languages, model.pieces, model.probs

    def part(batches):
        table = PieceTable(pieces)
        known: dict[str, int] = {}
        scores = np.zeros((1 << 16, len(languages)))

        def learn(new: list[str]) -> None:
            nonlocal scores
            sums = forward(table, probs, [START + w for w in new])
            first = len(known)
            while len(scores) < first + len(new):
                scores = np.concatenate([scores, np.zeros_like(scores)])
            scores[first:first + len(new)] = sums
            known.update(zip(new, range(first, first + len(new))))

        def judge(texts: list[str]):
            """(language, score) of some whole texts; their new words are
            scored together."""
            found = [_LETTERS.findall(t.lower()) for t in texts]
            if not languages:
                return [(UNDETERMINED, 0.0)] * len(texts)
            if len(known) > CACHE_WORDS:
                known.clear()
            new = {w for words in found for w in words if w not in known}
            if new:
                learn(sorted(new))
            out = []
            for words in found:
                if not words:
                    out.append((UNDETERMINED, 0.0))
                    continue
                total = scores[[known[w] for w in words]].sum(0)
                i = int(np.argmax(total))
                # tempered: at most 20 words' worth of evidence
                z = np.exp((total - total[i]) * min(1.0, 20 / len(words)))
                out.append((languages[i], float(1 / z.sum())))
            return out

        for batch in batches:
            column = batch.column(text_column)
            out = []
            for first, end, _, _ in text_slices(column, TEXT_BYTES):
                out += judge([t or "" for t in column.slice(first, end - first).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in out], pa.string()),
                 pa.array([x for _, x in out], pa.float64())],
                names=[*batch.schema.names, *names])

    return part


def with_prediction(docs: DataFrame, model: LanguageModel, lang_pred: str = "lang_pred",
                    score: str = "score") -> DataFrame:
    """``docs`` plus the columns ``lang_pred`` and ``score`` (names that it must
    not have yet): the prediction and its posterior, tempered so that long
    texts do not all score 1."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_predictor(model, docs.columns.index("text"), (lang_pred, score)), schema)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return with_prediction(rows, model).select("doc_id", "held_out", "lang_pred", "score")
