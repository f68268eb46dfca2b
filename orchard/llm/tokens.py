"""Token-id files: Parquet list columns of public-vocabulary token ids.

One row per document in ascending id order, over all files in name order:

    doc_id BIGINT, part INT, local_start BIGINT, n_tokens BIGINT, ids ARRAY<INT>

``part`` numbers the file and ``local_start`` counts the ids before the
document inside it, so a document's global start needs only the files' totals,
one row per file.  Metadata columns use delta encoding (Parquet v2 pages), ids
a dictionary per row group (49 thousand values fit the dictionary page);
row-group and page sizes are parameters, and the writer adds page indexes, so
a reader of some documents or of the metadata alone skips all other pages.

Defined cases: a null or empty text holds the end id alone; null ids sort
first; rows that repeat an id keep all their copies, ordered by a
hash of the text; extra columns are ignored; an empty table writes no rows and reads back empty.
"""

from __future__ import annotations

import re
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orchard.llm.common import text_slices

#: Distinct pieces whose ids a Python worker keeps in each of two generations,
#: pieces encoded in a call, and bytes of text split at once.
CACHE_PIECES, TOGETHER, AT_ONCE = 150_000, 512, 1 << 20
#: Characters whose words can be encoded one by one: printable ASCII, plain white
#: space, Latin-1 and Latin Extended-A letters (but for the one whose lower case
#: is two characters) and common punctuation.  None of them composes with a
#: neighbour, and their lower case does not depend on one.
_OTHER = "[^\t\n\x0b\x0c\r -~\u00c0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u203a]"
#: The tokenizer's pieces of such a text (fixed by the vocabulary file): runs of
#: letters, single digits, 's 't 're 've 'm 'll 'd, runs of other marks.  Kinds of
#: bytes: the two-byte letters have lead bytes of C3 to C5, and of their block only
#: the signs of multiplication and division are marks, like all of three bytes.
_SPACE = re.compile(b"[\t\n\x0b\x0c\r ]")
_WHITE, _LETTER, _MARK, _SINGLE = range(4)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[list(b"\t\n\x0b\x0c\r ")] = _WHITE
_KINDS[[*range(0x61, 0x7b), *range(0x80, 0xc0), 0xc3, 0xc4, 0xc5]] = _LETTER
#: Bytes that no such text holds: its end, and the place of a text encoded as a whole.
_END, _WHOLE = b"\x00", b"\x01"
_KINDS[[*range(0x30, 0x3a), *_END, *_WHOLE]] = _SINGLE


class CachedEncoder:
    """The tokenizer's ids of whole texts, through a bounded cache of pieces.

    The tokenizer splits a text into pieces (a run of letters, a digit, a run of
    other marks, never white space), and pieces do not see each other; so the
    ids of a text are those of its pieces one after another.  That holds for
    texts of the characters above; any other text, and one that holds the string
    of a special token, is encoded as a whole.

    Texts are split many at a time, as one array of bytes whose pieces become an
    Arrow dictionary: a piece is looked up once for all its places in the array.

    Pieces are kept in two generations: when the current one is full, it becomes
    the older one, from which pieces that are met again return.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for runs of lower-case letters, which the normalizer leaves
        # as they are; the byte encoding of those beyond ASCII is a table
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_bytes = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xdf, 0x180)}
        vocab = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.marks = {_END: np.array([end_id], "<i4").tobytes(), _WHOLE: b""}
        self.pieces: dict[bytes, bytes] = dict(self.marks)
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        if plain:
            texts = [t if t.isascii() else t.translate(self.by_bytes) for t in texts]
        tokenizer = self.plain if plain else self.tokenizer
        return [np.array(x.ids, "<i4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        """Put the ids of the pieces ``new`` into the current generation."""
        known = list(filter(self.older.__contains__, new))
        self.pieces.update(zip(known, map(self.older.__getitem__, known)))
        texts = sorted(map(bytes.decode, new.difference(known)), key=str.isascii)
        # a run of letters is one piece, closed by a word-end token: many in a text
        letters = list(filter(str.isalpha, texts))
        rest = list(filterfalse(str.isalpha, texts))
        some = [letters[i:i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for pieces, ids in zip(some, self._encode([" ".join(x) for x in some], plain=True)):
            cuts = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(cuts) == len(pieces):
                raw = ids.tobytes()
                self.pieces.update(zip(map(str.encode, pieces), map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
            else:
                rest += pieces
        self.pieces.update(zip(map(str.encode, rest), (x.tobytes() for x in self._encode(rest))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, the end id after each, and
        the number of ids of each text."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, _OTHER)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        apart = self._encode(texts.filter(whole).to_pylist()) if pc.any(whole).as_py() else []
        plain = pc.utf8_lower(pc.if_else(whole, pa.scalar(_WHOLE.decode(), texts.type), texts) if apart else texts)
        ended = pc.binary_join_element_wise(plain, pa.scalar("", texts.type), pa.scalar(_END.decode(), texts.type))
        parts, ends, before = [np.zeros(0, "<i4")], [np.zeros(0, np.int64)], 0
        for _, _, data, _ in text_slices(ended, 2 * AT_ONCE):
            for part in _cut(data, 2 * AT_ONCE):
                ids, end = self._join(part, apart)
                parts.append(ids)
                ends.append(before + end)
                before += len(ids)
        return np.concatenate(parts), np.diff(np.concatenate(ends), prepend=0)

    def _join(self, data: np.ndarray, apart: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the text in ``data`` and where in them texts end; the
        texts that are encoded as a whole are taken from the front of ``apart``."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces, self.older = dict(self.marks), self.pieces
        places = _split(data).dictionary_encode()
        index = places.indices.to_numpy()
        pieces = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(filterfalse(self.pieces.__contains__, pieces))
        if new:
            self._learn(new)
        found = list(map(self.pieces.__getitem__, pieces))
        if _WHOLE in pieces:
            at = np.flatnonzero(index == pieces.index(_WHOLE))
            index = index.copy()
            index[at] = len(found) + np.arange(len(at))
            found += [x.tobytes() for x in apart[:len(at)]]
            del apart[:len(at)]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        of_piece = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
        ids = of_piece.take(pa.array(index)).flatten().to_numpy()
        ends = np.flatnonzero(index == (pieces.index(_END) if _END in pieces else -1))
        return ids, np.cumsum(n[index])[ends]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        ids, n = self.ids(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n))[:-1]]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def _cut(data: np.ndarray, size: int):
    """The bytes in parts of about ``size``, cut at white space (which is in no
    piece); a longer run without it stays whole."""
    start = 0
    while len(data) - start > size:
        space = _SPACE.search(data, start + size)
        if not space:
            break
        yield data[start:space.start()]
        start = space.end()
    if start < len(data):
        yield data[start:]


def _split(data: np.ndarray) -> pa.Array:
    """The tokenizer's pieces of lower-cased text, in order."""
    kind = _KINDS[data]
    at = np.flatnonzero(data == 0xe2)
    kind[at] = kind[at + 1] = kind[at + 2] = _MARK
    at = np.flatnonzero(data == 0xc3)
    at = at[(data[at + 1] == 0x97) | (data[at + 1] == 0xb7)]
    kind[at] = kind[at + 1] = _MARK
    first = kind == _SINGLE
    first[:1] = True
    first[1:] |= kind[1:] != kind[:-1]
    # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll along
    at = np.flatnonzero(data[:-1] == 0x27)
    at = at[first[at]]
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6c) & (two == 0x6c)
    long &= at + 2 < len(data)
    for some, length in ((at[np.isin(one, list(b"stmd"))], 2), (at[long], 3)):
        first[some + 1] = False
        first[(some + length)[some + length < len(data)]] = True
    kept = kind != _WHITE
    starts = np.flatnonzero(first[kept])
    data = data[kept]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(
        np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])


def _worker_encoder(path: str, end_id: int) -> CachedEncoder:
    """The encoder of this Python worker, which serves several tasks: the
    vocabulary is read once.  Functions travel by value, so their globals do not
    outlive a task; the imported package does."""
    import tokenizers
    known = tokenizers.__dict__.setdefault("_worker_encoders", {})
    if (path, end_id) not in known:
        known.clear()
        known[path, end_id] = CachedEncoder(path, end_id)
    return known[path, end_id]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Documents in ascending id order with their token ids and file offsets."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sort(
        "doc_id", F.xxhash64("text"))

    def part(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        encoder = _worker_encoder(tokenizer_path, end_id)
        start = 0
        for batch in batches:
            for first, last, _, _ in text_slices(batch.column(1), AT_ONCE):
                some = batch.slice(first, last - first)
                ids, n = encoder.ids(some.column(1))
                ends = np.cumsum(n)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), number, np.int32)),
                     pa.array(start + ends - n), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return ordered.mapInArrow(
        part, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the token files of ``docs`` to ``path`` (one file per sorted range)."""
    (encoded(docs, tokenizer_path, end_id).write
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes)
     .option("parquet.writer.version", "v2")
     .option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true")
     .option("compression", "zstd")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: ids of all documents before each one.

    Only the metadata columns are read for the file totals, one row per file.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # running total over one row per file
    running = totals.select("part", F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return rows.join(F.broadcast(running), "part").withColumn(
        "start", F.coalesce("before", F.lit(0)) + F.col("local_start")).drop("before")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids read from the files."""

    def part(batches):
        for batch in batches:
            ids = batch.column(3)
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        part, "doc_id long, start long, n_tokens long, ids_crc32 long")
