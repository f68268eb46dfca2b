"""Secret scans: a trigram inverted index in front of regular expressions.

From each rule's regular expression a Boolean trigram query is derived: an AND
of clauses, a clause an OR over the alternatives of one literal run, an
alternative the AND of its trigrams.  Texts are indexed in shards (a batch of
whole texts inside a task): a posting list per trigram that some query asks
for, lower-cased.  A rule's candidates are the intersections and unions of its
postings; only they meet the regular expression.  A rule without a mandatory
trigram (such as a long run of hex digits) scans every text.  Shards never
leave their task, so nothing is shuffled and memory is bounded by the shard.

Spans are code-point offsets of whole matches, end exclusive, ordered by start
and then by the rules' order.

Defined cases: null texts are empty; texts without a match have empty spans;
rows that repeat an id are scanned one by one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.llm.common import text_slices

#: Most alternatives a literal run may have.
MAX_ALTERNATIVES = 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0        # the group whose length counts
    least: int = 0        # characters that group needs


# The base kinds and what they match.
BASE_RULES = [
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Further kinds: private key blocks, web tokens, and well-known token prefixes.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]


def _alternatives(items) -> set[str] | None:
    """The strings a parsed part can match, lower-cased; None: too many."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            some = {chr(arg).lower()}
        elif op is C.IN:
            some = {chr(a).lower() for o, a in arg if o is C.LITERAL}
            if any(o is not C.LITERAL for o, _ in arg):
                return None
        elif op is C.SUBPATTERN:
            some = _alternatives(arg[-1])
        elif op is C.BRANCH:
            parts = [_alternatives(x) for x in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[1] != C.MAXREPEAT and arg[1] <= 2:
            one = _alternatives(arg[2])
            # every repeat is a choice of its own
            some = None if one is None or len(one) ** arg[1] > MAX_ALTERNATIVES else {
                "".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
        else:
            return None
        if some is None:
            return None
        out = {a + b for a in out for b in some}
        if len(out) > MAX_ALTERNATIVES:
            return None
    return out


#: Rules that ignore case beyond ASCII, and the letters that have a partner
#: there (dotless i, Kelvin sign, long s): strings with these are not mandatory.
_FOLDS = re.compile(r"\(\?(?![a-zA-Z]*a)[a-zA-Z]*i")
_FOLDED = set("iks")


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of clauses; a clause: alternatives, each the trigrams it needs.  An
    empty query matches every text."""
    runs, run = [], []
    for item in _parser.parse(pattern):
        if _alternatives([item]) is None:
            runs, run = [*runs, run], []
        elif _alternatives([*run, item]) is None:
            runs, run = [*runs, run], [item]
        else:
            run.append(item)
    query = []
    for items in [*runs, run]:
        strings = _alternatives(items) or {""}
        if _FOLDS.search(pattern) and _FOLDED & set("".join(strings).lower()):
            continue
        if all(len(s) >= 3 and s.isascii() for s in strings):
            query.append([sorted({s[i:i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)])
    return query


class ShardIndex:
    """Posting lists of the wanted trigrams over the texts of one shard."""

    def __init__(self, wanted: list[str]):
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] = np.arange(97, 123)

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n = len(offsets) - 1
        self.postings = [np.zeros(0, np.int64)] * len(self.number)
        if len(data) < 3:
            return
        low = self.fold[data]
        found = self.table[low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]]
        at = np.flatnonzero(found >= 0)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * self.n + text[inside])
        cuts = np.searchsorted(pairs, np.arange(len(self.number) + 1) * self.n)
        self.postings = [pairs[a:b] - i * self.n for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]

    def candidates(self, query) -> np.ndarray:
        """Texts that may match; all of them for an empty query."""
        out = None
        for clause in query:
            any_of = np.zeros(0, np.int64)
            for trigrams in clause:
                lists = sorted((self.postings[self.number[t]] for t in trigrams), key=len)
                hit = lists[0]
                for more in lists[1:]:
                    hit = np.intersect1d(hit, more, assume_unique=True)
                any_of = np.union1d(any_of, hit)
            out = any_of if out is None else np.intersect1d(out, any_of, assume_unique=True)
        return np.arange(self.n) if out is None else out


def scan(docs: DataFrame, rules: list[Rule] | None = None, base: int = 3) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans of every text.

    ``rules``: the first ``base`` of them are the base kinds.
    """
    rules = rules if rules is not None else [*BASE_RULES, *MORE_RULES]
    kinds = [r.kind for r in rules[:base]]

    def part(batches):
        compiled = [re.compile(r.pattern) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        index = ShardIndex(sorted({t for q in queries for c in q for a in c for t in a}))
        for batch in batches:
            counts = np.zeros((base, batch.num_rows), np.int64)
            digests, spans = [], []
            texts = batch.column(1)
            for first, end, data, offsets in text_slices(texts):
                index.build(data, offsets)
                found = [[] for _ in range(end - first)]
                decoded = texts.slice(first, end - first).to_pylist()
                for number, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
                    for i in index.candidates(query).tolist():
                        for m in pattern.finditer(decoded[i] or ""):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), number, m.end()))
                                if number < base:
                                    counts[number, first + i] += 1
                for one in found:
                    one.sort()
                    named = [(n, f"{rules[n].kind}:{a}:{b}") for a, n, b in one]
                    spans.append(",".join(x for _, x in named))
                    own = ",".join(x for n, x in named if n < base)
                    digests.append(hashlib.sha256(own.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in counts],
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        part, "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string")
