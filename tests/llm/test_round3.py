"""Exact top-k, filter audit and Merkle manifest on small fixtures."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from orchard.llm import audit, manifest, topk

VEC = "vec_id long, embedding array<double>, score string"


def _brute_topk(rows, every=50, k=5):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    queries = {}
    for i, v in kept:
        if i % every == 0:
            b = np.array(v, np.int32).tobytes()
            queries[i] = min(queries.get(i, b), b)
    out = []
    for i, b in queries.items():
        q = np.frombuffer(b, np.int32).tolist()
        best = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in kept if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_topk_nulls_ties_repeats_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(300)]
    rows += [(i, rows[7][1], "copy") for i in range(300, 420)]          # one vector for many rows
    rows += [(50, rng.normal(size=6).tolist(), "again"), (450, None, None), (451, [1.0, None], None),
             (452, [float("nan")], None), (453, [float("inf")], None), (None, [1.0], None),
             (500, [], "empty"), (454, [0.5, 0.25], "short"), (550, [9.0] * 6, None), (550, [9.0] * 6, None)]
    df = spark.createDataFrame(rows, VEC)
    want = sorted(_brute_topk(rows), key=repr)
    assert _rows(topk.top_k(df)) == want
    # many annuli, chunks and query buckets give the same rows
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    index = topk.PivotIndex(vectors, pivots=5, sample=40, annulus_rows=16)
    assert len(index.annuli) > 5 and max(index.annuli.chunks) > 1
    assert _rows(topk.search(index, vectors.where("id % 50 = 0"), query_rows=2)) == want


def test_topk_stops_early_on_separated_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.eye(4)[i % 4] * 20 + rng.normal(size=4) * 0.1).tolist(), "") for i in range(400)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, VEC), "vec_id", "embedding")
    index = topk.PivotIndex(vectors, pivots=4, annulus_rows=8)
    q = np.floor(256 * np.array([rows[0][1]]))
    found = _rows(topk.search(index, vectors.where("id % 50 = 0")))
    assert found == sorted(_brute_topk(rows), key=repr)
    least = min(s for i, _, _, s in found if i == 0)
    # the triangle inequality leaves out every annulus of the other groups
    assert (index.annuli.bounds(q) < least).sum() >= len(index.annuli) // 2


def test_topk_large_values_and_empty(spark):
    big = [(0, [8e6, -8e6], ""), (1, [8e6 - 1, 3.0], ""), (2, [-8e6, 8e6], "")]
    assert _rows(topk.top_k(spark.createDataFrame(big, VEC))) == _brute_topk(big)
    with pytest.raises(Exception, match="32 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9], "")], VEC)).collect()
    for rows in ([], [(50, None, "")], [(1, [1.0], "")], [(50, [1.0], "")]):
        out = topk.top_k(spark.createDataFrame(rows, VEC))
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.collect() == []


DOC = "doc_id long, text string, lang string, source string, n_chars long, mask string, hash string"


def _documents():
    long = "word%d " * 250 % tuple(range(250))
    rows = [(i, f"{long}{i % 9}", "en", f"s{i % 3}", 5, "extra", None) for i in range(60)]
    rows += [(100 + i, "copy of Ä one text", "en", "hot", 5, None, None) for i in range(80)]
    rows += [(7, "copy of Ä one text", "en", "s0", 5, None, None),      # smaller, in a later file
             (3, "copy of Ä one text", None, None, None, None, None),
             (3, "copy of Ä one text", None, "", None, None, None),
             (3, "copy of Ä one text", None, None, None, None, None),
             (None, "copy of Ä one text", "en", "s0", 1, None, None), (None, None, None, None, None, None, None),
             (None, "x", "en", "s0", 1, None, None), (200, None, "en", "s1", 0, None, None), (201, "", "en", "s1", 0, None, None),
             (202, "AB " * 30000, "en", "s1", 0, None, None), (203, "a|b\x0b" + long, "en", "s1", 0, None, None),
             (-5, "Negative Id", "en", "s2", 0, None, None), (1 << 60, "huge id", "en", "s2", 0, None, None)]
    return rows


LABELS = [(3, 1, 1), (3, 0, None), (7, 1, 0), (100, 0, 1), (101, 1, None), (None, 1, 1), (999, 1, 1)]


def _brute_audit(rows, labels):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    cells = defaultdict(int)
    for r in rows:
        text = r[1] or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text),
            r[0] is not None and r[0] > least[text])) if x}
        good = any(i == r[0] and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == r[0] and t == 1 for i, _, t in labels if i is not None)
        cells[r[3] or "", frozenset(fails), good, toxic] += 1
    out, shapley, orders = [], defaultdict(int), list(itertools.permutations("ABCDE"))
    parts = {p for p, *_ in cells}
    for order in orders:
        for p in parts:
            for s, f in enumerate(order):
                n = defaultdict(int)
                for (part, fails, good, toxic), c in cells.items():
                    if part != p:
                        continue
                    gone = bool(fails & set(order[:s]))
                    n["kept"] += c * (not gone and f not in fails)
                    n["redundant"] += c * (gone and f in fails)
                    n["unique"] += c * (fails == {f})
                    if f in fails and not gone:
                        n["removed"] += c
                        n["good"] += c * good
                        n["toxic"] += c * toxic
                        shapley[p, f] += c
                out.append([p, "".join(order), s + 1, n["kept"], n["removed"], n["redundant"], n["unique"], n["good"],
                            n["toxic"], f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("files", [1, 2, 50])
def test_audit_in_any_number_of_batches(spark, tmp_path, files):
    rows, path = _documents(), str(tmp_path / "documents.parquet")
    # several files, so that smaller ids come in later micro-batches
    for part in (rows[60:140], rows[140:143], rows[:60], rows[143:]):
        spark.createDataFrame(part, DOC).coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = audit.audit(audit.counters(spark, path, labels, files_per_batch=files))
    assert sorted(map(tuple, out.collect())) == _brute_audit(rows, LABELS)


def test_audit_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOC).write.parquet(path)
    out = audit.audit(audit.counters(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert out.collect() == [] and out.columns[:3] == ["part", "filter_order", "step"]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _brute_manifest(rows):
    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return _h(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            first = i // 16 * 16
            yield "".join(nodes[first:i]), "".join(nodes[i + 1:first + 16])
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((leaf(r, r[1]), r))
    parts = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        g = sorted(groups[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        parts.append((g, tree([x[0] for x in g])))
    top, out = tree([t[-1][0] for _, t in parts]), []
    for k, (g, t) in enumerate(parts):
        for i, (own, r) in enumerate(g):
            way = [*path(t, i), *path(top, k)]
            fold = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                fold = leaf(r, r[1] and r[1].translate(lower))
            for before, after in way:
                fold = _h(before, fold, after)
            out.append((r[0], own, t[-1][0], top[-1][0], _h(*(b + a for b, a in way)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_nulls_repeats_hot_source(spark):
    rows = _documents() + [(i, f"Text {i}", "en", "hot", 1, None, None) for i in range(1000, 1300)]
    rows += [(5000, "Same Row", "en", "hot", 1, None, None)] * 40 + [(5000, "Other", "en", "hot", 1, None, None)]
    rows += [(None, f"no id {i}", "en", "hot", 1, None, None) for i in range(50)]
    got = _rows(manifest.manifest(spark.createDataFrame(rows, DOC)))
    assert got == _brute_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_manifest_of_small_tables(spark, n):
    for source in (lambda i: "one", lambda i: f"s{i}"):
        rows = [(i * 100_000, "A", None, source(i), i, None, None) for i in range(n)]
        assert _rows(manifest.manifest(spark.createDataFrame(rows, DOC))) == _brute_manifest(rows)


def test_equal_rows_are_unfolded_in_pieces(spark):
    from pyspark.sql import functions as F
    one = spark.createDataFrame([("=a", 5, 1, "x", None, manifest.COPIES * 2 + 3), ("=a", 3, 2, "y", None, 1)],
                                "src string, pos long, doc_id long, leaf string, changed string, n long")
    out = manifest._expanded(one)
    assert out.count() == manifest.COPIES * 2 + 4
    assert out.where("leaf = 'x'").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (
        5, 5 + manifest.COPIES * 2 + 2, manifest.COPIES * 2 + 3)
