"""Document operators against brute force on small tables with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from orchard.llm import (chat, decontaminate, fingerprint, language, mixing, neardup, secret_scan, tokens,
                         toxicity, urls)
from orchard.llm.queries import END_ID, MIX_DIMS, MIX_POWERS, PIECES, TOKENIZER, URL_RULES

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n long, value string, text_hash string, component string, words string, at string, score string")


def sentence(rng, n, vocab=300):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edge_texts():
    rng = random.Random(3)
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    long = sentence(rng, 30_000)
    return [None, "", "   \n\t", "one", "Two WORDS", "three short words", "ÉCOLE Été straße 東京 \U0001f600 x",
            base, base.upper(), " ".join(near), base + " tail", long, long + " more", "the " * 200,
            "a\x1cb c\x85d e\xa0f", "it's don't I'll 42nd -- (x).,", *[sentence(rng, 60) for _ in range(6)]]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, None, None, None if t is None else len(t), 1, "v", "h", "c", "w", "a", "s") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    texts = edge_texts()
    rows = list(enumerate(texts))
    rows += [rows[7], (None, texts[8]), (None, None), (100, texts[9]), (100, texts[20])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- tokens

def test_token_files_round_trip(spark, docs, edge_rows, tmp_path):
    from tokenizers import Tokenizer
    path = str(tmp_path / "t")
    tokens.write_token_files(docs, path, public_tokenizers.path(TOKENIZER), END_ID)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = sorted(((i is not None, i or 0, tuple(t.encode(x or "", add_special_tokens=False).ids) + (END_ID,))
                   for i, x in edge_rows))
    assert [r["doc_id"] for r in got] == [None if not a else b for a, b, _ in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in
               tokens.token_digests(tokens.read_tokens(spark, path)).collect()}
    for r in got:
        assert digests[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_token_file_layout(spark, tmp_path):
    rng = random.Random(1)
    df = frame(spark, [(i, sentence(rng, 400)) for i in range(300)]).coalesce(1)
    path = tmp_path / "t"
    tokens.write_token_files(df, str(path), public_tokenizers.path(TOKENIZER), END_ID, row_group_bytes=1 << 16)
    files = sorted(path.glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.num_row_groups > 1
    by_path = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in by_path["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in by_path["n_tokens"].encodings
    assert by_path["doc_id"].has_offset_index and by_path["doc_id"].has_column_index


def test_token_files_empty(spark, empty, tmp_path):
    tokens.write_token_files(empty, str(tmp_path / "t"), public_tokenizers.path(TOKENIZER), END_ID)
    assert tokens.token_digests(tokens.read_tokens(spark, str(tmp_path / "t"))).count() == 0


# -------------------------------------------------------------- toxicity

def test_toxicity_features_of_long_texts_stay_apart():
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4_000))
    s = f" {text} "
    grams = {s[i:i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)}
    assert len(grams) > 60_000
    assert 0.98 * len(grams) < len(toxicity.features(text)) <= len(grams)
    model = toxicity.ToxicityModel(toxicity.Vocabulary(np.array([3, 9])), np.array([1.0, 2.0]), 0.0)
    model.score(text)
    assert len(pickle.dumps(model)) < 10_000


def test_toxicity_held_out_accuracy_and_edges(spark, docs, empty):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        bad = rng.random() < 0.25
        words = sentence(rng, 60).split()
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron", "vermin"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, *marks[:5], (None, 1), (7_000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels, fit_rows=200)
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows), model).collect()}
    truth = dict(marks)
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in unseen) for i in truth)
    right = sum((got[i]["predicted"] == 1) == (truth[i] == 1) for i in unseen)
    assert right / len(unseen) > 0.97
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty, labels)
    assert toxicity.score(docs, nothing).where("score <> 0.5").count() == 0


# ---------------------------------------------------------- fingerprints

def brute_codes(text, k, width):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text.lower())
    grams = [words[i:i + k] for i in range(max(1, len(words) - k + 1))] if words else []
    codes = []
    for i, gram in enumerate(grams):
        h = 42
        for w in gram:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        h = h - (1 << 64) if h >= 1 << 63 else h
        codes.append((h >> 26, -i))
    minima = [min(codes[i:i + width]) for i in range(len(codes))]
    return list(dict.fromkeys((h, -i) for h, i in minima))


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_match_brute_force(spark, edge_rows):
    rows = [(i, t) for i, t in edge_rows if i is not None and i < 100][:-1] + [(500 + i, "x" * i) for i in range(6)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints_with_edits(frame(spark, rows), 5, 16).collect()}
    rows = sorted(rows)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        text, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, b, c = (brute_codes(x, 5, 16) for x in (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        as_text = ",".join(f"{p}:{h & (1 << 64) - 1:X}" for h, p in a)
        assert r["fingerprint"] == as_text
        assert r["near_edited"] == pytest.approx(jaccard(a, b))
        assert r["near_next"] == pytest.approx(jaccard(a, c))


def test_next_documents_over_ranges(spark, empty, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    ids = random.Random(2).sample(range(10_000), 200)
    df = frame(spark, [(i, f"t{i}") for i in ids]).repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.next_documents(df.select("doc_id", "text"), ["text"]).collect()}
    ids.sort()
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert fingerprint.fingerprints_with_edits(empty).count() == 0
    one = fingerprint.fingerprints_with_edits(frame(spark, [(1, "a b c d e f g")])).first()
    assert one["near_next"] == 1.0


def test_repeated_rows_and_null_ids_keep_their_rows(spark, docs):
    assert fingerprint.fingerprints_with_edits(docs).count() == docs.count()


# ------------------------------------------------------- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, t in items:
        own = WORD.findall(lower(t))
        size = min(10, len(own))
        windows = {tuple(own[s:s + size]) for s in range(len(own) - size + 1)} if own else set()
        for s in range(len(words) - size + 1) if own else ():
            if tuple(words[s:s + size]) in windows:
                hit.update(range(s, s + size))
                found.add(item_id)
    found.discard(None)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_decontamination_matches_brute_force(spark, edge_rows, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "broadcast_if_small",
                        lambda df, b: F.broadcast(df) if limit else df)
    texts = [t for _, t in edge_rows]
    items = [(1, " ".join(texts[7].split()[10:35])), (2, "Three, SHORT... words!"), (3, None), (4, "-- ..."),
             (5, "one"), (22, " ".join(texts[16].split()[:9])), (None, texts[17]), (1, "东京"), (9, "the " * 15),
             (10, " ".join(texts[11].split()[100:111]))]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    rows = [*edge_rows, (300, texts[7].replace(" ", "; ") + " one"), (301, "x " * 5 + items[5][1] + " " + items[0][1])]
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=key) \
        == sorted(want, key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_decontamination_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, some).count() == 0


# ---------------------------------------------------------------- mixing

def target_shares(rows, dims, powers):
    """(dim, category) -> target share of tokens, of dicts with n_tokens."""
    out = {}
    for d in dims:
        mass = {}
        for r in rows:
            mass[r[d]] = mass.get(r[d], 0) + r["n_tokens"]
        mass = {k: v ** powers[d] for k, v in mass.items()}
        out.update({(d, k): v / sum(mass.values()) for k, v in mass.items()})
    return out


def shares_of(rows, dims, weight):
    total = sum(weight(r) for r in rows)
    out = {}
    for d in dims:
        for r in rows:
            out[d, r[d]] = out.get((d, r[d]), 0) + weight(r) / total
    return out


def test_pipeline_draws_the_target_shares(spark):
    import corpus_pipeline
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        lang = rng.choice(["en"] * 8 + ["de", "es"])
        text = "w " * rng.randrange(20, 60) + rng.choice([""] * 19 + ["a@b"])
        rows.append((i, text, lang, rng.choice("abc" if lang == "en" else "ab"), len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weighed = docs.withColumns({"topic": mixing.topic_of(F.col("text")), "n_tokens": mixing.token_count(F.col("text"))})
    drawn = corpus_pipeline.mixing_to_targets(spark, docs, "").select("doc_id")
    rows = weighed.select("doc_id", "source", "lang", "topic", "n_tokens").collect()
    kept = {r["doc_id"] for r in drawn.collect()}
    want = target_shares(rows, MIX_DIMS, MIX_POWERS)
    got = shares_of([r for r in rows if r["doc_id"] in kept], MIX_DIMS, lambda r: r["n_tokens"])
    assert got == pytest.approx(want, abs=0.025)


def test_bounded_raking_holds_at_the_largest_budget(spark, caplog):
    dims, powers = ["source", "lang"], {"source": 0.5, "lang": 0.0}
    rng = random.Random(9)
    rows = [(i, rng.choice("aaab"), rng.choice(["x"] * 5 + ["y", None]), rng.randrange(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    out = mixing.mix(df, dims, powers, 1.0, hold=True).collect()
    want = target_shares(out, dims, powers)
    assert shares_of(out, dims, lambda r: r["n_tokens"] * r["probability"]) == pytest.approx(want, abs=3e-4)
    # the draw is as large as it can be: the rarest language is taken whole
    before = shares_of(out, dims, lambda r: r["n_tokens"])
    total = sum(r["n_tokens"] for r in out)
    drawn = sum(r["n_tokens"] * r["probability"] for r in out) / total
    assert drawn == pytest.approx(min(before[k] / want[k] for k in want), rel=0.01)
    assert "instead of 1.0000" in caplog.text and "cannot reach" not in caplog.text
    # a budget that needs no bound stays, with the weights of plain raking
    small = {r["doc_id"]: r["probability"] for r in mixing.mix(df, dims, powers, 0.05, hold=True).collect()}
    plain = {r["doc_id"]: r["probability"] for r in mixing.mix(df, dims, powers, 0.05).collect()}
    assert small == pytest.approx(plain, rel=1e-3)
    # targets that exclude each other are reported, and rows still drawn
    caplog.clear()
    tied = df.withColumn("lang", F.col("source"))
    out = mixing.mix(tied, dims, powers, 1.0, hold=True)
    assert out.where("sampled").count() > 0 and "cannot reach" in caplog.text
    assert mixing.mix(df.where("doc_id < 0"), dims, powers, hold=True).count() == 0


def test_raking_reaches_the_target_shares(spark, empty):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaab"), rng.choice(["x", "y", None]), rng.randrange(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.25), ("b", 0.5), ("unseen", 0.25)], "source string, share double")}
    cells = df.na.fill("-").groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"))
    w = mixing.rake(cells, ["source", "lang"], {"lang": 0.0}, targets, 30).toPandas()
    assert w.groupby("source")["w"].sum().to_dict() == pytest.approx({"a": 1 / 3, "b": 2 / 3})
    assert w.groupby("lang")["w"].sum().tolist() == pytest.approx([1 / 3] * 3)
    out = mixing.mix(df, ["source", "lang"], {"source": 0.5, "lang": 0.5}, 0.5).toPandas()
    assert len(out) == 3000 and out["probability"].between(0, 1).all()
    drawn = out[out["sampled"]]["n_tokens"].sum()
    assert drawn == pytest.approx((out["probability"] * out["n_tokens"]).sum(), rel=0.1)
    none = df.where("doc_id < 0")
    assert mixing.mix(none, ["source", "lang"], {}).count() == 0
    zero = df.withColumn("n_tokens", F.lit(0).cast("long"))
    assert mixing.mix(zero, ["source"], {}).where("probability > 0 or sampled").count() == 0


# ------------------------------------------------------------------ chat

def test_chat_rotation_matches_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in (1, 2, 3):
        for turn in range({1: 5, 2: 150, 3: 3}[conv]):
            role = "system" if conv == 3 or turn == 0 else rng.choice(["user", "assistant", "ann", None])
            rows.append((conv, turn, role, rng.choice([None, "", "hi é", sentence(rng, 5)]), "x"))
    rows += [(4, 0, "user", "same", "x")] * 3 + [(None, 0, "user", "null conv", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, number string").repartition(4)
    got = chat.rotations(df, chunk_turns=8).collect()
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    dialogues = {}
    for conv, turn, role, text, _ in rows:
        dialogues.setdefault(conv, []).append((turn, role or "unknown", text or ""))
    want = {(c, s) for c, turns in dialogues.items() for _, s, _ in turns if s != "system"}
    assert set(by) == want
    for (conv, me), chunks in by.items():
        chunks.sort(key=lambda r: r["chunk"])
        text, learnt = "", []
        for _, s, t in sorted(dialogues[conv], key=lambda x: x[:2]):
            who = "assistant" if s == me else s if s == "system" else f"user name={s}"
            text += f"<|im_start|>{who}\n"
            if s == me:
                learnt.append(t + "<|im_end|>")
            text += t + "<|im_end|>\n"
        assert "".join(r["text"] for r in chunks) == text
        at, masked = 0, []
        for r in chunks:
            assert r["char_start"] == at and r["n_turns"] <= 8
            at += len(r["text"])
            masked += [r["text"][m["start"]:m["end"]] for m in r["mask"]]
        assert masked == learnt
    assert chat.rotations(df.where("conv_id < 0")).count() == 0


# ------------------------------------------------------------------ urls

def brute_rule(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host):])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


def test_url_rules_match_brute_force(spark):
    rng = random.Random(8)
    rules = [*URL_RULES, ("block", "net", ""), ("allow", "b.net", "/a/b"), ("block", "b.net", "/a"), ("allow", "net", "/a/b/c/d")]
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "org", "x.com", "b.net", "c.b.net", "bb.net",
             "", "..", "u:p@b.net:80", "é.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q#f", "/fr/x", "/de/", "/a", "/a/b", "/a/b/c/d#x", "?q=/es/"]
    data = [(i, rng.choice(["http", "https", "x"]) + "://" + rng.choice(hosts) + rng.choice(paths)) for i in range(400)]
    data += [(500, None), (501, "no scheme/org/"), (502, ""), (503, "a://b://c.org/"), (None, "http://org/"), (504, "http://org/")]
    data += [(600, "http://a.example.org/es/1")] * 3 + [(1000 + i, "http://hot.example.org/en/1") for i in range(200)]
    df = spark.createDataFrame([(*x, "r") for x in data], "page_id long, url string, rule string").repartition(3)
    got = urls.judge(df, rules, ranges=9).collect()
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute_rule(u, rules)) for i, u in data), key=key)
    assert urls.judge(df.where("page_id < 0"), rules).count() == 0


# --------------------------------------------------------------- secrets

def test_secret_spans_match_plain_scans(spark, edge_rows, empty):
    key = "AKIA" + "Z9" * 10
    texts = ["password = hunter22, PASSWD:'abc' Api_Key=\"abcdef\"", f"x{key} {key[:12]}", "0123456789abcdef" * 3 + "é",
             "é token: " + "a" * 23 + "g secret=" + "f0" * 12, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
             "eyJhbGciOiJI.eyJzdWIiOiIx.abc-_", "apikey:=x api_key == 123456", "tokentoken=secret=abcdefg", "ſecret=abcdef1"]
    rows = [*edge_rows, *enumerate(texts, 200)]
    rules = [*secret_scan.BASE_RULES, *secret_scan.MORE_RULES]
    got = secret_scan.scan(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        found = sorted((m.start(), n, m.end()) for n, r in enumerate(rules) for m in re.finditer(r.pattern, t or "")
                       if len(m[r.group]) >= r.least)
        name = [(n, f"{rules[n].kind}:{a}:{b}") for a, n, b in found]
        base = ",".join(x for n, x in name if n < 3)
        want.append((i, *[sum(n == k for n, _ in name) for k in range(3)],
                     hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in name)))
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r["n_assign"] for r in got) == 5 and sum(r["n_hex"] for r in got) == 3
    assert secret_scan.scan(empty).count() == 0


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE_RULES}
    assert q["hex"] == []
    assert q["access"] == [[["aki", "kia"]]]
    assert ["ecr", "cre", "ret", "sec"] and ["cre", "ecr", "ret", "sec"] in q["assign"][0]
    assert ["api", "ike", "key", "pik"] in q["assign"][0]


# -------------------------------------------------------------- language

def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "c", "bc", "▁abc", "a", "▁"]
    pieces = [p for p in pieces if p != "▁"]
    rng = np.random.default_rng(1)
    probs = np.vstack([rng.random((len(pieces), 2)), np.zeros(2)])

    def brute(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for m in range(1, len(word) + 1):
            if word[:m] in pieces:
                total += probs[pieces.index(word[:m]), lang] * brute(word[m:], lang)
            elif m == 1:
                total += language.RARE * brute(word[1:], lang)
        return total

    words = ["▁abc", "▁a", "▁abcbca", "▁zb", "▁ab", "▁cab"]
    got = language.forward(language.PieceTable(pieces), probs, words)
    for w, row in zip(words, got):
        assert np.exp(row) == pytest.approx([brute(w, 0), brute(w, 1)])
    table = language.PieceTable(pieces)
    counts = language.expected_counts(table, probs, ["▁abc"], np.array([0]), np.array([2.0]))
    # pieces weighted by their length cover the word, apart from rare letters
    assert counts[pieces.index("▁abc"), 0] == pytest.approx(2 * probs[pieces.index("▁abc"), 0] / brute("▁abc", 0))


def test_language_held_out_accuracy_and_edges(spark, docs, empty):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(base, public_tokenizers.path(PIECES), docs_per_language=60)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = language.predict(base, model).join(base.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    edge = language.predict(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    und = language.predict(frame(spark, [(1, None), (2, ""), (3, "42 !!"), (4, "der die das")]), model).collect()
    assert [r["lang_pred"] for r in sorted(und, key=lambda r: r["doc_id"])][:3] == ["und"] * 3
    assert language.predict(empty, model).count() == 0
    untrained = language.train(empty, public_tokenizers.path(PIECES))
    assert language.predict(docs, untrained).where("lang_pred <> 'und'").count() == 0


# ------------------------------------------------------- near duplicates

def brute_components(rows, k):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = root(rows[a][0]), root(rows[b][0])
                    parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)]


def near_copies(seed):
    """Chains and stars of near copies, and documents that share a passage."""
    rng = random.Random(seed)
    passage = sentence(rng, 60, 5000).split()
    rows = []
    for g in range(4):
        text = sentence(rng, 120, 5000).split()
        for c in range(25):
            own = list(text)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(["edited", f"e{rng.randrange(99)}"])
            if rng.random() < 0.3:
                text = own
            rows.append(" ".join(own))
    for _ in range(40):
        rows.append(" ".join(sentence(rng, rng.randrange(20, 90), 5000).split() + passage))
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, edge_rows, seed):
    rows = [*(edge_rows if seed == 1 else []), *near_copies(seed)]
    got = neardup.components_of(frame(spark, rows).repartition(4), shingle=4).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) \
        == sorted(brute_components(rows, 4), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_empty_table(spark, empty):
    assert neardup.components_of(empty).count() == 0
