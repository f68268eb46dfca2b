"""DuckDB SQL for the document queries that SQL can express."""

from __future__ import annotations

import string

from orchard.llm.queries import MIX_BUDGET, MIX_DIMS, MIX_POWERS, MIX_SWEEPS, URL_RULES

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _mixing_sql() -> str:
    sweeps, step = [], 0
    keys, keys_down = ", ".join(MIX_DIMS), ", ".join(f"{d} DESC" for d in MIX_DIMS)
    targets = ", ".join(f"t_{d}" for d in MIX_DIMS)
    for _ in range(MIX_SWEEPS):
        for d in MIX_DIMS:
            step += 1
            by, below = f"PARTITION BY {d}", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
            sweeps.append(f"""g{step} AS (SELECT *, row_number() OVER ({by} ORDER BY x_limit, {keys}) AS place,
    (t_{d} - coalesce(sum(most) OVER ({by} ORDER BY x_limit, {keys} {below}), 0.0))
      / sum(w) OVER ({by} ORDER BY x_limit DESC, {keys_down} ROWS UNBOUNDED PRECEDING) AS f
  FROM (SELECT *, most / w AS x_limit FROM w{step - 1}))""")
            sweeps.append(f"""w{step} AS (SELECT {keys}, n, most, {targets},
    greatest(w * coalesce((min({{'place': place, 'f': f}}) FILTER (f <= x_limit) OVER ({by})).f,
                          max(x_limit) OVER ({by})), 1e-300) AS w FROM g{step})""")
    mass = ",\n".join(
        f"m_{d} AS (SELECT {d}, pow(sum(n)::DOUBLE, {MIX_POWERS[d]}) AS m FROM cells GROUP BY {d}),\n"
        f"t_{d} AS (SELECT {d}, m / sum(m) OVER () AS t_{d} FROM m_{d})" for d in MIX_DIMS)
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    source AS source_out, lang AS lang_out,
    CASE WHEN contains(coalesce(text, ''), 'icense') OR contains(coalesce(text, ''), 'opyright') THEN 'licence'
         WHEN contains(coalesce(text, ''), '@') THEN 'contact'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{{9}}') THEN 'records' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
cells AS (SELECT {keys}, sum(n_tokens)::DOUBLE AS n FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT sum(n) AS total FROM cells),
{mass},
w0 AS (SELECT {keys}, n, n / total / {MIX_BUDGET} AS most, n / total AS w, {", ".join(f"t_{d}" for d in MIX_DIMS)}
       FROM cells CROSS JOIN total {" ".join(f"JOIN t_{d} USING ({d})" for d in MIX_DIMS)}),
{", ".join(sweeps)},
chance AS (SELECT {keys}, least(1.0, least(w, most) * {MIX_BUDGET} * total / n) AS p FROM w{step}, total)
SELECT doc_id, source_out AS source, lang_out AS lang, topic, n_tokens,
  round(coalesce(p, 0.0), 6) AS probability,
  ('0x' || substr(md5(doc_id || ':20'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < coalesce(p, 0.0) AS sampled
FROM docs LEFT JOIN chance USING ({keys})
"""


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""

_AUDIT = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max(quality = 1)::INT AS good, max(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS earlier
  FROM o, range(1, 6) r(i))
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & bit = 0 AND mask & earlier = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step"""


def _manifest_sql(source_levels: int = 7, root_levels: int = 4) -> str:
    """Trees of up to 16^7 rows a source and 16^4 sources, level by level."""

    def tree(n: str, levels: int) -> str:
        parts = []
        for i in range(levels):
            parts.append(f"r_{n}{i} AS (SELECT src, pos // 16 AS pos, list(h ORDER BY pos) AS hs, any_value(c) AS c "
                         f"FROM {n}{i} WHERE c > 1 GROUP BY src, pos // 16)")
            parts.append(f"{n}{i + 1} AS (SELECT src, pos, sha256(array_to_string(hs, '')) AS h, (c + 15) // 16 AS c "
                         f"FROM r_{n}{i})")
        return ",\n".join(parts)

    def climb(frm: str, n: str, levels: int, at: str) -> str:
        """The digests around the path and the folded hash, level by level."""
        parts, last = [], frm
        for i in range(levels):
            slot = f"(x.{at} // {16 ** i} % 16)"
            before = f"array_to_string(r.hs[1:{slot}], '')"
            after = f"array_to_string(r.hs[{slot} + 2:], '')"
            name = f"f_{n}{i}"
            parts.append(f"{name} AS (SELECT x.* REPLACE (CASE WHEN r.hs IS NULL THEN proof ELSE proof || {before} || {after} "
                         f"END AS proof, CASE WHEN r.hs IS NULL THEN fold ELSE sha256({before} || fold || {after}) END AS fold) "
                         f"FROM {last} x LEFT JOIN r_{n}{i} r ON r.src = x.{'src' if n == 'n' else 'top'} "
                         f"AND r.pos = x.{at} // {16 ** (i + 1)})")
            last = name
        return ",\n".join(parts)

    def top(n: str, levels: int) -> str:
        return " UNION ALL ".join(f"SELECT src, h FROM {n}{i} WHERE c = 1" for i in range(levels + 1))

    fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    head = " || ".join(fields)
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""
    return f"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, coalesce('=' || source, '') AS src,
    sha256({head} || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({head} || coalesce(strlen(text) || ':' ||
      translate(text, {_LOWER}), '-')) END AS changed FROM documents, crc_table),
n0 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS c FROM docs),
{tree("n", source_levels)},
subroots AS ({top("n", source_levels)}),
s0 AS (SELECT 0 AS src, src AS name, h, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS c FROM subroots),
{tree("s", root_levels)},
roots AS ({top("s", root_levels)}),
x AS (SELECT n0.doc_id, n0.src, n0.pos, n0.h AS leaf, coalesce(changed, n0.h) AS fold, '' AS proof, 0 AS top,
    s0.pos AS place, s0.h AS subroot, roots.h AS root
  FROM n0 JOIN s0 ON n0.src = s0.name CROSS JOIN roots),
{climb("x", "n", source_levels, "pos")},
{climb(f"f_n{source_levels - 1}", "s", root_levels, "place")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM f_s{root_levels - 1}"""


ORACLE = {
    "op11_exact_topk": _TOPK,
    "op12_filter_audit": _AUDIT,
    "op13_merkle_manifest": _manifest_sql(),
    "op4_benchmark_decontamination": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(len(ws), 10) AS l, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS s
       FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS win FROM bs),
lens AS (SELECT DISTINCT l FROM bw),
ds AS (SELECT doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS s FROM w, lens WHERE len(ws) >= l),
h AS (SELECT doc_id, s, l, item_id FROM (SELECT doc_id, l, s, array_to_string(ws[s:s + l - 1], ' ') AS win FROM ds)
      JOIN bw USING (l, win)),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + l - 1)) FROM h)
      GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op5_source_mixing": _mixing_sql(),
    "op6_chat_rotation": """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown')) - 1 AS number
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, number, number // 32 AS chunk, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker
                           ELSE 'user name=' || replace(translate(speaker, chr(13) || chr(10), '  '), '<|im_', '<| im_') END
      || chr(10) AS head,
    replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
      PARTITION BY conv_id, perspective, chunk ORDER BY number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM r),
c AS (
  SELECT conv_id, perspective, chunk, count(*) AS n_turns, string_agg(head || body, '' ORDER BY number) AS text,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body) - 1), ',' ORDER BY number)
      FILTER (own), '') AS mask
  FROM o GROUP BY ALL)
SELECT conv_id, perspective, chunk, n_turns, coalesce(sum(length(text)) OVER (
    PARTITION BY conv_id, perspective ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    AS char_start, text, mask
FROM c
""",
    "op7_url_filter": f"""
WITH rules(verdict, rh, rp) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] END AS rest FROM pages)),
f AS (
  SELECT n, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON f.n = u.n AND k = 1
""",
    "op10_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, ws, unnest(generate_series(1, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 3, 1) END)) AS i
  FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh)
  WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
