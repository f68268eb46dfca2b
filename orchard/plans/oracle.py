"""DuckDB SQL oracles for the registered queries that SQL can express.

Views ``embeddings documents events labels orders part ...`` are the driver's
tables.  Column names and types follow the Spark side; doubles are rounded
to 6 places as there.  DuckDB lists are 1-based, Spark arrays 0-based in
``posexplode``; the SQL below adds 1 where it indexes.
"""

from __future__ import annotations

# Shared CTE bodies -------------------------------------------------------

PTS = """pts AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features,
         CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM embeddings)"""
LAB = "lab AS (SELECT id FROM pts ORDER BY id LIMIT 10)"
UNL = "unl AS (SELECT * FROM pts WHERE id NOT IN (SELECT id FROM lab))"


def _un(src: str, name: str = "un") -> str:
    """Unit rows of ``src(id, features)``; zero vectors stay zero."""
    return f"""{name} AS (
  SELECT id, CASE WHEN nm = 0 THEN list_transform(features, lambda x: 0.0::DOUBLE)
                  ELSE list_transform(features, lambda x: x / nm) END AS features
  FROM (SELECT id, features, sqrt(list_sum(list_transform(features, lambda x: x * x))) AS nm
        FROM {src}))"""


def _votes(src: str, name: str = "votes") -> str:
    return f"""{name} AS (
  SELECT id, CAST(t AS INTEGER) AS tree,
         CASE WHEN list_sum(features[t + 1:len(features):10]) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vote
  FROM {src}, range(0, 10) r(t))"""


def _stats(votes: str = "votes", name: str = "st") -> str:
    return f"""{name} AS (
  SELECT id, count(vote) AS n_votes, sum(vote) AS sum_votes, sum(vote) / count(vote) AS mean_vote,
         stddev_samp(vote) AS sd_vote, 1 - sum(vote) / count(vote) AS p0
  FROM {votes} GROUP BY id)"""


TRI = """tri AS (
  SELECT id AS i, CAST(generate_subscripts(features, 1) - 1 AS BIGINT) AS j,
         unnest(features) AS value FROM pts)"""

HALF_ENTROPY = "CASE WHEN p0 > 0 THEN -p0 * log2(p0) ELSE 0.0 END"


def _md5(col: str, seed) -> str:
    return f"md5(concat_ws(':', {col}, '{seed}'))"


def _bucket(col: str, seed, buckets: int) -> str:
    return f"(CAST(('0x' || substr({_md5(col, seed)}, 1, 8)) AS BIGINT) % {buckets})"


def _pool_state(labeled_cte: str) -> str:
    return f"""SELECT p.id, CAST(l.labeled_at AS INTEGER) AS labeled_at
FROM pts p LEFT JOIN ({labeled_cte}) l ON p.id = l.id"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _loop_k() -> str:
    """Batch size that empties the pool in 5 rounds, and the rows to label."""
    return """kk AS (SELECT CAST(count(*) - 10 AS BIGINT) AS n, CAST(ceil((count(*) - 10) / 5.0) AS BIGINT) AS k
       FROM pts)"""


SEP = """sep AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM orders)"""
SEP_LOOP = f"""kk AS (SELECT CAST(count(*) - 200 AS BIGINT) AS n, CAST(ceil((count(*) - 200) / 3.0) AS BIGINT) AS k
       FROM sep WHERE {_bucket('id', 7, 5)} <> 0)"""

LOOP_BATCHES = """SELECT CAST((rn - 1) // k + 1 AS INTEGER) AS iteration, CAST((rn - 1) % k + 1 AS INTEGER) AS rank, id
FROM r, kk"""

DENSITY_ALL_PAIRS = (_with(PTS, LAB, _un("pts"))
                     + """SELECT a.id, round(coalesce(sum(list_dot_product(a.features, b.features)), 0), 6) AS density
FROM un a, un b WHERE b.id NOT IN (SELECT id FROM lab) GROUP BY a.id""")

STUMP_PRED = """pred AS (
  SELECT p.id, p.label, CASE WHEN st.mean_vote > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
         st.mean_vote AS score
  FROM pts p JOIN st ON p.id = st.id)"""

LAL_STATE = f"""f AS (SELECT id, mean_vote AS f1, coalesce(sd_vote, 0.0) AS f2 FROM st),
lst AS (
  SELECT id, f1, f2,
         (SELECT avg(label) FROM pts WHERE id IN (SELECT id FROM lab)) AS f3,
         (SELECT avg(f2) FROM f) AS f6,
         (SELECT count(*) FROM lab) AS f8
  FROM f)"""


ORACLE: dict[str, str] = {
    "label_recode": """
SELECT vec_id AS id,
       CASE WHEN label >= 5 THEN 1 ELSE -1 END AS raw_sign,
       CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_sign,
       CASE WHEN label < 3 THEN 2 ELSE 4 END AS raw_code,
       CASE WHEN label < 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y_code
FROM embeddings""",

    "strip_split_cast": r"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first_token, t[-1] AS last_token,
       CAST(len(nm) AS INTEGER) AS n_numeric,
       list_max(list_transform(nm, lambda x: TRY_CAST(x AS DOUBLE))) AS max_numeric
FROM (SELECT doc_id, t,
             list_filter(t, lambda x: regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')) AS nm
      FROM (SELECT doc_id,
                   list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS t
            FROM documents))""",

    "props_cast": """
SELECT event_id AS id,
       TRY_CAST(regexp_replace(string_split(props, ':')[-1], '[} ]', '', 'g') AS INTEGER) AS k,
       value
FROM events""",

    "text_round_trip": _with(PTS) + """
SELECT id, CAST(len(features) + 1 AS INTEGER) AS n_fields, label,
       round(list_sum(features), 6) AS feature_sum, true AS exact
FROM pts""",

    "missing_filter": """
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines,
       CAST(len(list_filter(l, lambda x: x = '')) AS INTEGER) AS n_blank,
       CAST(len(list_filter(l, lambda x: starts_with(x, '"'))) AS INTEGER) AS n_header,
       CAST(len(list_filter(l, lambda x: list_contains(string_split(x, ','), '?'))) AS INTEGER) AS n_missing,
       CAST(len(list_filter(l, lambda x: x <> '' AND NOT starts_with(x, '"')
                                 AND NOT list_contains(string_split(x, ','), '?'))) AS INTEGER) AS n_kept
FROM (SELECT o_orderkey AS doc_id, string_split(
        CASE WHEN o_orderstatus = 'P' THEN '"custkey","priority"' || chr(10) ELSE '' END
        || CASE WHEN o_custkey % 7 = 0 THEN chr(10) ELSE '' END
        || o_custkey || ',' || CASE WHEN starts_with(o_orderpriority, '5') THEN '?'
                                    ELSE substr(o_orderpriority, 1, 1) END
        || chr(10) || o_orderkey || ',1', chr(10)) AS l FROM orders)""",

    "class_distribution": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",

    "row_identity": "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS row_index FROM embeddings",

    "first_n_sample": _with(PTS) + "SELECT id, label FROM pts ORDER BY id LIMIT 100",

    "standard_scale": _with(PTS, TRI) + """, s AS (SELECT j, avg(value) AS mu, stddev_samp(value) AS sd FROM tri GROUP BY j)
SELECT t.i AS id, CAST(t.j AS INTEGER) AS dim,
       round(CASE WHEN s.sd = 0 THEN 0.0 ELSE (t.value - s.mu) / s.sd END, 6) AS value
FROM tri t JOIN s ON t.j = s.j""",

    "scale_train_apply_test": _with(PTS, TRI) + f""", s AS (
  SELECT j, avg(value) AS mu, stddev_samp(value) AS sd FROM tri
  WHERE {_bucket('i', 7, 5)} <> 0 GROUP BY j)
SELECT t.i AS id, CAST(t.j AS INTEGER) AS dim,
       round(CASE WHEN s.sd = 0 THEN 0.0 ELSE (t.value - s.mu) / s.sd END, 6) AS value
FROM tri t JOIN s ON t.j = s.j WHERE {_bucket('t.i', 7, 5)} = 0""",

    "unit_vectors": _with(PTS, _un("pts", "ue"),
                          "ev AS (SELECT event_id AS id, [value - floor(value), 0.0]::DOUBLE[] AS features FROM events)",
                          _un("ev", "uv")) + """
SELECT id, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS dim,
       round(unnest(features), 6) AS value, 'embeddings' AS source FROM ue
UNION ALL
SELECT id, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS dim,
       round(unnest(features), 6) AS value, 'events' AS source FROM uv""",

    "shared_label_encode": """
WITH v AS (SELECT 0 AS c, p_brand AS value FROM part WHERE p_brand IS NOT NULL
           UNION ALL SELECT 1 AS c, p_type AS value FROM part WHERE p_type IS NOT NULL),
d AS (SELECT value, min(c) AS c FROM v GROUP BY value),
codes AS (SELECT value, row_number() OVER (ORDER BY c, value) - 1 AS code FROM d)
SELECT p_partkey, b.code AS p_brand_code, t.code AS p_type_code
FROM part LEFT JOIN codes b ON part.p_brand = b.value LEFT JOIN codes t ON part.p_type = t.value""",

    "hash_split": f"""
SELECT o_orderkey, CASE WHEN {_bucket('o_orderkey', 11, 10000)} < 7000 THEN 0 ELSE 1 END AS split
FROM orders""",

    "random_permutation": f"""
SELECT event_id AS id, row_number() OVER (ORDER BY {_md5('event_id', 42)}, event_id) - 1 AS position
FROM events""",

    "random_k": f"""
SELECT CAST(rn AS INTEGER) AS rank, id FROM (
  SELECT event_id AS id, row_number() OVER (ORDER BY {_md5('event_id', 42)}, event_id) AS rn FROM events)
WHERE rn <= 100""",

    "one_random_per_class": f"""
SELECT event_type, arg_min(event_id, {_md5('event_id', 42)}) AS event_id FROM events GROUP BY event_type""",

    "sorted_ints": """
SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position, o_custkey AS value FROM orders""",

    # -------------------------------------------------- file round trips
    "text_file_round_trip": _with(PTS) + """
SELECT row_number() OVER (ORDER BY id) - 1 AS id, CAST(len(features) AS INTEGER) AS n_features, label,
       round(list_sum(features), 6) AS feature_sum
FROM pts""",

    "train_test_files": _with(PTS, f"p AS (SELECT *, CASE WHEN {_bucket('id', 7, 5)} = 0 THEN 'test' ELSE 'train' END AS part FROM pts)") + """
SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS id,
       CAST(len(features) AS INTEGER) AS n_features, label, round(list_sum(features), 6) AS feature_sum
FROM p""",

    "vectors_file": _with(PTS) + """
SELECT row_number() OVER (ORDER BY id) - 1 AS id, CAST(len(features) AS INTEGER) AS n_features,
       round(list_sum(features), 6) AS feature_sum
FROM pts""",

    "csv_file_round_trip": """
SELECT 3 AS n_features, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
       round(o_totalprice + CAST(o_custkey AS DOUBLE) + CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 6)
         AS feature_sum
FROM orders WHERE NOT starts_with(o_orderpriority, '5')""",

    "triples_file": _with(PTS, TRI) + "SELECT i, j, value FROM tri",

    "ints_file": """
SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS position, o_custkey AS value
FROM orders""",

    "gain_table_file": _with(PTS, LAB, UNL, _votes("unl"), _stats(), LAL_STATE) + """
SELECT round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(f6, 6) AS f6,
       round(CAST(f8 AS DOUBLE), 6) AS f8, round(abs(0.5 - f1), 6) AS gain FROM lst""",

    "regression_table_file": _with(PTS, LAB, UNL, _votes("unl"), _stats(), LAL_STATE) + """
SELECT 8 AS n_features, round(f1 + f2 + f3 + 0.0 + 0.0 + f6 + 0.0 + CAST(f8 AS DOUBLE), 6) AS feature_sum,
       round(abs(0.5 - f1), 6) AS gain FROM lst""",

    # -------------------------------------------------------- pool state
    "start_first_k": _with(PTS, LAB) + _pool_state("SELECT id, 0 AS labeled_at FROM lab"),

    "start_one_per_class": _with(PTS, f"""k AS (SELECT id, label, {_md5('id', 3)} AS key FROM pts)""",
                                 "pc AS (SELECT arg_min(id, key) AS id, min(key) AS key FROM k GROUP BY label)",
                                 """ex AS (SELECT id, key FROM k WHERE id NOT IN (SELECT id FROM pc)
                                           ORDER BY key, id LIMIT 10)""",
                                 """top AS (SELECT id FROM (SELECT id, 0 AS grp, key FROM pc
                                                            UNION ALL SELECT id, 1 AS grp, key FROM ex)
                                            ORDER BY grp, key, id LIMIT 10)""")
    + _pool_state("SELECT id, 0 AS labeled_at FROM top"),

    "fetch_labeled": _with(PTS, LAB) + "SELECT id, label FROM pts WHERE id IN (SELECT id FROM lab)",

    "fetch_unlabeled": _with(PTS, LAB) + "SELECT id, label FROM pts WHERE id NOT IN (SELECT id FROM lab)",

    "apply_batch": _with(PTS, LAB, UNL,
                         f"bat AS (SELECT id FROM unl ORDER BY {_md5('id', 5)}, id LIMIT 10)")
    + _pool_state("SELECT id, 0 AS labeled_at FROM lab UNION ALL SELECT id, 1 AS labeled_at FROM bat"),

    "reset_pool": _with(PTS, LAB) + _pool_state("SELECT id, 0 AS labeled_at FROM lab"),

    # --------------------------------------------------------- committee
    "committee_votes": _with(PTS, _votes("pts")) + "SELECT id, tree, vote FROM votes",

    "vote_stats": _with(PTS, _votes("pts"), _stats()) + """
SELECT id, n_votes, sum_votes, round(mean_vote, 6) AS mean_vote, round(sd_vote, 6) AS sd_vote,
       round(p0, 6) AS p0 FROM st""",

    "margin_scores": _with(PTS, _votes("pts"), _stats())
    + "SELECT id, round(abs(0.5 - p0), 6) AS margin FROM st",

    "half_entropy_scores": _with(PTS, _votes("pts"), _stats())
    + f"SELECT id, round({HALF_ENTROPY}, 6) AS half_entropy FROM st",

    "majority_vote": _with(PTS, _votes("pts"), _stats())
    + "SELECT id, CASE WHEN mean_vote > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM st",

    "select_uncertain": _with(PTS, LAB, UNL, _votes("unl"), _stats()) + """
SELECT CAST(row_number() OVER (ORDER BY round(abs(0.5 - p0), 9), id) AS INTEGER) AS rank, id,
       round(abs(0.5 - p0), 6) AS score
FROM st ORDER BY round(abs(0.5 - p0), 9), id LIMIT 20""",

    # -------------------------------------------------------- similarity
    "cosine_full": _with(PTS, _un("pts")) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value FROM un a, un b""",

    "cosine_upper": _with(PTS, _un("pts")) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value
FROM un a, un b WHERE a.id < b.id""",

    "triples_transpose": _with(PTS, TRI) + "SELECT j AS i, i AS j, value FROM tri",

    "triples_to_rows": _with(PTS) + """
SELECT id, CAST(len(features) AS INTEGER) AS width, round(list_sum(features), 6) AS total,
       round(sqrt(list_sum(list_transform(features, lambda x: x * x))), 6) AS norm FROM pts""",

    "triple_multiply": _with(PTS) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value FROM pts a, pts b""",

    "triple_column_similarity": _with(PTS, _un("pts")) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value
FROM un a, un b WHERE a.id < b.id""",

    "cosine_join": _with(PTS, _un("pts")) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value
FROM un a, un b WHERE a.id < b.id AND list_dot_product(a.features, b.features) >= 0.4""",

    "sparse_multiply": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS t
           FROM documents),
w AS (SELECT doc_id AS i, generate_subscripts(t, 1) - 1 AS p, unnest(t) AS word FROM d)
SELECT i, p // 64 AS j, sum(length(word) * pow(2.0, -(p % 8))) AS value FROM w GROUP BY i, p // 64""",

    "density_rounds": _with(PTS, _un("pts"), f"""seq AS (
  SELECT id, (row_number() OVER (ORDER BY {_md5('id', 42)}, id) - 1) // CAST(ceil(count(*) OVER () / 5.0) AS BIGINT) + 1 AS it
  FROM pts)""", """hit AS (
  SELECT a.id AS i, b.id AS j, list_dot_product(a.features, b.features) AS value FROM un a, un b
  WHERE a.id <> b.id AND list_dot_product(a.features, b.features) >= 0.3)""") + """
SELECT CAST(t AS INTEGER) AS iteration, s.id, round(coalesce(sum(h.value), 0.0), 6) AS density
FROM range(0, 5) r(t) JOIN seq s ON s.it > t
LEFT JOIN (SELECT hit.*, seq.it FROM hit JOIN seq ON seq.id = hit.j) h ON h.i = s.id AND h.it > t
GROUP BY t, s.id""",

    "drop_labeled_entries": _with(PTS, LAB, _un("pts")) + """
SELECT a.id AS i, b.id AS j, round(list_dot_product(a.features, b.features), 6) AS value
FROM un a, un b WHERE a.id NOT IN (SELECT id FROM lab) AND b.id NOT IN (SELECT id FROM lab)""",

    "density_linear": DENSITY_ALL_PAIRS,

    "density_row_sums": _with(PTS, LAB, _un("pts")) + """
SELECT a.id, round(sum(list_dot_product(a.features, b.features)), 6) AS density
FROM un a, un b WHERE a.id NOT IN (SELECT id FROM lab) AND b.id NOT IN (SELECT id FROM lab)
GROUP BY a.id""",

    "select_density": _with(PTS, LAB, UNL, _un("pts"), _votes("unl"), _stats(),
                            """dens AS (SELECT a.id, sum(list_dot_product(a.features, b.features)) AS density
                                        FROM un a, un b WHERE b.id NOT IN (SELECT id FROM lab) GROUP BY a.id)""",
                            f"""sc AS (SELECT st.id, ({HALF_ENTROPY}) * coalesce(dens.density, 0.0) AS score
                                       FROM st LEFT JOIN dens ON st.id = dens.id)""") + """
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id,
       round(score, 6) AS score
FROM sc ORDER BY round(score, 9) DESC, id LIMIT 20""",

    "select_density_squared": _with(PTS, LAB, UNL, _un("pts"), _votes("unl"), _stats(),
                                    """dens AS (SELECT a.id, sum(list_dot_product(a.features, b.features)) AS density
                                        FROM un a, un b WHERE b.id NOT IN (SELECT id FROM lab) GROUP BY a.id)""",
                                    f"""sc AS (SELECT st.id, ({HALF_ENTROPY}) * pow(coalesce(dens.density, 0.0), 2) AS score
                                       FROM st LEFT JOIN dens ON st.id = dens.id)""") + """
SELECT 1::INTEGER AS rank, id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, id LIMIT 1""",

    "select_density_table": _with(PTS, LAB, UNL, _un("pts"), _votes("unl"), _stats(),
                                  """dens AS (SELECT a.id, sum(list_dot_product(a.features, b.features)) AS density
                                        FROM un a, un b WHERE b.id NOT IN (SELECT id FROM lab)
                                        GROUP BY a.id)""",
                                  f"""sc AS (SELECT st.id, ({HALF_ENTROPY}) * coalesce(dens.density, 0.0) AS score
                                       FROM st LEFT JOIN dens ON st.id = dens.id)""") + """
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id,
       round(score, 6) AS score
FROM sc ORDER BY round(score, 9) DESC, id LIMIT 20""",

    "vector_sum": _with(PTS, TRI) + "SELECT CAST(j AS INTEGER) AS dim, round(sum(value), 6) AS total FROM tri GROUP BY j",

    # --------------------------------------------------------------- LAL
    "lal_state": _with(PTS, LAB, UNL, _votes("unl"), _stats(), LAL_STATE) + """
SELECT id, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(f6, 6) AS f6, f8 FROM lst""",

    "select_lal_linear": _with(PTS, LAB, UNL, _votes("unl"), _stats(), LAL_STATE,
                               """g AS (SELECT id, 0.0 + f1 * 0.5 + f2 * 2.0 + f3 * -0.25 + f6 * 1.0
                                                   + CAST(f8 AS DOUBLE) * 0.001 AS score FROM lst)""") + """
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, id,
       round(score, 6) AS score
FROM g ORDER BY round(score, 9) DESC, id LIMIT 5""",

    # -------------------------------------------------------- evaluation
    "accuracy": _with(PTS, _votes("pts"), _stats(), STUMP_PRED)
    + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred",

    "test_error": _with(PTS, _votes("pts"), _stats(), STUMP_PRED)
    + "SELECT round(avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END), 6) AS test_error FROM pred",

    "misclassified": _with(PTS, _votes("pts"), _stats(), STUMP_PRED)
    + "SELECT id, label, prediction FROM pred WHERE label <> prediction",

    "mse": _with(PTS, _votes("pts"), _stats(), STUMP_PRED)
    + "SELECT round(avg(pow(label - score, 2)), 6) AS mse FROM pred",

    "confusion": _with(PTS, _votes("pts"), _stats(), STUMP_PRED) + """
SELECT CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM pred""",

    "auc": _with(PTS, _votes("pts"), _stats(), STUMP_PRED,
                 """ps AS (SELECT score AS s, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS pos,
                                  sum(CASE WHEN label = 1 THEN 0.0 ELSE 1.0 END) AS neg
                           FROM pred GROUP BY score)""",
                 """cum AS (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                                                 AND CURRENT ROW) AS neg_cum FROM ps)""") + """
SELECT round(CAST(sum(pos * (neg_cum - neg * 0.5)) AS DOUBLE)
             / CAST((SELECT sum(pos) FROM ps) * (SELECT sum(neg) FROM ps) AS DOUBLE), 6) AS auc FROM cum""",

    # ------------------------------------------------------------- loops
    "loop_random": _with(PTS, LAB, _loop_k(), f"""r AS (SELECT id, row_number() OVER (ORDER BY {_md5('id', 42)}, id) AS rn
                                           FROM pts WHERE id NOT IN (SELECT id FROM lab))""") + LOOP_BATCHES,

    "round_log_table": _with(PTS, LAB, _loop_k(), f"""r AS (SELECT id, row_number() OVER (ORDER BY {_md5('id', 42)}, id) AS rn
                                           FROM pts WHERE id NOT IN (SELECT id FROM lab))""") + LOOP_BATCHES,

    "round_log": _with(PTS, LAB, _loop_k()) + """
SELECT CAST(i AS INTEGER) AS iteration, 10 + k * (i - 1) AS n_labeled, n - k * (i - 1) AS n_unlabeled,
       least(k, n - k * (i - 1)) AS batch_rows, true AS timed
FROM range(1, 100) x(i), kk WHERE k * (i - 1) < n""",

    # features that tell the classes apart: every tree votes the label
    "csv_supervised_job": f"""
WITH o AS (SELECT o_orderstatus = 'F' AS positive, {_bucket('o_orderkey', 1, 10000)} < 7000 AS train
           FROM orders WHERE NOT starts_with(o_orderpriority, '5'))
SELECT from_store, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test,
       100::INTEGER AS num_trees, 1.0::DOUBLE AS accuracy,
       count(*) FILTER (NOT train AND NOT positive) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn,
       count(*) FILTER (NOT train AND positive) AS tp, 1.0::DOUBLE AS auc
FROM o, (VALUES (false), (true)) s(from_store) GROUP BY from_store""",

    # means and deviations of the training file alone; ids count the lines of a file
    "dataset_job": _with(
        PTS, f"""parts AS (SELECT *, {_bucket('id', 7, 5)} = 0 AS test FROM pts)""",
        "files AS (SELECT row_number() OVER (PARTITION BY test ORDER BY id) - 1 AS id, test, features, label FROM parts)",
        """cells AS (SELECT id, test, label, generate_subscripts(features, 1) - 1 AS j, unnest(features) AS value
                     FROM files)""",
        "s AS (SELECT j, avg(value) AS mu, stddev_samp(value) AS sd FROM cells WHERE NOT test GROUP BY j)",
        """votes AS (SELECT id, test, label, j % 10 AS tree,
                            sum(CASE WHEN sd = 0 THEN 0.0 ELSE (value - mu) / sd END) > 0 AS vote
                     FROM cells JOIN s USING (j) GROUP BY id, test, label, j % 10)""",
        "st AS (SELECT id, test, label, count(*) FILTER (vote) / 10.0::DOUBLE AS mean_vote FROM votes GROUP BY ALL)",
        f"k AS (SELECT id, label, {_md5('id', 3)} AS key FROM files WHERE NOT test)",
        "pc AS (SELECT arg_min(id, key) AS id, min(key) AS key FROM k GROUP BY label)",
        """lab AS (SELECT id FROM (SELECT id, 0 AS grp, key FROM pc
                                   UNION ALL SELECT id, 1, key FROM k WHERE id NOT IN (SELECT id FROM pc))
                   ORDER BY grp, key, id LIMIT 10)""",
        """r AS (SELECT id, row_number() OVER (ORDER BY round(abs(mean_vote - 0.5), 9), id) AS rn
                 FROM st WHERE NOT test AND id NOT IN (SELECT id FROM lab))""",
        "kk AS (SELECT CAST(ceil(count(*) / 5.0) AS BIGINT) AS k FROM r)") + """
SELECT CAST((rn - 1) // k + 1 AS INTEGER) AS iteration, CAST((rn - 1) % k + 1 AS INTEGER) AS rank, id,
       (SELECT round(avg(CASE WHEN (mean_vote > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) FROM st WHERE test)
       AS test_accuracy
FROM r, kk""",

    "dataset_history": _with(PTS, f"""kk AS (
  SELECT CAST(count(*) - 10 AS BIGINT) AS n, CAST(ceil((count(*) - 10) / 3.0) AS BIGINT) AS k
  FROM pts WHERE {_bucket('id', 7, 5)} <> 0)""") + """
SELECT CAST(i AS INTEGER) AS iteration, least(10 + k * (i - 1), n + 10) AS n_labeled,
       greatest(n - k * (i - 1), 0) AS n_unlabeled, true AS measured, true AS timed
FROM range(1, 100) x(i), kk WHERE k * (i - 2) < n""",

    "loop_uncertain_fixed_committee": _with(PTS, LAB, UNL, _loop_k(), _votes("unl"), _stats(),
                                            """r AS (SELECT id, row_number() OVER (ORDER BY round(abs(0.5 - p0), 9), id) AS rn
                                                     FROM st)""") + LOOP_BATCHES,

    "loop_density_fixed_committee": _with(
        PTS, LAB, UNL, _loop_k(), _un("pts"), _votes("unl"), _stats(),
        """dens AS (SELECT a.id, sum(list_dot_product(a.features, b.features)) AS density
                    FROM un a, un b WHERE b.id NOT IN (SELECT id FROM lab) GROUP BY a.id)""",
        f"""sc AS (SELECT st.id, ({HALF_ENTROPY}) * coalesce(dens.density, 0.0) AS score
                   FROM st LEFT JOIN dens ON st.id = dens.id)""",
        """r AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rn FROM sc)""") + LOOP_BATCHES,

    # f3, f6 and f8 are the same for every row of a round, so the round order
    # is that of 0.5 f1 + 2 f2 (distinct for distinct vote counts), ties by id
    "loop_lal_linear_fixed_committee": _with(
        PTS, LAB, UNL, _loop_k(), _votes("unl"), _stats(),
        """r AS (SELECT id, row_number() OVER (ORDER BY round(0.5 * mean_vote + 2.0 * coalesce(sd_vote, 0.0), 9) DESC,
                                               id) AS rn FROM st)""") + LOOP_BATCHES,

    "loop_history_fixed_committee": _with(PTS, LAB, _loop_k()) + """
SELECT CAST(i AS INTEGER) AS iteration, least(10 + k * (i - 1), n + 10) AS n_labeled,
       greatest(n - k * (i - 1), 0) AS n_unlabeled
FROM range(1, 100) x(i), kk WHERE k * (i - 2) < n""",

    # a forest that sees one 0/1 feature equal to the label votes the label
    "forest_separable_votes": _with(SEP) + f"""
SELECT id, CAST(t AS INTEGER) AS tree, label AS vote FROM sep, range(0, 10) r(t) WHERE {_bucket('id', 7, 5)} = 0""",

    "forest_separable_metrics": _with(SEP) + f"""
SELECT count(*) AS n_train, 1.0::DOUBLE AS accuracy_vote, 1.0::DOUBLE AS accuracy_avg, 0.0::DOUBLE AS test_error
FROM sep WHERE {_bucket('id', 7, 5)} <> 0""",

    "forest_separable_importance": _with(SEP) + """
SELECT 0::INTEGER AS feature, 1.0::DOUBLE AS importance FROM sep HAVING count(DISTINCT label) = 2""",

    "gain_regressor_separable": _with(SEP) + f"""
SELECT id, label AS prediction FROM sep WHERE {_bucket('id', 7, 5)} = 0""",

    "gain_regressor_stored": """
WITH c AS (SELECT c_custkey AS id, floor((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 7) AS level
  FROM customer),
best AS (SELECT *, row_number() OVER (ORDER BY level DESC, id) AS n FROM c)
SELECT call, call = 'second' AS from_store, CAST(n AS INTEGER) AS rank, id, round(level / 8, 6) AS score
FROM best, (VALUES ('first'), ('second')) v(call) WHERE n <= 5""",

    "loop_separable_history": _with(SEP, SEP_LOOP) + """
SELECT CAST(i AS INTEGER) AS iteration, least(200 + k * (i - 1), n + 200) AS n_labeled,
       greatest(n - k * (i - 1), 0) AS n_unlabeled, 1.0::DOUBLE AS accuracy
FROM range(1, 100) x(i), kk WHERE k * (i - 2) < n""",

    "loop_separable_batches": _with(SEP, SEP_LOOP, f"""r AS (
  SELECT id, row_number() OVER (ORDER BY id) - 200 AS rn FROM sep WHERE {_bucket('id', 7, 5)} <> 0)""") + """
SELECT CAST((rn - 1) // k + 1 AS INTEGER) AS iteration, CAST((rn - 1) % k + 1 AS INTEGER) AS rank, id
FROM r, kk WHERE rn > 0""",

    "sequence_to_exhaustion": _with(PTS, LAB, f"""r AS (SELECT id, row_number() OVER (ORDER BY {_md5('id', 42)}, id) - 1 AS pos
                                                      FROM pts WHERE id NOT IN (SELECT id FROM lab))""") + """
SELECT CAST(pos // 12 + 1 AS INTEGER) AS iteration, CAST(pos % 12 + 1 AS INTEGER) AS rank, id FROM r""",
}
