"""Table preparation: text lines, labels, scaling, encoding, splits, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.functions.columns import (WHITESPACE, hash_bucket, numeric_key, order_key,
                                       split_fixed, strip_quotes, to_double_array, tokens)
from orchard.operators.ranking import index_rows

# Fixed values of the hash split: buckets per unit of weight.
SPLIT_BUCKETS = 10000


# ------------------------------------------------------------- text -------

def labeled_line(features="features", label="label", sep: str = " ",
                 quote_label: bool = False) -> F.Column:
    """Features then label as one ``sep``-delimited line (the text sink's row form)."""
    feats = F.array_join(F.transform(features, lambda x: x.cast("string")), sep)
    lab = (F.col(label) if isinstance(label, str) else label).cast("string")
    if quote_label:
        lab = F.concat(F.lit('"'), lab, F.lit('"'))
    return F.concat_ws(sep, feats, lab)


def render_labeled_line(points: DataFrame, sep: str = " ", quote_label: bool = False) -> DataFrame:
    """(id, line) rows for a point table."""
    return points.select("id", labeled_line("features", "label", sep, quote_label).alias("line"))


def parse_labeled_line(df: DataFrame, line, sep: str | None = None,
                       unquote: bool = False, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Last token is the label, the rest are features.

    ``sep=None`` splits on runs of whitespace after stripping (the whitespace
    loader); a literal ``sep`` splits on exactly that delimiter.
    """
    toks = tokens(line, WHITESPACE) if sep is None else split_fixed(line, sep)
    with_toks = df.select(*keep, toks.alias("tokens"))
    last = F.try_element_at("tokens", F.lit(-1))  # NULL for a line without tokens
    if unquote:
        last = strip_quotes(last)
    return with_toks.select(
        *keep, "tokens",
        to_double_array(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))))
        .alias("features"),
        last.try_cast("double").alias("label"))


def clean_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per text: lines, blank lines, header-like lines (start with a quote),
    lines holding a ``?`` field, and lines that survive all three filters."""
    lines = F.split(F.col(text_col), "\n")

    def count(pred):
        return F.size(F.filter(lines, pred))
    blank = lambda l: l == F.lit("")
    header = lambda l: l.startswith('"')
    missing = lambda l: F.array_contains(F.split(l, ","), "?")
    keep = lambda l: (l != F.lit("")) & ~l.startswith('"') & ~F.array_contains(F.split(l, ","), "?")
    return docs.select(F.col(id_col), F.size(lines).alias("n_lines"), count(blank).alias("n_blank"),
                       count(header).alias("n_header"), count(missing).alias("n_missing"),
                       count(keep).alias("n_kept"))


def class_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def first_n(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first n rows by key (a sampling operator; planned as a top-n)."""
    return df.orderBy(key).limit(n)


# --------------------------------------------------------- documents ------

def document_features(docs: DataFrame, keep: Sequence[str | F.Column] = ()) -> DataFrame:
    """Whole-text numeric features of a document, all built-in expressions;
    ``keep`` adds columns of the document."""
    # the words are a column of their own, so that they are split once
    toks = F.col("_words")
    n_tok = F.size(toks).cast("double")
    return docs.select("*", tokens("text").alias("_words")).select(
        "doc_id",
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        n_tok.alias("n_tokens"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace("text", "[^0-9]+", "")) / F.greatest(F.length("text"), F.lit(1)))
        .alias("digit_share"),
        (F.length(F.regexp_replace("text", "[^A-Z]+", "")) / F.greatest(F.length("text"), F.lit(1)))
        .alias("upper_share"),
        (F.size(F.array_distinct(toks)) / F.greatest(n_tok, F.lit(1.0))).alias("distinct_share"), *keep)


DOCUMENT_FEATURES = ("log_chars", "n_tokens", "n_lines", "digit_share", "upper_share",
                     "distinct_share")


# ----------------------------------------------------------- scaling ------

def standard_scale(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """(x - mean) / sample SD per feature, statistics from ``fit_on``.

    Spark ML's scaler takes the statistics in one tree aggregation and uses
    the n - 1 SD; a feature with SD 0 scales to 0.  Pass the same table twice
    to fit on itself.
    """
    scaler = StandardScaler(inputCol="fv", outputCol="sv", withMean=True, withStd=True)
    model = scaler.fit(fit_on.select(array_to_vector("features").alias("fv")))
    out = model.transform(apply_to.select("*", array_to_vector("features").alias("fv")))
    cols = [c for c in apply_to.columns if c != "features"]
    return out.select(*cols, vector_to_array("sv").alias("features"))


# ---------------------------------------------------------- encoding ------

def shared_label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """One dictionary over all ``cols``: codes 0.. ordered by (first column a
    value occurs in, value).  One scan stacks the columns; the dictionary is
    built by a distributed ranking and joined back, by a join that the planner
    chooses from the dictionary's bytes."""
    entries = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("value"))
                        for i, c in enumerate(cols)])
    stacked = df.select(F.explode(entries).alias("e")).select("e.c", "e.value").where(
        F.col("value").isNotNull())
    firsts = stacked.groupBy("value").agg(F.min("c").alias("c"))
    dictionary = index_rows(firsts, [F.col("c"), F.col("value")], name="code")
    out = df
    for c in cols:
        d = dictionary.select(F.col("value").alias(f"_{c}_v"), F.col("code").alias(f"{c}{suffix}"))
        out = out.join(d, F.col(c).cast("string") == F.col(f"_{c}_v"), "left").drop(f"_{c}_v")
    return out


# ------------------------------------------------------------ splits ------

def hash_split(df: DataFrame, key: str, weights: Sequence[float], seed: int) -> DataFrame:
    """Adds ``split`` = index of the weight band the row's md5 bucket falls in.

    Repeatable and partition-independent, unlike ``randomSplit``.
    """
    total = float(sum(weights))
    bucket = hash_bucket(key, seed, SPLIT_BUCKETS)
    expr = None
    upper = 0.0
    for i, w in enumerate(weights[:-1]):
        upper += w / total
        cut = int(round(upper * SPLIT_BUCKETS))
        expr = (F.when(bucket < cut, F.lit(i)) if expr is None
                else expr.when(bucket < cut, F.lit(i)))
    last = F.lit(len(weights) - 1)
    return df.withColumn("split", last if expr is None else expr.otherwise(last))


def random_permutation(ids: DataFrame, seed: int) -> DataFrame:
    """(id, position): positions 0.. in md5(id:seed) order."""
    keyed = ids.select("id", order_key("id", seed).alias("key"))
    return index_rows(keyed, [F.col("key"), F.col("id")], name="position").select("id", "position")


def one_random_per_class(df: DataFrame, id_col: str, class_col: str, seed: int) -> DataFrame:
    """One seeded-random row per class: the smallest numeric key of each."""
    keyed = df.select(F.col(class_col), F.col(id_col).alias("_id"),
                      numeric_key(id_col, seed).alias("_key"))
    return keyed.groupBy(class_col).agg(F.min_by("_id", "_key").alias(id_col))
