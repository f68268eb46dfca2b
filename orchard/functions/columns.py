"""Column expressions used by the operators (JVM-side, codegen friendly).

Every function returns a ``pyspark.sql.Column``; none runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class used to split delimited text.  Spelled
# out so that Spark (Java regex) and DuckDB (RE2) agree on it.
WHITESPACE = "[ \\t\\n\\r\\f\\x0B]+"
SCORE_DIGITS = 9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text -----

def tokens(text, pattern: str = WHITESPACE) -> Column:
    """Split on a delimiter pattern and drop empty pieces (strip + split)."""
    return F.filter(F.split(_col(text), pattern), lambda t: t != F.lit(""))


def split_fixed(text, delimiter: str = " ") -> Column:
    """Split on one literal delimiter, keeping empty pieces (no trim)."""
    import re
    return F.split(_col(text), re.escape(delimiter))


def to_double_array(arr) -> Column:
    """Token array to ``array<double>``; unparsable tokens become NULL."""
    return F.transform(_col(arr), lambda t: t.try_cast("double"))


def strip_quotes(text) -> Column:
    """Remove surrounding double quotes from a token (``"1"`` -> ``1``)."""
    return F.regexp_replace(_col(text), '^"|"$', "")


# -------------------------------------------------------------- labels -----

def recode_sign(label) -> Column:
    """Label -1 -> 0.0, anything else -> 1.0."""
    return F.when(_col(label) == -1, F.lit(0.0)).otherwise(F.lit(1.0))


def recode_code(label, zero_code) -> Column:
    """Label equal to ``zero_code`` -> 0.0, anything else -> 1.0."""
    return F.when(_col(label) == F.lit(zero_code), F.lit(0.0)).otherwise(F.lit(1.0))


# ------------------------------------------------------------- vectors -----

def as_double_array(c) -> Column:
    return _col(c).cast("array<double>")


def sum_squares(arr) -> Column:
    return F.aggregate(_col(arr), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(arr) -> Column:
    return F.sqrt(sum_squares(arr))


def unit_vector(arr, norm=None) -> Column:
    """x / ||x||; a zero vector stays a vector of zeros.

    Pass ``norm`` as a column computed in an earlier projection: inside the
    lambda an inline norm would be re-evaluated for every element (O(d^2)).
    """
    n = l2_norm(arr) if norm is None else _col(norm)
    return F.transform(_col(arr), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


# ------------------------------------------------------ random ordering ----

def order_key(id_col, seed) -> Column:
    """Repeatable, partition-independent random key: md5 of ``id:seed``."""
    return F.md5(F.concat_ws(":", _col(id_col).cast("string"), F.lit(str(seed))))


def numeric_key(id_col, seed) -> Column:
    """The first 60 bits of the md5 key as a BIGINT, in the same order; a
    fixed-width key keeps minima in hash aggregates."""
    return F.conv(F.substring(order_key(id_col, seed), 1, 15), 16, 10).cast("bigint")


def hash_bucket(id_col, seed, buckets: int) -> Column:
    """Integer bucket in [0, buckets) from the first 32 bits of the md5 key."""
    head = F.conv(F.substring(order_key(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets)).cast("int")


# ---------------------------------------------------- committee scores -----

def class0_share(sum_votes, n_votes) -> Column:
    """p0 = 1 - (votes for class 1) / (committee size)."""
    return F.lit(1.0) - F.try_divide(_col(sum_votes).cast("double"), _col(n_votes).cast("double"))


def margin(p0) -> Column:
    """Distance of the class-0 share from one half; small = uncertain."""
    return F.abs(F.lit(0.5) - _col(p0))


def half_entropy(p0) -> Column:
    """-p0 * log2(p0), with 0 * log2(0) defined as 0."""
    p = _col(p0)
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def binary_entropy(p0) -> Column:
    """Full binary entropy of the class-0 share."""
    return half_entropy(p0) + half_entropy(F.lit(1.0) - _col(p0))


def binary_sd(sum_votes, n_votes) -> Column:
    """Sample SD (n-1) of n binary votes of which ``sum_votes`` are 1:
    ones times zeros over n (n - 1) is the variance of 0/1 values."""
    ones = _col(sum_votes).cast("double")
    n = _col(n_votes).cast("double")
    return F.when(n > 1, F.sqrt(ones * (n - ones) / (n * (n - 1))))


def score_key(score) -> Column:
    """Score rounded before sorting so float noise cannot reorder ties."""
    return F.round(_col(score), SCORE_DIGITS)
