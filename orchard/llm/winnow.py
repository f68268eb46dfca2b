"""Winnowing in DataFrame functions: k-gram hashes, window minima, positions.

A fingerprint is one BIGINT: the upper bits hold a k-gram's hash, the lower
``POSITION_BITS`` the distance of its position from the largest one.  Smaller
means a smaller hash and, at equal hashes, a position further right, so the
plain minimum over a window is the rightmost minimal k-gram, and equal values
are the same k-gram at the same position.  Windows at the end of a text (and
texts shorter than a window) use the k-grams they have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION_BITS = 26
_LAST = (1 << POSITION_BITS) - 1


def gram_codes(words: Column, k: int) -> Column:
    """Hash and position of every run of ``k`` words; a text with fewer words
    has one run of all of them, one without words none."""
    n = F.size(words)

    def code(h, i):
        return h.bitwiseAND(F.lit(~_LAST)).bitwiseOR(F.lit(_LAST).cast("long") - i.cast("long"))

    runs = F.transform(
        F.slice(words, 1, F.greatest(n - (k - 1), F.lit(1))),
        lambda x, i: code(F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)]), i))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def window_minima(codes: Column, width: int) -> Column:
    """Minimum of each window that starts at a position (``width`` codes)."""
    return F.transform(codes, lambda x, i: F.least(x, *[F.get(codes, i + j) for j in range(1, width)])) \
        if width > 1 else codes


def hash_of(code: Column) -> Column:
    return F.shiftright(code, POSITION_BITS)


def position_of(code: Column) -> Column:
    return F.lit(_LAST).cast("long") - code.bitwiseAND(F.lit(_LAST).cast("long"))
