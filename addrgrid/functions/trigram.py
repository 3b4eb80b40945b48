"""Trigram similarity (H14) as native higher-order expressions.

Semantics of the trigram model used by the reference database extension:
lower-case the text, split it into words at every non-alphanumeric character,
pad each word with two spaces in front and one behind, take every 3-character
window, keep the distinct set. similarity = |A n B| / |A u B| (0 when either
set is empty), computed in single precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def trigrams(c) -> Column:
    """Distinct padded trigrams of a text, ``array<string>``."""
    words = F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def gram_similarity(ga, gb) -> Column:
    """Jaccard of two distinct-gram arrays as float (0 if either is empty)."""
    a, b = _c(ga), _c(gb)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0).cast("float")).otherwise(
        (inter / union).cast("float"))


def similarity(a, b) -> Column:
    """similarity(a, b) of two texts."""
    return gram_similarity(trigrams(a), trigrams(b))


def above_threshold(sim_float, t: float = 0.6) -> Column:
    """``similarity(...) > t``: the float is widened to double before the test,
    so e.g. exactly 3/5 passes 0.6."""
    return _c(sim_float).cast("double") > F.lit(t)
