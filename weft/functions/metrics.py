"""Similarities, divergences and thresholds as column expressions; string similarities that Spark lacks as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.batches import difflib_ratios, jaro_winkler_values


def threshold(spec: str):
    """"GT0.5" (strict), "GEQ0.5" (inclusive) or a bare number (strict) -> function of a column.

    Both sides are rounded to 12 digits, so that equal decimals are equal.
    """
    m = re.fullmatch(r"\s*(GT|GEQ)?\s*([0-9.]+)\s*", spec.upper())
    if not m:
        raise ValueError(f"no threshold: {spec!r}")
    least = round(float(m[2]), 12)
    return (lambda c: F.round(c, 12) >= least) if m[1] == "GEQ" else (lambda c: F.round(c, 12) > least)


def jaccard(a: Column, b: Column, overlap: Column) -> Column:
    """overlap / union from sizes; 1 for two empty sets."""
    union = a + b - overlap
    return F.when(union == overlap, F.lit(1.0)).otherwise(overlap / union)


def log_jaccard(a: Column, b: Column, overlap: Column) -> Column:
    """ln(overlap + 1) / ln(union + 1); 1 for equal sets."""
    union = a + b - overlap
    return F.when(union == overlap, F.lit(1.0)).otherwise(F.log(overlap + F.lit(1.0)) / F.log(union + F.lit(1.0)))


def array_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 0 if either is empty or null."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """array_jaccard of arrays without repeated values, with one look through them."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def precision(hits: Column, found: Column) -> Column:
    return F.coalesce(F.try_divide(hits, found), F.lit(0.0))


def recall(hits: Column, true: Column) -> Column:
    return F.coalesce(F.try_divide(hits, true), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - distance / longer length; null below least (the distance is not followed beyond what least allows)."""
    longer = F.greatest(F.length(a), F.length(b))
    d = F.levenshtein(a, b)
    sim = F.when(longer == 0, F.lit(1.0)).otherwise(1 - d / longer)
    return F.when((1 - F.abs(F.length(a) - F.length(b)) / F.greatest(longer, F.lit(1))) >= least, F.when(sim >= least, sim))


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 for two zeros, else 1 - |a - b| / larger magnitude, not below 0; null if either is null."""
    most = F.greatest(F.abs(a), F.abs(b))
    # greatest() passes over nulls, so that they are ruled out first.
    return F.when(a.isNotNull() & b.isNotNull(), F.when(most == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / most)))


def kl(p: Column, q: Column) -> Column:
    """A term of the Kullback-Leibler divergence; 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)


def jensen_shannon(p: Column, q: Column) -> Column:
    """A term of the Jensen-Shannon divergence (natural logarithm); to be summed over the outcomes."""
    m = (p + q) / 2
    return (kl(p, m) + kl(q, m)) / 2


def jaro(s: str, t: str) -> float:
    """Jaro similarity with a window of half the longer length less one."""
    if s == t:
        return 1.0 if s else 0.0
    n, m = len(s), len(t)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    mine = []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [t[j] for j in range(m) if used[j]]
    swaps = sum(a != b for a, b in zip(mine, theirs)) // 2
    k = len(mine)
    return (k / n + k / m + (k - swaps) / k) / 3


def jaro_winkler_value(s: str, t: str, scale: float = 0.1) -> float:
    """Jaro raised by the common prefix of up to four signs, always."""
    j = jaro(s, t)
    p = 0
    while p < min(4, len(s), len(t)) and s[p] == t[p]:
        p += 1
    return min(1.0, j + p * scale * (1 - j))


def _pairwise(fn):
    @F.arrow_udf(T.DoubleType())
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield fn(a, b)

    return apply


jaro_winkler = _pairwise(jaro_winkler_values)
difflib_ratio = _pairwise(difflib_ratios)


def text_similarity(a: Column, b: Column, words_a: Column, words_b: Column, overlap=array_jaccard) -> Column:
    """1 if equal, 0 if either is empty, else the larger of Jaro-Winkler and word Jaccard."""
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(jaro_winkler(a, b), overlap(words_a, words_b)))


# How well inferred types go together, for mapping columns and for comparing tables.
def type_compatibility(a: Column, b: Column, numbers: float = 0.8, with_string: float = 0.3, other: float = 0.5) -> Column:
    """1 for equal types, numbers for integer and float, with_string if one is a string, else other."""
    n = lambda c: c.isin("integer", "float")
    return F.when(a == b, F.lit(1.0)).when(n(a) & n(b), F.lit(numbers)).when((a == "string") | (b == "string"), F.lit(with_string)).otherwise(F.lit(other))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text's letter trigrams hashed to a unit vector of 256 places: the offline stand-in for a sentence encoder."""
    import zlib

    for s in batches:
        out = []
        for t in s:
            if t is None:
                out.append(None)
                continue
            p, v = f" {t.lower()} ", [0.0] * 256
            for i in range(len(p) - 2):
                v[zlib.crc32(p[i : i + 3].encode()) % 256] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        yield pd.Series(out)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, between 0 and 1; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))), F.lit(0.0))
