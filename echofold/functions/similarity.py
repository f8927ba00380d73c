"""Similarity of pairs as Column expressions; only the sequence ratio needs Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FIELDS = {"purpose": 0.35, "calls": 0.15, "data": 0.15, "domain": 0.15, "operations": 0.20}


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as C and SQL engines do: scaled, halves away from zero, scaled back."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return np.where(np.abs(y - whole) >= 0.5, whole + np.sign(y), whole) / 10.0**digits


def rounded(x: Column, digits: int = 4) -> Column:
    """`half_up` of a column. Spark's own `round` goes by the decimal digits of a number and differs in halves."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def sequence_ratio(autojunk: bool = True):
    """Arrow UDF (a, b) -> matching-block ratio of two normalised texts; 0 if either is empty."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y, autojunk).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])

    return ratio


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def close_levenshtein(a: Column, b: Column, least: float) -> Column:
    """levenshtein_ratio where it reaches `least`, else null; distances beyond that are not worked out."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - least) + 1e-9).cast("int")
    d = F.call_function("levenshtein", a, b, most)
    return F.when(F.abs(F.length(a) - F.length(b)) <= most, F.when(longest == 0, F.lit(1.0)).when(d >= 0, 1 - d / longest))


def signature_match():
    """Arrow UDF (a, b) -> share of equal places (8 bytes each) of two MinHash signatures; 0 for unequal lengths."""

    @F.pandas_udf(DoubleType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(x, np.int64) == np.frombuffer(y, np.int64)).mean()) if x and y and len(x) == len(y) else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    return same


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def intent_score(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Weighted Dice over the profile fields, with bonuses for shared purpose and operations, at most 1."""
    score = F.lit(0.0)
    for name, weight in FIELDS.items():
        a, b = left[name], right[name]
        total = F.size(a) + F.size(b)
        score = score + F.when(total > 0, weight * 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)
    bonus = lambda name, x: F.when(F.size(F.array_intersect(left[name], right[name])) >= 2, x).otherwise(0.0)
    return F.least(F.lit(1.0), score + bonus("purpose", 0.10) + bonus("operations", 0.05))


def evidence(left: dict[str, Column], right: dict[str, Column]) -> Column:
    shared = [F.sort_array(F.array_intersect(left[n], right[n])).alias(n) for n in FIELDS]
    return F.struct(F.array(left["language"], right["language"]).alias("languages"), F.round(intent_score(left, right), 3).alias("intent_similarity"), F.struct(*shared).alias("shared"))


def map_similarity(a: Column, b: Column) -> Column:
    """Both empty 1, one empty 0, else the mean of key Jaccard and of the values' similarity on shared keys."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    values = F.aggregate(F.transform(keys, lambda k: levenshtein_ratio(F.element_at(a, k), F.element_at(b, k))), F.lit(0.0), lambda s, v: s + v)
    mean = F.when(F.size(keys) > 0, values / F.size(keys)).otherwise(0.0)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise((jaccard(F.map_keys(a), F.map_keys(b)) + mean) / 2)
    )


def component_similarity(same_structure: Column, attributes: Column, text: Column, styles: Column) -> Column:
    """Of two components of one type: .5, and .3, .1, .1, .1 for what they share."""
    return F.least(F.lit(1.0), 0.5 + F.when(same_structure, 0.3).otherwise(0.0) + 0.1 * attributes + 0.1 * text + 0.1 * styles)


def universal_similarity(same_type: Column, same_family: Column, same_structure: Column, patterns: Column, metadata: Column) -> Column:
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return one(same_type, 0.3) + one(same_family, 0.2) + one(same_structure, 0.3) + 0.1 * patterns + 0.1 * metadata


def group_match_score(files: Column, same_hash: Column, same_name: Column, gap: Column) -> Column:
    """Score of two groups of successive runs: shared files, hash, name and closeness of similarity."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    return files + one(same_hash, 1.0) + one(same_name, 0.5) + F.greatest(F.lit(0.0), 1 - gap)


def groups_match(same_type: Column, gap: Column, files: Column) -> Column:
    return same_type & (gap <= 0.1) & (files >= 0.5)
