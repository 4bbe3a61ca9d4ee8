"""String distances that Spark lacks, as Arrow-batched functions.

Callers apply them to distinct values or pairs, never to all rows.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType

from sortament.session import ship_package


def _edits(a: str, b: str) -> int:
    """Edits of letters and swaps of neighbours, no part edited twice."""
    older, old, new = [0] * (len(b) + 1), list(range(len(b) + 1)), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new[0] = i
        for j, y in enumerate(b, 1):
            new[j] = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], older[j - 2] + 1)
        older, old, new = old, new, older
    return old[len(b)]


def _similarity(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    matched = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return min(1.0, 0.82 * matched + 0.15 * min(len(a), len(b)) / max(len(a), len(b)) + 0.03 * (a[:2] == b[:2]))


@pandas_udf(IntegerType())
def _edits_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@pandas_udf(DoubleType())
def _similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(StringType())
def _nfkc_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text], dtype="object")


def _ready(f, *columns: Column | str) -> Column:
    ship_package(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    return f(*columns)


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment distance; null if either is null."""
    return _ready(_edits_udf, a, b)


def fuzzy_similarity(a: Column | str, b: Column | str) -> Column:
    """Matched blocks, lengths and beginnings of two keys, from 0 to 1; 0 if one is empty."""
    return _ready(_similarity_udf, a, b)


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility composition, which no built-in function does."""
    return _ready(_nfkc_udf, text)


def acceptable_edits(distance: Column, longest: Column) -> Column:
    """One edit, or two where the longer word has nine letters or more."""
    return (distance <= 1) | ((distance == 2) & (longest >= 9))
