"""The few cell functions Spark has no expression for, as Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_form(c: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        known = {v: unicodedata.normalize(form, v) for v in set(values.dropna())}
        return pd.Series([known.get(v) if isinstance(v, str) else None for v in values], dtype=object)

    return normal(c)


def nfc(c: Column) -> Column:
    """Only cells with a non-ASCII sign can change."""
    return unicode_form(c, "NFC")


def similarity(a: Column, b: Column) -> Column:
    """Indel ratio: 2 * longest common subsequence / summed lengths."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def indel_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if ch == other else max(row[j], row[j - 1]))
    return 2 * row[-1] / (len(a) + len(b))
