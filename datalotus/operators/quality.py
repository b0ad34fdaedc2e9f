"""Quality checks: every check of every column is one aggregate of a single pass.

`findings` gives a lazy DataFrame of one row per issue (check_name, severity,
column, count, percentage); nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalotus.functions import text as X
from datalotus.operators.stats import safe_corr

FINDING = "check_name string, severity string, column string, count bigint, percentage double"
_ID_NAME = re.compile(r"(?i)citizen|national.?id|thai.?id|id.?card|บัตรประชาชน")
_PHONE_NAME = re.compile(r"(?i)phone|tel|mobile|โทร")
_YEAR_NAME = re.compile(r"(?i)date|year|yr|ปี")


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _issue(name: str, severity: Column | str, column: str, count: Column, base: Column, when: Column | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    hit = count > 0 if when is None else when
    share = F.round(F.when(base > 0, 100.0 * count / base).otherwise(0.0), 2)
    row = F.struct(F.lit(name).alias("check_name"), level.alias("severity"), F.lit(column).alias("column"), count.cast("long").alias("count"), share.alias("percentage"))
    return F.when(F.coalesce(hit, F.lit(False)), row)


def normalization_issue(c: Column) -> Column:
    return X.tone_stacked(c) | X.duplicated_vowel(c) | X.combining_order_issue(c) | X.repeated_char_spam(c) | X.has_fullwidth(c) | X.several_tones(c)


def column_checks(df: DataFrame, name: str, *, thai: bool = True) -> list[Column]:
    """The column's issues as nullable structs over one aggregation."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    rows, held = F.count(F.lit(1)), F.count(c)
    lost = rows - held
    share = F.try_divide(lost, rows)
    severity = F.when(share >= 0.5, "critical").when(share > 0.05, "warning").otherwise("info")
    out = [
        _issue("missing", severity, name, lost, rows, (share >= 0.01) & (held > 0)),
        _issue("empty_column", "critical", name, lost, rows, (held == 0) & (rows > 0)),
        _issue("constant_column", "info", name, held, rows, (held > 0) & (F.min(c) == F.max(c))),
    ]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        out.append(_issue("infinite", "warning", name, _n(F.abs(c) == float("inf")), held))
    if isinstance(kind, T.StringType):
        numerals = _n(X.has_thai_digits(c))
        mixed = _n(c.rlike("[0-9]")) > 0
        blank = _n(X.is_placeholder(c))
        lone = _n(X.strip(c) == "-")
        unparsed = _n(X.is_number(c))
        out += [
            _issue("zero_width", "critical", name, _n(X.has_zero_width(c)), held),
            _issue("whitespace", "warning", name, _n(X.has_odd_space(c)), held),
            _issue("placeholder", "warning", name, F.when(lone < 0.01 * held, blank - lone).otherwise(blank), held),
            _issue("numeric_text", "info", name, unparsed, held, (unparsed > 0.8 * held)),
        ]
        if thai:
            out += [
                _issue("thai_numerals", F.when(mixed, "warning").otherwise("info"), name, numerals, held),
                _issue("normalization", "warning", name, _n(normalization_issue(c)), held),
                _issue("keyboard_layout", "warning", name, _n(X.keyboard_suspect(c)), held, (_n(X.thai_content_ratio(c) > 0.3) > 0.5 * held) & (_n(X.keyboard_suspect(c)) > 0)),
            ]
    if thai and _PHONE_NAME.search(name) and isinstance(kind, T.StringType):
        digits = F.regexp_replace(X.arabic_digits(c), "[^0-9]", "")
        out.append(_issue("phone_format", "warning", name, _n(F.length(digits).between(9, 12) & ~X.is_phone(c)), held))
    if thai and _ID_NAME.search(name):
        out.append(_issue("thai_id", F.when(_n(c.cast("string").rlike("^[0-9]{13}$") & ~X.valid_citizen_id(c)) > 0, "critical").otherwise("warning"), name, _n(~X.valid_citizen_id(c)), rows))
    if thai and _YEAR_NAME.search(name) and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        era, common = _n(X.buddhist_year(c).isNotNull()), _n(c.cast("string").rlike("(?<![0-9])(19|20)[0-9]{2}(?![0-9])"))
        out.append(_issue("buddhist_era", F.when(common > 0, "critical").otherwise("warning"), name, era, held))
    return out


def findings(df: DataFrame, columns: list[str] | None = None, *, thai: bool = True) -> DataFrame:
    names = columns or df.columns
    wide = df.agg(F.array_compact(F.array(*[x for n in names for x in column_checks(df, n, thai=thai)])).alias("all"))
    return wide.select(F.inline("all"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that have an equal (all of them), rows beyond the first, and groups."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in columns or df.columns]).agg(F.count(F.lit(1)).alias("__rows")).select("__rows").where("__rows > 1")
    return groups.agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias("in_groups"), F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("beyond_first"), F.count(F.lit(1)).alias("groups"))


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, cells, missing cells and their share, rows beyond the first."""
    lost = F.lit(0)
    for c in df.columns:
        lost = lost + F.count_if(F.col(f"`{c}`").isNull())
    base = df.agg(F.count(F.lit(1)).alias("rows"), lost.alias("missing"))
    k = len(df.columns)
    extra = duplicate_rows(df).select("beyond_first")
    return base.join(F.broadcast(extra)).select("rows", F.lit(k).cast("long").alias("columns"), (F.col("rows") * k).alias("cells"), "missing", F.round(F.when(F.col("rows") > 0, 100.0 * F.col("missing") / (F.col("rows") * k)).otherwise(0.0), 4).alias("missing_pct"), F.col("beyond_first").alias("duplicates"))  # one row is broadcast


WEIGHTS = {"critical": 3.0, "warning": 1.0, "info": 0.2}


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def quality_score(found: DataFrame, n_columns: int) -> DataFrame:
    """100 * (1 - weighted shares / columns), half-even, with its grade and counts."""
    weight = F.lit(0.0)
    for level, w in WEIGHTS.items():
        weight = F.when(F.col("severity") == level, w).otherwise(weight)
    loss = F.coalesce(F.sum(weight * F.col("percentage") / 100), F.lit(0.0)) / max(1, n_columns)
    counts = [F.count_if(F.col("severity") == level).alias(level) for level in WEIGHTS]
    done = found.agg(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - loss))), 1).alias("score"), *counts)
    return done.withColumn("grade", grade(F.col("score")))


def fixed_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("check_name", "column").distinct().join(after.select("check_name", "column").distinct(), ["check_name", "column"], "left_anti")


def script_composition(df: DataFrame, name: str) -> DataFrame:
    """Character-weighted shares of scripts in a column."""
    c = F.col(f"`{name}`")
    total = F.sum(F.length(c))
    share = lambda p: F.round(F.sum(F.regexp_count(c, F.lit(p))) / total, 6)
    return df.agg(share("[฀-๏๚-๿]").alias("thai"), share("[A-Za-z]").alias("latin"), share("[0-9]").alias("digit"), share("\\s").alias("whitespace"))


def missing_mechanism(df: DataFrame, columns: list[str]) -> DataFrame:
    """MCAR, MAR or MNAR_likely from null-indicator correlations (one pass)."""
    null = {c: F.col(f"`{c}`").isNull().cast("double") for c in columns}
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}

    co = [F.abs(safe_corr(null[a], null[b])) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cross = [F.when(F.count(value[b]) >= 30, F.abs(safe_corr(null[a], value[b]))) for a in columns for b in columns if a != b]
    rate = [F.avg(null[c]) for c in columns]
    best = lambda cs: F.array_max(F.array(*[F.coalesce(x, F.lit(0.0)) for x in cs])) if cs else F.lit(0.0)
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.round(best(co), 6).alias("co_missing"), F.round(best(cross), 6).alias("dependence"), F.array_min(F.array(*rate)).alias("least"), F.array_max(F.array(*rate)).alias("most"))
    mnar = (F.col("least") > 0) & (F.col("most") > 0.5)
    return wide.select("n", "co_missing", "dependence", F.when((F.col("n") < 50) | F.lit(len(columns) < 3), "undetermined").when((F.col("dependence") > 0.2) & mnar, "MNAR_likely").when(mnar, "MNAR_likely").when((F.col("dependence") > 0.2) | (F.col("co_missing") > 0.3), "MAR").otherwise("MCAR").alias("mechanism"))


def privacy_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of phone numbers, e-mail addresses, citizen ids, IP addresses by column."""
    patterns = {"phone": "(?<![0-9])(?:\\+66|0)[0-9]{8,9}(?![0-9])", "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "citizen_id": "(?<![0-9])[0-9]{13}(?![0-9])", "ip": "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9.])"}
    rows = [F.struct(F.lit(c).alias("column"), *[F.coalesce(F.sum(F.regexp_count(F.col(f"`{c}`"), F.lit(p))), F.lit(0)).cast("long").alias(k) for k, p in patterns.items()]) for c in columns]
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def compare_scores(before: DataFrame, after: DataFrame, columns: Mapping[str, int] | int) -> DataFrame:
    n = columns if isinstance(columns, int) else len(columns)
    a, b = quality_score(before, n), quality_score(after, n)
    return a.select(F.col("score").alias("before"), F.col("grade").alias("grade_before")).join(F.broadcast(b.select(F.col("score").alias("after"), F.col("grade").alias("grade_after"))))  # one row each
