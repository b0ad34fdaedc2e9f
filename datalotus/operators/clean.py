"""Cleaning: column operations by name, a frame pipeline with audit, dedup,
missing values and imputation.

Operations are pure column functions. `audit` counts what they change in one pass;
`clean` runs a fixed number of jobs whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from datalotus.functions import text as X
from datalotus.functions.arrow import nfc
from datalotus.operators.stats import median, quantiles

OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "encoding": X.repair_mojibake, "zwspace": X.strip_zero_width, "whitespace": X.squeeze, "unicode": nfc, "fullwidth": X.fold_fullwidth, "tonemarks": X.fix_tone_stacking,
    "repeat": X.cap_repeats, "numerals": X.arabic_digits, "phone": X.normalize_phone, "dates": X.normalize_date, "buddhist_era": X.to_common_era, "keyboard_layout": X.retype_thai,
}
DEFAULT = ("encoding", "zwspace", "whitespace", "fullwidth", "numerals")


def available_operations() -> list[str]:
    return list(OPERATIONS)


def clean_text(c: Column, operations: Sequence[str] = DEFAULT) -> Column:
    for name in operations:
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name!r}")
        c = OPERATIONS[name](c)
    return c


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def audit(df: DataFrame, columns: Sequence[str] | None = None, operations: Sequence[str] = DEFAULT) -> DataFrame:
    """operation, column, rows_affected, example_before, example_after (non-zero only)."""
    rows = []
    for name in columns or _text_columns(df):
        old = F.col(f"`{name}`")
        for op in operations:
            new = OPERATIONS[op](old)
            hit = F.coalesce(new != old, F.lit(False))
            rows.append(F.struct(F.lit(op).alias("operation"), F.lit(name).alias("column"), F.count_if(hit).alias("rows_affected"), F.min(F.when(hit, F.struct(old.alias("b"), new.alias("a")))).alias("e")))
            old = new
    wide = df.agg(F.array(*rows).alias("all")) if rows else df.limit(0).agg(F.array().cast("array<struct<operation:string,column:string,rows_affected:bigint,e:struct<b:string,a:string>>>").alias("all"))
    return wide.select(F.inline("all")).where("rows_affected > 0").select("operation", "column", "rows_affected", F.col("e.b").alias("example_before"), F.col("e.a").alias("example_after"))


def coerce_numeric(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> DataFrame:
    """Text columns of which at least `share` of the real values parse become double;
    placeholders become null. Others stay. One aggregate decides for all columns."""
    real = {c: F.when(~X.is_placeholder(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in columns}
    if not columns:
        return df
    facts = df.agg(*[F.count(real[c]).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count_if(X.is_number(real[c])).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        n, p = facts[f"n{i}"], facts[f"p{i}"]
        if n and p == n:
            out[c] = X.to_number(real[c])
        elif n and p >= share * n:  # some don't parse: keep them, numbers stand beside
            out[c] = real[c]
            out[f"{c}_number"] = X.to_number(real[c])
    return df.withColumns(out) if out else df


def normalize_currency(df: DataFrame, column: str) -> DataFrame:
    """Amount columns to double, if a tenth has a currency mark and half are amounts."""
    c = F.col(f"`{column}`")
    f = df.agg(F.count(c).alias("n"), F.count_if(c.rlike(X.CURRENCY)).alias("marked"), F.count(X.money(c)).alias("amounts")).first()
    fires = f.n and f.marked >= 0.1 * f.n and f.amounts >= 0.5 * f.n and median(df, F.length(c), "long").first().long < 25
    return df.withColumn(column, X.money(c)) if fires else df


def drop_duplicates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Keep the first of equal rows; rows that are null throughout always stay."""
    names = [c for c in df.columns if c != order_by]
    cols = [F.col(f"`{c}`") for c in names]
    empty = F.lit(True)
    for c in cols:
        empty = empty & c.isNull()
    if order_by is None:
        return df.where(~empty).dropDuplicates(names).unionByName(df.where(empty))
    w = Window.partitionBy(*cols, F.when(empty, F.col(f"`{order_by}`"))).orderBy(F.col(f"`{order_by}`"))
    return df.withColumn("__first", F.row_number().over(w)).where(F.col("__first") == 1).drop("__first")


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """flag (nothing is filled), drop, median, mode (ties: the smallest), unknown."""
    cols = {c: F.col(f"`{c}`") for c in columns}
    if strategy == "flag":
        return df
    if strategy == "drop":
        return df.na.drop(subset=list(columns))
    if strategy == "unknown":
        return df.withColumns({c: F.coalesce(x, F.lit("unknown")) for c, x in cols.items() if isinstance(df.schema[c].dataType, T.StringType)})
    if strategy == "median":
        numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
        m = {r.column: r.q[0] for r in quantiles(df, {c: cols[c] for c in numeric}, [0.5]).collect()} if numeric else {}
        return df.withColumns({c: F.coalesce(cols[c].cast("double"), F.lit(m.get(c))) for c in numeric})
    if strategy == "mode":
        modes = {}
        for c in columns:
            top = df.where(cols[c].isNotNull()).groupBy(cols[c].alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "v").limit(1).collect()
            modes |= {c: top[0].v} if top else {}
        return df.withColumns({c: F.coalesce(cols[c], F.lit(v)) for c, v in modes.items()})
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, columns: Sequence[str], rounds: int = 10, train_rows: int = 10_000, ridge: float = 1.0) -> DataFrame:
    """Chained ridge regressions, fitted on a bounded sample of rows on the driver
    and applied as linear column expressions to all rows."""
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    stats = df.agg(*[F.avg(v).alias(f"m_{i}") for i, v in enumerate(x.values())], *[F.stddev_pop(v).alias(f"s_{i}") for i, v in enumerate(x.values())]).first()
    mean = np.array([stats[f"m_{i}"] or 0.0 for i in range(len(columns))])
    dev = np.array([stats[f"s_{i}"] or 1.0 for i in range(len(columns))])
    dev[dev == 0] = 1.0
    # by a hash of a row's own number, so that equal rows are drawn one by one
    numbered = df.select(*[v.alias(f"x_{i}") for i, v in enumerate(x.values())], F.monotonically_increasing_id().alias("row"))
    rows = numbered.orderBy(F.xxhash64("row")).limit(train_rows).collect()
    data = (np.array([[np.nan if v is None else v for v in r[:-1]] for r in rows], float).reshape(-1, len(columns)) - mean) / dev
    lost, filled = np.isnan(data), np.nan_to_num(data)
    weights = np.zeros((len(columns), len(columns)))
    for _ in range(rounds):
        for i in range(len(columns)):
            seen, others = ~lost[:, i], [j for j in range(len(columns)) if j != i]
            if seen.sum() < 2 or not others:
                continue
            a = filled[seen][:, others]
            weights[i, others] = np.linalg.solve(a.T @ a + ridge * np.eye(len(others)), a.T @ filled[seen, i])
            filled[~seen, i] = filled[~seen][:, others] @ weights[i, others]
    scaled = {c: F.coalesce((x[c] - float(mean[i])) / float(dev[i]), F.lit(0.0)) for i, c in enumerate(columns)}
    new = {}
    for i, c in enumerate(columns):
        guess = F.lit(0.0)
        for j, other in enumerate(columns):
            if j != i:
                guess = guess + float(weights[i, j]) * scaled[other]
        new[c] = F.coalesce(x[c], guess * float(dev[i]) + float(mean[i]))
    return df.withColumns(new)


def plan_cleaning(df: DataFrame) -> DataFrame:
    """action, rows: what a cleaning run would touch (one pass over text columns)."""
    names = _text_columns(df)
    tests = {"zwspace": X.has_zero_width, "numerals": X.has_thai_digits, "whitespace": X.has_odd_space, "encoding": lambda c: X.mojibake_kind(c).isNotNull(), "buddhist_era": lambda c: X.buddhist_year(c).isNotNull(), "placeholders": X.is_placeholder}
    rows = []
    for action, test in tests.items():
        n = F.lit(0).cast("long")
        for c in names:
            n = n + F.count_if(F.coalesce(test(F.col(f"`{c}`")), F.lit(False)))
        rows.append(F.struct(F.lit(action).alias("action"), n.alias("rows")))
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all")).where("rows > 0")


def downcast(df: DataFrame) -> DataFrame:
    """Integers in the smallest type that holds their range (one aggregate)."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    if not whole:
        return df
    r = df.agg(*[F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(whole)], *[F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(whole)]).first()
    new = {}
    for i, c in enumerate(whole):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is not None:
            new[c] = F.col(f"`{c}`").cast(next(t for t, b in (("byte", 7), ("short", 15), ("int", 31), ("long", 63)) if -(1 << b) <= lo and hi < 1 << b))
    return df.withColumns(new)


def clean(df: DataFrame, *, operations: Sequence[str] = DEFAULT, fix_dates: bool = True, handle_missing: str = "flag", remove_duplicates: bool = True, coerce: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cleaned frame, audit). Text operations, dates, numeric coercion with a guard
    (a column that would lose over 30% of its values stays), duplicates, missing."""
    names = _text_columns(df)
    log = audit(df, names, operations)
    out = df.withColumns({c: clean_text(F.col(f"`{c}`"), operations) for c in names}) if names else df
    if fix_dates and names:
        share = out.agg(*[F.count_if(X.is_date_like(F.col(f"`{c}`"))).alias(f"d{i}") for i, c in enumerate(names)], *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)]).first()
        dated = [c for i, c in enumerate(names) if share[f"n{i}"] and share[f"d{i}"] > 0.5 * share[f"n{i}"]]
        out = out.withColumns({c: X.normalize_date(F.col(f"`{c}`")) for c in dated}) if dated else out
    if coerce:
        loose = [c for c in _text_columns(out) if not any(k in c.lower() for k in ("phone", "tel", "citizen", "zip", "postal")) and not c.lower().endswith("id")]
        out = coerce_numeric(out, loose, 0.7)
    if remove_duplicates:
        out = drop_duplicates(out)
    return fill_values(out, out.columns, handle_missing), log
