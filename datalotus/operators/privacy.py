"""Privacy: token anonymisation, synthetic rows, noisy summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CITIZEN = "(?<![0-9])[0-9]{13}(?![0-9])"
PHONE = "(?<![0-9])(?:\\+66|0)[0-9]{8,9}(?![0-9])"


def token_map(df: DataFrame, columns: Sequence[str], pattern: str, label: str) -> DataFrame:
    """value, token: one numbered token per distinct match in any of the columns."""
    found = None
    for c in columns:
        one = df.select(F.explode(F.regexp_extract_all(F.col(f"`{c}`"), F.lit(pattern), F.lit(0))).alias("value"))
        found = one if found is None else found.unionByName(one)
    d = found.distinct()
    return d.select("value", F.concat(F.lit(f"[{label}_"), F.row_number().over(Window.orderBy("value")).cast("string"), F.lit("]")).alias("token"))


def _token(label: str, key: str) -> Callable[[Column], Column]:
    """128 bits of a hash that nobody without the key can recompute from a guess."""
    inner = lambda m: F.sha2(F.concat(F.lit(key), F.lit(":"), m).cast("binary"), 256)
    outer = lambda m: F.substring(F.sha2(F.concat(F.lit(key), F.lit(":"), inner(m)).cast("binary"), 256), 1, 32)
    # letters only, so that a later pattern finds no number in a token
    return lambda m: F.concat(F.lit(f"[{label}_"), F.translate(outer(m), "0123456789", "ghijklmnop"), F.lit("]"))


def anonymize(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Citizen ids, then phone numbers, replaced by stable tokens; nulls stay null.

    Tokens are hashes of the value keyed by the caller's secret `key`, so no map is joined to the rows and the
    same value has one token in every column and partition.
    """
    out = df
    for pattern, label in ((CITIZEN, "ID"), (PHONE, "PHONE")):
        for c in columns:
            x = F.col(f"`{c}`")
            found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
            new = F.transform(found, _token(label, key))
            pieces = F.split(x, pattern, -1)
            out = out.withColumn(c, F.when(F.size(found) > 0, F.array_join(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, t: F.concat(p, t)), "")).otherwise(x))
    return out


def _numeric(df: DataFrame, c: str, rate: float, seed: int) -> Column:
    v = F.col(f"`{c}`").cast("double")
    grid = [i / 100 for i in range(101)]
    q = df.agg(F.percentile_approx(v, grid, 10_000).alias("q")).first().q
    if not q:
        return F.lit(None).cast("double")
    u = F.rand(seed) * 100
    at = F.least(F.floor(u), F.lit(99)).cast("int")
    points = F.array(*[F.lit(float(x)) for x in q])
    lo, hi = F.element_at(points, at + 1), F.element_at(points, at + 2)
    return F.when(F.rand(seed + 1) >= rate, lo + (u - at) * (hi - lo))


def synthetic(df: DataFrame, rows: int | None = None, seed: int = 42, levels: int = 50) -> DataFrame:
    """Rows drawn column by column: quantile interpolation for numbers, shares for
    categories, uniform times, placeholders for free text. Null rates are kept."""
    spark = df.sparkSession
    n = df.count()
    base = spark.range(min(rows or n, 10_000) if rows is None else rows)
    nulls = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(df.columns)]).first()
    new = []
    for i, f in enumerate(df.schema.fields):
        rate, s, c = nulls[f"r{i}"] or 0.0, seed + 10 * i, F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            x = _numeric(df, f.name, rate, s)
            x = F.round(x).cast(f.dataType) if not isinstance(f.dataType, (T.DoubleType, T.FloatType)) else x.cast(f.dataType)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            r = df.agg(F.min(F.unix_seconds(c.cast("timestamp"))).alias("a"), F.max(F.unix_seconds(c.cast("timestamp"))).alias("b")).first()
            x = F.lit(None).cast(f.dataType) if r.a is None else F.when(F.rand(s + 1) >= rate, F.timestamp_seconds(F.lit(r.a) + F.floor(F.rand(s) * (r.b - r.a + 1)))).cast(f.dataType)
        else:
            top = df.where(c.isNotNull()).groupBy(c.cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(levels + 1).collect()
            if 0 < len(top) <= levels:
                edges = np.cumsum([t.n for t in top]) / sum(t.n for t in top)
                u = F.rand(s)
                x = F.lit(top[-1].v)
                for edge, t in reversed(list(zip(edges, top, strict=True))):
                    x = F.when(u < float(edge), t.v).otherwise(x)
            else:
                m = df.agg(F.avg(F.length(c.cast("string"))).alias("m"), F.stddev_pop(F.length(c.cast("string"))).alias("s")).first()
                x = F.concat(F.lit("<text_"), F.greatest(F.lit(1), F.round(F.randn(s) * (m.s or 0.0) + (m.m or 0.0))).cast("int").cast("string"), F.lit("chars>"))
            x = F.when(F.rand(s + 1) >= rate, x)
        new.append(x.alias(f.name))
    return base.select(*new)


def noisy_summary(summary: dict[str, float], epsilon: float, seed: int | None = None) -> dict[str, float]:
    """Laplace noise of scale 1/epsilon on each number. The unit sensitivity is an
    assumption, so this is no formal guarantee."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    rng = np.random.default_rng(seed)
    return {k: v + rng.laplace(0, 1 / epsilon) for k, v in summary.items() if k not in ("std", "q1", "q3", "median") and v is not None and math.isfinite(v)}


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
