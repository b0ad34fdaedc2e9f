"""The reductions behind charts: a few numbers each, computed on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.operators import stats, timeseries


def box(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, q1, median, q3, low, high (whiskers), outliers."""
    q = stats.quantiles(df, {c: F.col(f"`{c}`") for c in columns}, [0.25, 0.5, 0.75])
    wide = {r.column: r.q for r in q.collect()}
    out = []
    for c in columns:
        v, (a, m, b) = F.col(f"`{c}`").cast("double"), wide.get(c) or (None, None, None)
        if a is None:
            continue
        lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
        inside = v.between(lo, hi)
        out.append(F.struct(F.lit(c).alias("column"), F.lit(a).alias("q1"), F.lit(m).alias("median"), F.lit(b).alias("q3"), F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outliers")))
    return df.agg(F.array(*out).alias("all")).select(F.inline("all"))


def missing_matrix(df: DataFrame, rows: int = 1000) -> DataFrame:
    from datalotus.sources.files import sample_rows

    return sample_rows(df, rows).select(*[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in df.columns])


def missing_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flags = df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(c) for c in columns])
    return stats.correlation_pairs(flags, columns)


def category_bar(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return stats.top_values(df, column, k)


def sunburst(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent values and the rest as 'other'."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    r = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    return r.groupBy(F.when(F.col("r") <= k, F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))


def stride(series: DataFrame, points: int = 5000) -> DataFrame:
    p = timeseries.positions(series)
    step = p.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / points)).alias("k"))
    return p.join(F.broadcast(step)).where(F.col("pos") % F.col("k") == 0).drop("k")  # one row


def acf_plot(series: DataFrame, lags: int = 40) -> DataFrame:
    a = timeseries.acf(series, list(range(1, lags + 1)))
    return a.withColumn("bound", F.lit(1.96) / F.sqrt(F.col("n") + F.col("lag")))


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on a grid, from a histogram of 512 bins."""
    v = F.col(f"`{column}`").cast("double")
    m = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    bins = stats.histogram(df, column, 512)
    grid = df.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("t"))
    g = grid.join(F.broadcast(m)).withColumn("x", F.col("lo") + F.col("t") * (F.col("hi") - F.col("lo"))).withColumn("h", 1.06 * F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    both = g.join(F.broadcast(bins.withColumnRenamed("n", "c")))  # 200 grid points by 512 bins
    z = (F.col("x") - F.col("lo") - (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / 512) / F.col("h")
    return both.groupBy("x").agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / F.max(F.col("n") * F.col("h") * 2.5066282746310002)).alias("density")).orderBy("x")


def qq(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Empirical quantiles at (i - 0.5)/n against those of a normal."""
    from statistics import NormalDist

    at = [(i + 0.5) / points for i in range(points)]
    q = df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), at, 10_000).alias("q"))
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in at])
    return q.select(F.inline(F.arrays_zip(normal.alias("theoretical"), F.col("q").alias("observed"))))
