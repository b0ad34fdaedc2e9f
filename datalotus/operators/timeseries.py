"""Time-series analytics over one ordered column.

An ordered window without partition runs in one task; series are therefore
aggregated to time buckets first, whose number depends on the time span and not
on the rows. Functions take a DataFrame with `ts` and `y`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.operators.stats import safe_corr

PERIODS = (7, 12, 24, 30, 52, 365)
NATURAL = {"H": 24, "D": 7, "W": 52, "M": 12}


def bucketed(df: DataFrame, ts: str, value: str, grain: str = "day", how: str = "avg") -> DataFrame:
    f = {"avg": F.avg, "sum": F.sum, "count": F.count}[how]
    return df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(F.date_trunc(grain, F.col(ts)).alias("ts")).agg(f(F.col(value)).cast("double").alias("y"))


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def frequency(series: DataFrame, ts: str = "ts") -> DataFrame:
    """Median positive step and its class: H, D, W, M or irregular."""
    step = series.select(_seconds(F.col(ts)).alias("s")).distinct().select((F.col("s") - F.lag("s").over(Window.orderBy("s"))).alias("d")).where("d > 0")
    m = F.col("median_seconds")
    return step.agg(F.median("d").alias("median_seconds")).withColumn("freq", F.when(m.between(3000, 5400), "H").when(m.between(0.8 * 86400, 1.2 * 86400), "D").when(m.between(6 * 86400, 8 * 86400), "W").when(m.between(27 * 86400, 32 * 86400), "M").otherwise("irregular"))


def gaps(series: DataFrame, ts: str = "ts", factor: float = 1.5) -> DataFrame:
    """Steps over `factor` times the median: after, before, seconds."""
    w = Window.orderBy("ts")
    steps = series.select(F.col(ts).alias("ts")).distinct().select(F.lag("ts").over(w).alias("after"), F.col("ts").alias("before"), (_seconds(F.col("ts")) - F.lag(_seconds(F.col("ts"))).over(w)).alias("seconds")).where("seconds > 0")
    return steps.join(F.broadcast(steps.agg(F.median("seconds").alias("m")))).where(F.col("seconds") > factor * F.col("m")).drop("m")  # one row


def positions(series: DataFrame) -> DataFrame:
    return series.select((F.row_number().over(Window.orderBy("ts")) - 1).alias("pos"), "ts", F.col("y").cast("double").alias("y"))


def linear_trend(series: DataFrame) -> DataFrame:
    """slope, intercept, r over positions; trend if |r| >= 0.3."""
    p = positions(series)
    x = F.col("pos").cast("double")
    safe = (F.stddev_pop("y") > 0) & (F.stddev_pop(x) > 0)
    t = p.agg(F.count(F.lit(1)).alias("n"), F.when(safe, F.regr_slope("y", x)).alias("slope"), F.when(safe, F.regr_intercept("y", x)).alias("intercept"), safe_corr(F.col("y"), x).alias("r"))
    return t.withColumn("has_trend", F.coalesce(F.abs("r") >= 0.3, F.lit(False)))


def detrended(series: DataFrame) -> DataFrame:
    t = linear_trend(series).select("slope", "intercept")
    return positions(series).join(F.broadcast(t)).select("pos", "ts", (F.col("y") - F.coalesce(F.col("slope") * F.col("pos") + F.col("intercept"), F.lit(0.0))).alias("y"))  # one row


def acf(series: DataFrame, lags: list[int]) -> DataFrame:
    """lag, r; all lags over one ordering of the mean-centred series."""
    mean = series.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("ts")
    x = series.join(F.broadcast(mean)).select("ts", (F.col("y") - F.col("m")).alias("x"))  # one row
    lagged = x.select("x", *[F.lag("x", k).over(w).alias(f"l{k}") for k in lags])
    rows = [F.struct(F.lit(k).alias("lag"), (F.sum(F.col("x") * F.col(f"l{k}")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n")) for k in lags]
    return lagged.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def seasonality(series: DataFrame, freq: str = "D", max_period: int = 365) -> DataFrame:
    """Best candidate period of the detrended series; seasonal if its ACF is at least 0.3."""
    candidates = list(dict.fromkeys([NATURAL.get(freq, 7), *PERIODS]))
    a = acf(detrended(series), [k for k in candidates if k <= max_period]).where((F.col("n") >= 2 * F.col("lag")) & F.col("r").isNotNull())
    rank = F.array_position(F.array(*[F.lit(k) for k in candidates]), F.col("lag"))
    best = a.agg(F.max_by(F.struct("lag", "r"), F.struct("r", -rank)).alias("b"))
    return best.select(F.col("b.lag").alias("period"), F.col("b.r").alias("strength"), F.coalesce(F.col("b.r") >= 0.3, F.lit(False)).alias("seasonal"))


def decompose(series: DataFrame, period: int | None = None) -> DataFrame:
    """pos, ts, observed, trend, seasonal, residual: centred means and phase means."""
    p = positions(series)
    width = period or 7
    around = Window.orderBy("pos").rowsBetween(-(width - 1 - (width - 1) // 2), (width - 1) // 2)
    d = p.withColumn("trend", F.avg("y").over(around)).withColumn("rest", F.col("y") - F.col("trend"))
    if period and period > 1:
        phases = d.groupBy((F.col("pos") % period).alias("phase")).agg(F.avg("rest").alias("s"))
        phases = phases.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy()))
        d = d.withColumn("phase", F.col("pos") % period).join(F.broadcast(phases), "phase").withColumnRenamed("s", "seasonal")  # `period` rows
    else:
        d = d.withColumn("seasonal", F.lit(0.0))
    return d.select("pos", "ts", F.col("y").alias("observed"), "trend", "seasonal", (F.col("rest") - F.col("seasonal")).alias("residual"))


def spikes(parts: DataFrame, limit: float = 3.0) -> DataFrame:
    """Positions whose residual lies over 3 population deviations from the mean."""
    s = parts.agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s"))
    return parts.join(F.broadcast(s)).where((F.col("s") > 0) & (F.abs(F.col("residual") - F.col("m")) > limit * F.col("s"))).drop("m", "s")  # one row


def is_panel_axis(df: DataFrame, ts: str) -> DataFrame:
    n = F.count(F.col(ts))
    d = F.count_distinct(F.col(ts))
    return df.agg(n.alias("rows"), d.alias("times"), ((d < 5) | (d < 0.5 * n)).alias("panel"))


def bucket_grain(df: DataFrame, ts: str) -> str | None:
    """Finest of day, week, month, quarter, year with 2 to 50 periods."""
    grains = ("day", "week", "month", "quarter", "year")
    r = df.agg(F.count(ts).alias("n"), *[F.count_distinct(F.date_trunc(g, F.col(ts))).alias(g) for g in grains]).first()
    return next((g for g in grains if r.n >= 4 and 2 <= r[g] <= 50), None)


def analyze(df: DataFrame, ts: str, value: str, grain: str = "day") -> dict:
    series = bucketed(df, ts, value, grain).persist()
    try:
        f, t, s = frequency(series).first(), linear_trend(series).first(), seasonality(series).first()
        period = s.period if s.seasonal else None
        return {"n": t.n, "freq": f.freq, "slope": t.slope, "r": t.r, "has_trend": t.has_trend, "period": period, "strength": s.strength, "gaps": gaps(series).count(), "spikes": [r.pos for r in spikes(decompose(series, period)).orderBy("pos").limit(50).collect()]}
    finally:
        series.unpersist()
