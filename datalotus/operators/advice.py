"""Rules that turn column aggregates into advice: shape of distributions, ratings,
cardinality, vocabulary, missingness, type mismatches, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.functions import text as X
from datalotus.operators import corpus, stats

NOTE = "rule string, column string, value double"


def _notes(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return df.agg(F.array_compact(F.array(*rows)).alias("all")).select(F.inline("all"))


def _note(rule: str, column: str, value: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.round(value.cast("double"), 4).alias("value")))


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """|skew| over 1 and excess kurtosis over 7, bias-corrected."""
    rows = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        rows += [_note("skewed", c, stats.skewness(v), F.abs(stats.skewness(v)) > 1), _note("heavy_tails", c, stats.kurtosis(v), stats.kurtosis(v) > 7)]
    return _notes(df, rows)


def bimodal(df: DataFrame, column: str) -> bool:
    h = {r.bin: r.n for r in stats.histogram(df, column).collect()}  # 20 bins
    d = stats.distinct_counts(df, [column]).first().distinct
    return stats.is_bimodal([h.get(i, 0) for i in range(20)], d)


def co_missing(df: DataFrame, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """Pairs of columns that are missing together."""
    flags = df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(c) for c in columns])
    return stats.correlation_pairs(flags, columns).where(F.col("r") >= least)


def rating(df: DataFrame, column: str) -> DataFrame:
    """low, high: shares of the lower and upper third of a rating-like column (whole
    numbers from 0 to 10, 2 to 11 levels, at least 20 values)."""
    v = F.col(f"`{column}`").cast("double")
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    third = (F.col("hi") - F.col("lo")) / 3
    both = counts.withColumnRenamed("n", "c").join(F.broadcast(s)).where("n >= 20 and levels between 2 and 11 and whole and lo >= 0 and hi <= 10")  # one row
    share = lambda cond: F.round(F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.max("n"), 6)
    r = both.agg(F.count(F.lit(1)).alias("k"), share(F.col("v") <= F.col("lo") + third).alias("low"), share(F.col("v") >= F.col("hi") - third).alias("high")).where("k > 0").drop("k")
    return r.withColumn("verdict", F.when(F.col("high") >= 0.5, "mostly_high").when(F.col("low") >= 0.5, "mostly_low").when((F.col("low") >= 0.25) & (F.col("high") >= 0.25) & (F.col("low") + F.col("high") >= 0.6), "polarised").otherwise("spread"))


def text_advice(df: DataFrame, column: str) -> DataFrame:
    """Length and vocabulary rules of a text column."""
    m = corpus.text_metrics(df, column).join(F.broadcast(corpus.vocabulary(df, column)))  # one row each
    n = lambda rule, value, when: _first(rule, column, value, when)
    rows = [
        n("short_texts", F.col("median_chars"), F.col("median_chars") < 10), n("long_texts", F.col("median_chars"), F.col("median_chars") > 200),
        n("uneven_lengths", F.col("mean_chars"), (F.col("mean_chars") > 2 * F.col("median_chars")) & (F.col("max_chars") > 8 * F.col("median_chars"))),
        n("repetitive", F.col("richness"), (F.col("total") >= 50) & (F.col("richness") < 0.1)), n("diverse", F.col("richness"), (F.col("total") >= 50) & (F.col("richness") > 0.5)),
    ]
    return m.select(F.inline(F.array_compact(F.array(*rows))))


def _first(rule: str, column: str, value: Column, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.round(value.cast("double"), 4).alias("value")))


def high_cardinality(df: DataFrame, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    held = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n")) for c in columns]).alias("all")).select(F.inline("all"))
    x = held.join(stats.distinct_counts(df, columns), "column")
    return x.where((F.col("n") >= 20) & (F.col("distinct") >= least * F.col("n"))).select("column", F.round(F.col("distinct") / F.col("n"), 4).alias("ratio"))


def type_mismatch(df: DataFrame, columns: Sequence[str], least: float = 0.8) -> DataFrame:
    """Text columns that are mostly numbers."""
    share = lambda c: F.try_divide(F.count_if(X.is_number(F.col(f"`{c}`"))), F.count(F.col(f"`{c}`")))
    return _notes(df, [_note("numeric_text", c, share(c), share(c) >= least) for c in columns])


def outlier_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at least five rows or 1 % beyond three population deviations."""
    wide = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    both = df.join(F.broadcast(wide))  # one row
    rows = []
    for i, c in enumerate(columns):
        n = F.count_if(F.abs(F.col(f"`{c}`") - F.col(f"m{i}")) > 3 * F.col(f"s{i}"))
        held = F.count(F.col(f"`{c}`"))
        rows.append(_note("outliers", c, n, (held >= 20) & ((n >= 5) | ((n > 0) & (n >= 0.01 * held)))))
    return _notes(both, rows)


def target_baseline(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """value, n, share of the most frequent target classes."""
    c = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), "value").limit(k)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank-sum H over groups, corrected for ties."""
    rows = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{value}`").isNotNull()).select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").alias("value"))
    per = rows.groupBy("g", "value").agg(F.count(F.lit(1)).alias("c")).join(stats.ranks(rows, "value"), "value")
    g = per.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    total = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    ties = rows.groupBy("value").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return total.join(F.broadcast(ties)).select(F.col("k").alias("groups"), "n", h.alias("h"))  # one row


def blueprint(df: DataFrame, target: str) -> dict:
    """Columns to drop before modelling, strong features, class balance."""
    from datalotus.operators.detect import detect_all
    from datalotus.plans.profile import analyze_target

    types = detect_all(df)
    features = [c for c, t in types.items() if c != target and t in ("numeric", "categorical")]
    leaks = stats.leakage(df, target, features)
    bad = {r["column"] for r in leaks}
    ranked = analyze_target(df, target, [c for c in features if c not in bad])
    return {"drop": sorted(bad | {c for c, t in types.items() if t in ("id", "empty")}), "leaks": leaks, "strong": [r for r in ranked if abs(r["score"]) >= 0.05][:8], "baseline": [r.asDict() for r in target_baseline(df, target).collect()]}
