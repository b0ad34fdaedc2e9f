"""Statistics as algebra over one or two aggregations.

Sums are taken on the cluster; p-values come from t, F and chi-square
distributions evaluated on the driver for single numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _math(spark: SparkSession):  # noqa: ANN202
    return spark._jvm.org.apache.commons.math3


def p_from_f(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    return 1.0 - _math(spark).distribution.FDistribution(float(d1), float(d2)).cumulativeProbability(float(f))


def p_from_t(spark: SparkSession, t: float, df: float) -> float:
    return 2 * (1.0 - _math(spark).distribution.TDistribution(float(df)).cumulativeProbability(abs(float(t))))


def p_from_chi2(spark: SparkSession, x: float, df: float) -> float:
    return 1.0 - _math(spark).distribution.ChiSquaredDistribution(float(df)).cumulativeProbability(float(x))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over complete pairs; null where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    # corr() itself raises on a constant side, so it is written out
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), spread))


#: Bytes of different cells that one task may hold, and those of an entry beside its text.
HELD, ENTRY = 256 << 20, 80


def spread(texts: DataFrame) -> int:
    """In how many parts the rows' different cells take at most HELD bytes a part
    (estimated: the number decides on memory only, never on results)."""
    cells = [F.struct(F.approx_count_distinct(c).alias("d"), F.coalesce(F.max(F.octet_length(c)), F.lit(0)).alias("w")) for c in texts.columns]
    r = texts.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells")).first()
    parts = 1
    while parts < r.rows and sum(min(1.1 * x.d, r.rows / parts) * (ENTRY + x.w) for x in r.cells) > HELD:
        parts += 1 + parts // 4
    return parts


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct of many columns by one shuffle of their distinct values
    (several count_distinct in one aggregate would copy every row for each).

    A task's first aggregate holds all that differs in its rows. Where that may be
    too much, rows are dealt by their hash first (equal rows meet, and take one entry).
    """
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = spread(texts) if columns else 1
    dealt = texts.repartition(parts, *texts.columns) if parts > 1 else texts
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("value")) for i, c in enumerate(texts.columns)])
    found = dealt.select(F.explode(cells).alias("x")).select("x.i", "x.value").where("value is not null").distinct()
    seen = found.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, column string")
    return names.join(seen, "i", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def skewness(c: Column) -> Column:
    """Bias-corrected."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


SLICES = 64


def quantiles(df: DataFrame, values: Mapping[str, Column], at: Sequence[float]) -> DataFrame:
    """column, q: exact, interpolated quantiles of many columns; a column without
    values has no row.

    F.percentile brings every task's values to one task. Here values are counted by
    one shuffle and cut into SLICES ranges; only the ranges that hold a wanted rank
    are sorted, each in a task of its own. Where the cuts lie doesn't change the result.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values.values())])
    counts = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.groupBy("i").agg(F.percentile_approx("v", [k / SLICES for k in range(1, SLICES)], 1_000).alias("b"), F.sum("n").alias("total"))
    sliced = counts.join(F.broadcast(bounds), "i").withColumn("s", F.size(F.filter("b", lambda b: b < F.col("v"))))  # one row a column
    earlier = Window.partitionBy("i").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = sliced.groupBy("i", "s").agg(F.sum("n").alias("m"), F.max("total").alias("t")).withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    place = lambda p, total: F.lit(float(p)) * (F.col(total) - 1)
    held = [(F.floor(place(p, "t")) < F.col("before") + F.col("m")) & (F.ceil(place(p, "t")) >= F.col("before")) for p in at]
    wanted = per.where(F.exists(F.array(*held), lambda x: x)).select("i", "s", "before")
    inside = Window.partitionBy("i", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.join(F.broadcast(wanted), ["i", "s"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))  # two slices a quantile at most
    value = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))
    ends = [value(f(place(p, "total"))).alias(f"{x}{k}") for k, p in enumerate(at) for x, f in (("lo", F.floor), ("hi", F.ceil))]
    found = rows.groupBy("i").agg(F.max("total").alias("total"), *ends)
    lo, hi = (lambda k: F.col(f"lo{k}")), (lambda k: F.col(f"hi{k}"))
    q = [F.when(lo(k) == hi(k), lo(k)).otherwise((F.floor(place(p, "total")) + 1 - place(p, "total")) * lo(k) + (place(p, "total") - F.floor(place(p, "total"))) * hi(k)) for k, p in enumerate(at)]
    return found.select(F.element_at(F.array(*[F.lit(c) for c in values]), F.col("i") + 1).alias("column"), F.array(*q).alias("q"))


def median(df: DataFrame, v: Column, name: str) -> DataFrame:
    """One row with the exact median as `name`; null without values."""
    q = quantiles(df, {name: v}, [0.5])
    return q.agg(F.max(F.col("q")[0]).alias(name))


def basic_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column; exact quantiles."""
    rows, values = [], {}
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        values[c] = v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        rows.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), skewness(v).alias("skew"), kurtosis(v).alias("kurtosis")))
    wide = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    q = quantiles(df, values, [0.25, 0.5, 0.75]).select("column", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    return wide.join(q, "column", "left").join(distinct_counts(df, columns), "column").select("column", "count", "missing", "distinct", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left, right, r for all pairs, in one aggregation."""
    pairs = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*pairs).alias("all")).select(F.inline("all"))


def running_totals(rows: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """`rows` (distinct in the numeric `order`) with `<name>_upto`, the totals of
    `sums` up to each row, and `<name>_all`, without a one-task sort.

    Approximate quantiles cut the order into SLICES ranges; range totals are
    accumulated over SLICES rows, and each range is sorted in a task of its own.
    Where the cuts lie doesn't change the totals.
    """
    cut = [i / SLICES for i in range(1, SLICES)]
    bounds = rows.agg(F.percentile_approx(order, cut, 10_000).alias("__bounds")).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    sliced = rows.withColumn("__slice", at)
    per = sliced.groupBy("__slice").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # at most SLICES rows
    before, every = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select("__slice", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in sums], *[F.sum(f"__{c}").over(every).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy("__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = sliced.join(F.broadcast(per), "__slice")  # at most SLICES rows
    return both.withColumns({f"{c}_upto": F.col(f"__{c}_before") + F.sum(c).over(inside) for c in sums}).drop("__slice", *[f"__{c}_before" for c in sums])


def average_rank(c: str, *partition: str) -> Column:
    """Rank with ties averaged."""
    by = Window.partitionBy(*partition)
    return F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, c)) - 1) / 2


def ranks(df: DataFrame, column: str) -> DataFrame:
    """value, rank (ties averaged) of the column's distinct values, from counts."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, "value", ["n"])
    return totals.select("value", (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
    ra, rb = ranks(both, "a").toDF("a", "ra"), ranks(both, "b").toDF("b", "rb")
    return both.join(ra, "a").join(rb, "b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("ra"), F.col("rb")).alias("rho"))


def _group_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(f"`{value}`").cast("double")
    return df.where(v.isNotNull() & F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").alias("g")).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.var_pop(v).alias("v"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """groups, n, f, eta (correlation ratio)."""
    g = _group_sums(df, group, value)
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("means"))
    between = F.col("means") - F.col("s") * F.col("s") / F.col("n")
    return t.withColumn("between", between).select(F.col("k").alias("groups"), "n", F.when((F.col("within") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k")), (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), F.when(F.col("between") + F.col("within") > 0, F.sqrt(F.greatest(F.col("between"), F.lit(0.0)) / (F.col("between") + F.col("within")))).otherwise(0.0).alias("eta"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).groupBy(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).agg(F.count(F.lit(1)).alias("o"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (Yates on 2 by 2), dof, n and bias-corrected Cramer's V."""
    o = contingency(df, a, b)
    ra, rb = o.groupBy("a").agg(F.sum("o").alias("ra")), o.groupBy("b").agg(F.sum("o").alias("rb"))
    dims = ra.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n")).join(rb.agg(F.count(F.lit(1)).alias("c")))
    # a cell that was never seen adds its expectation, so the unseen ones sum to n - sum of seen expectations
    cells = o.join(ra, "a").join(rb, "b").join(F.broadcast(dims))  # one row
    e = F.col("ra") * F.col("rb") / F.col("n")
    d = F.abs(F.col("o") - e)
    yates = F.greatest(d - F.when((F.col("r") == 2) & (F.col("c") == 2), 0.5).otherwise(0.0), F.lit(0.0))
    s = cells.agg(F.sum(yates * yates / e).alias("x"), F.sum(d * d / e).alias("plain"), F.sum(e).alias("seen"), F.max("n").alias("n"), F.max("r").alias("r"), F.max("c").alias("c"), F.count(F.lit(1)).alias("cells"))
    unseen = F.when((F.col("r") == 2) & (F.col("c") == 2), F.lit(0.0)).otherwise(F.col("n") - F.col("seen"))
    phi = F.greatest((F.col("plain") + F.col("n") - F.col("seen")) / F.col("n") - (F.col("r") - 1) * (F.col("c") - 1) / (F.col("n") - 1), F.lit(0.0))
    rc = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / (F.col("n") - 1)
    cc = F.col("c") - (F.col("c") - 1) * (F.col("c") - 1) / (F.col("n") - 1)
    v = F.when(F.least(rc, cc) > 1, F.sqrt(phi / (F.least(rc, cc) - 1))).otherwise(0.0)
    return s.select((F.col("x") + unseen).alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), "n", v.alias("v"))


def determinism(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Share of rows that the feature's majority target predicts."""
    return contingency(df, feature, target).groupBy("a").agg(F.max("o").alias("m"), F.sum("o").alias("t")).agg((F.sum("m") / F.sum("t")).alias("ratio"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n; the last bin is closed on the right."""
    v = F.col(f"`{column}`").cast("double")
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return df.where(v.isNotNull()).join(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast


def is_bimodal(counts: Sequence[int], distinct: int) -> bool:
    """Two peaks of at least a quarter of the highest, with a valley under 60 %."""
    if sum(counts) < 40 or distinct < 10:
        return False
    s = [(counts[max(0, i - 1)] + counts[i] + counts[min(len(counts) - 1, i + 1)]) / 3 for i in range(len(counts))]
    top = max(s)
    peaks = [i for i in range(len(s)) if s[i] >= 0.25 * top and s[i] >= s[max(0, i - 1)] and s[i] >= s[min(len(s) - 1, i + 1)]]
    return any(min(s[a : b + 1]) < 0.6 * min(s[a], s[b]) for i, a in enumerate(peaks) for b in peaks[i + 1 :] if b - a > 1)


def jsd(df: DataFrame, group: str, value: str, first: str, bins: int = 20) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of one group against the rest."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & F.col(f"`{group}`").isNotNull()).select(v.alias("v"), (F.col(f"`{group}`") == first).alias("in"))
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    h = rows.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count_if("in").alias("a"), F.count_if(~F.col("in")).alias("b"))  # one row is broadcast
    t = Window.partitionBy()
    p = h.select((F.col("a") / F.sum("a").over(t)).alias("p"), (F.col("b") / F.sum("b").over(t)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return p.agg(F.least(F.greatest((F.sum(term(F.col("p"))) + F.sum(term(F.col("q")))) / 2, F.lit(0.0)), F.lit(1.0)).alias("jsd"))


def ks_drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance over distinct values' counts."""
    side = lambda d, x, y: d.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("double").alias("v"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    counts = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    t = running_totals(counts, "v", ["x", "y"])
    gap = t.select(F.abs(F.col("x_upto") / F.col("x_all") - F.col("y_upto") / F.col("y_all")).alias("d"))
    return gap.agg(F.max("d").alias("d")).withColumn("drift", F.col("d") > 0.10)


def categorical_drift(a: DataFrame, b: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Shift of each value's share, largest first."""
    share = lambda d, name: d.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).select("value", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    both = share(a, "before").join(share(b, "after"), "value", "full_outer").select("value", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.withColumn("shift", F.col("after") - F.col("before")).orderBy(F.abs("shift").desc(), "value").limit(k)


def numeric_diff(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """mean, median, population std, min, max, count of both sides, to 4 places."""
    def side(d: DataFrame, tag: str) -> DataFrame:
        rows = [F.struct(F.lit(c).alias("column"), *[F.round(f(F.col(f"`{c}`")).cast("double"), 4).alias(f"{n}_{tag}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("count", F.count))]) for c in columns]
        s = d.agg(F.array(*rows).alias("all")).select(F.inline("all"))
        q = quantiles(d, {c: F.col(f"`{c}`") for c in columns}, [0.5]).select("column", F.round(F.col("q")[0], 4).alias(f"median_{tag}"))
        return s.join(q, "column", "left").select("column", f"mean_{tag}", f"median_{tag}", *s.columns[2:])

    return side(a, "a").join(side(b, "b"), "column")


def mann_kendall(series: DataFrame, order: str, value: str) -> DataFrame:
    """tau and z of a short series (at most a few dozen buckets)."""
    rows = series.select(F.row_number().over(Window.orderBy(order)).alias("i"), F.col(value).cast("double").alias("y"))
    pairs = rows.toDF("i", "y").join(rows.toDF("j", "z"), F.col("i") < F.col("j"))
    s = pairs.agg(F.coalesce(F.sum(F.signum(F.col("z") - F.col("y"))), F.lit(0.0)).alias("s")).join(rows.agg(F.count(F.lit(1)).alias("n")))
    ties = rows.groupBy("y").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0
    z = F.when(var > 0, (F.col("s") - F.signum(F.col("s"))) / F.sqrt(var)).otherwise(0.0)
    return s.join(ties).select("n", (2.0 * F.col("s") / (n * (n - 1))).alias("tau"), z.alias("z"))


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """`df` with `significant`: step-up control of the false discovery rate."""
    every = Window.partitionBy()
    ranked = df.withColumn("__k", F.row_number().over(Window.orderBy(p))).withColumn("__m", F.count(F.lit(1)).over(every))
    top = F.max(F.when(F.col(p) <= F.col("__k") / F.col("__m") * alpha, F.col("__k"))).over(every)
    return ranked.withColumn("significant", F.coalesce(F.col("__k") <= top, F.lit(False))).drop("__k", "__m")


def simpson(df: DataFrame, target: str, group: str, segment: str, least: int = 10) -> DataFrame:
    """Direction of corr(group, target) overall and per segment, and whether it
    reverses in at least two and more than half of the segments that have one."""
    x, y = F.col(f"`{group}`").cast("double"), F.col(f"`{target}`").cast("double")
    sign = lambda r: F.when(F.abs(r) >= 0.05, F.signum(r)).otherwise(0.0)
    all_rows = df.agg(sign(F.coalesce(safe_corr(x, y), F.lit(0.0))).alias("overall"))
    inner = df.where(F.col(f"`{segment}`").isNotNull()).groupBy(F.col(f"`{segment}`").alias("segment")).agg(F.count(F.lit(1)).alias("n"), sign(F.coalesce(safe_corr(x, y), F.lit(0.0))).alias("within")).where((F.col("n") >= least) & (F.col("within") != 0))
    both = inner.join(F.broadcast(all_rows))  # one row
    s = both.agg(F.max("overall").alias("overall"), F.count(F.lit(1)).alias("segments"), F.count_if(F.col("within") == -F.col("overall")).alias("reversed"))
    return s.withColumn("paradox", (F.col("reversed") >= 2) & (F.col("reversed") * 2 > F.col("segments")) & (F.col("overall") != 0))


_PROXY = r"(?i)^(historical_|future_|avg_|mean_|total_|cum_|past_|prev_|last_)|_(ctr|rate|score|prob|pred|target|label|outcome)$"


def leakage(df: DataFrame, target: str, features: Sequence[str]) -> list[dict]:
    """Findings per feature: duplicate, near_perfect_correlation, correlation_ratio,
    deterministic, suspected_proxy. A fixed number of jobs per feature."""
    import re

    out = []
    numeric = dict(df.dtypes)[target] not in ("string", "boolean")
    for f in features:
        kind = dict(df.dtypes)[f]
        a, b = F.col(f"`{f}`"), F.col(f"`{target}`")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(a.cast("string").eqNullSafe(b.cast("string"))).alias("same"), (safe_corr(a, b) if numeric and kind not in ("string", "boolean") else F.lit(None).cast("double")).alias("r"), F.count_distinct(a).alias("d")).first()
        if r.n < 20:
            continue
        if r.same == r.n:
            out.append({"column": f, "kind": "duplicate", "score": 1.0})
            continue
        effect = abs(r.r or 0.0)
        if effect >= 0.98:
            out.append({"column": f, "kind": "near_perfect_correlation", "score": effect})
            continue
        if numeric and kind in ("string", "boolean"):
            effect = anova(df, f, target).first().eta
            if effect >= 0.98 and r.d < 0.95 * r.n:
                out.append({"column": f, "kind": "correlation_ratio", "score": effect})
                continue
        if r.d < 0.95 * r.n:
            ratio = determinism(df, f, target).first().ratio
            if ratio is not None and ratio >= 0.99:
                out.append({"column": f, "kind": "deterministic", "score": ratio})
                continue
        if re.search(_PROXY, f) and (0.35 if re.match("(?i)historical_|future_", f) else 0.5) <= effect < 0.98:
            out.append({"column": f, "kind": "suspected_proxy", "score": effect})
    return out


def fit_distributions(df: DataFrame, column: str) -> list[dict]:
    """Moments' fits of normal, lognormal, exponential and uniform with the KS
    distance over distinct values; best first."""
    v = F.col(f"`{column}`").cast("double")
    m = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(F.when(v > 0, F.log(v))).alias("lmean"), F.stddev_pop(F.when(v > 0, F.log(v))).alias("lstd")).first()
    if m.n < 30 or not m.std:
        return []
    cdf = {"uniform": (F.col("v") - m.lo) / (m.hi - m.lo), "expon": 1 - F.exp(-(F.col("v") - m.lo) / max(m.mean - m.lo, 1e-12))}
    logistic = lambda z: 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))  # noqa: E731  normal cdf to 1e-3
    cdf["normal"] = logistic((F.col("v") - m.mean) / m.std)
    if m.lo > 0 and m.lstd:
        cdf["lognormal"] = logistic((F.log("v") - m.lmean) / m.lstd)
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    e = running_totals(counts, "v", ["c"]).withColumn("hi", F.col("c_upto") / m.n).withColumn("lo", F.col("hi") - F.col("c") / m.n)
    d = e.agg(*[F.max(F.greatest(F.abs(F.col("hi") - x), F.abs(x - F.col("lo")))).alias(k) for k, x in cdf.items()]).first()
    root = math.sqrt(m.n)
    p = lambda x: min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x * (root + 0.12 + 0.11 / root)) ** 2) for k in range(1, 50))))
    return sorted(({"distribution": k, "ks": d[k], "p": p(d[k]), "good": p(d[k]) >= 0.05} for k in cdf), key=lambda r: (r["ks"], r["distribution"]))
