"""Anomaly detectors. Findings are lazy rows of (check_name, severity, column,
count, percentage); masks are columns over broadcast one-row statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from datalotus.functions import text as X
from datalotus.functions.arrow import indel_ratio, unicode_form
from datalotus.operators.quality import _issue, _n
from datalotus.operators.stats import _math, median, quantiles, skewness


def finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _with_stats(df: DataFrame, column: str, *stats: Column) -> tuple[DataFrame, Column]:
    v = finite(F.col(f"`{column}`"))
    return df.join(F.broadcast(df.select(v.alias("__v")).agg(*stats))), v  # one row is broadcast


def outliers_z(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose |z| (sample deviation) exceeds the limit."""
    both, v = _with_stats(df, column, F.avg("__v").alias("__m"), F.stddev_samp("__v").alias("__s"))
    return both.where((F.col("__s") > 0) & (F.abs(v - F.col("__m")) / F.col("__s") > limit)).drop("__m", "__s")


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    v = finite(F.col(f"`{column}`"))
    both = df.join(F.broadcast(quantiles(df, {column: v}, [0.25, 0.75]).select(F.col("q").alias("__q"))))  # one row
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    return both.where((v < lo - k * (hi - lo)) | (v > hi + k * (hi - lo))).drop("__q")


def outliers_mad(df: DataFrame, column: str, limit: float = 3.5) -> DataFrame:
    """Modified z-score; mean absolute deviation where the MAD is 0."""
    v = finite(F.col(f"`{column}`"))
    away = df.select(v.alias("__v")).join(F.broadcast(median(df, v, "__med")))
    far = F.abs(F.col("__v") - F.col("__med"))
    dev = away.agg(F.first("__med").alias("__med"), F.avg(far).alias("__aad")).join(F.broadcast(median(away, far, "__mad")))  # one row each
    scale = F.when(F.col("__mad") > 0, F.col("__mad") / 0.6745).otherwise(1.253314 * F.col("__aad"))
    return df.join(F.broadcast(dev)).where((scale > 0) & (F.abs(v - F.col("__med")) / scale > limit)).drop("__med", "__mad", "__aad")


def gesd(df: DataFrame, column: str, most: int = 10, alpha: float = 0.05) -> list[float]:
    """Generalised extreme studentised deviates. Only the `most` largest and smallest
    values can be removed, so those and three sums are all that is collected."""
    v = finite(F.col(f"`{column}`"))
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v")).first()
    if s.n < 3 or not s.v:
        return []
    rows = df.select(v.alias("v")).where("v is not null")
    ends = [r.v for r in rows.orderBy("v").limit(most).collect()], [r.v for r in rows.orderBy(F.desc("v")).limit(most).collect()]
    low, high = list(ends[0]), list(ends[1])
    n, mean, ss = s.n, s.m, s.v * s.n
    t_dist = _math(df.sparkSession).distribution.TDistribution
    out: list[float] = []
    for i in range(min(most, s.n - 2)):
        sd = math.sqrt(max(ss, 0) / (n - 1))
        if sd == 0 or not (low or high):
            break
        side = low if low and (not high or abs(low[0] - mean) > abs(high[0] - mean)) else high
        x = side[0]
        p = 1 - alpha / (2 * n)
        t = t_dist(float(n - 2)).inverseCumulativeProbability(p)
        if abs(x - mean) / sd <= n * t / math.sqrt((n - 2 + t * t) * (n + 1)):
            break
        side.pop(0)
        out.append(x)
        new = (mean * n - x) / (n - 1)
        ss -= (x - mean) * (x - new)
        n, mean = n - 1, new
    return out


def choose_method(df: DataFrame, column: str) -> str:
    """GESD for near-symmetric columns in which it finds any; MAD first for skewed
    ones; else z-score."""
    v = finite(F.col(f"`{column}`"))
    s = df.agg(F.count(v).alias("n"), skewness(v).alias("k")).first()
    k = abs(s.k or 0.0)
    if k < 0.5 and s.n >= 25 and gesd(df, column):
        return "gesd"
    return "mad" if k > 1 else "zscore"


def numeric_outliers(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    found = {"mad": outliers_mad, "iqr": outliers_iqr, "zscore": outliers_z}
    chosen = choose_method(df, column) if method == "auto" else method
    if chosen == "gesd":
        values = gesd(df, column)
        return df.where(finite(F.col(f"`{column}`")).isin(values) if values else F.lit(False))
    return found[chosen](df, column)


def _sample(df: DataFrame, column: str, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a hash of a row's own number, so that equal values are drawn one by one."""
    v = finite(F.col(f"`{column}`"))
    numbered = df.select(v.alias("v"), F.monotonically_increasing_id().alias("row")).where("v is not null")
    rows = numbered.orderBy(F.xxhash64("row", F.lit(seed))).limit(most).collect()
    x = np.array([r.v for r in rows], float)
    return x, np.sort(x)


def isolation_scores(x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly scores of a one-dimensional isolation forest."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    depth_limit = math.ceil(math.log2(max(2, size)))
    average = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    total = np.zeros(len(x))

    def walk(values: np.ndarray, at: np.ndarray, depth: int) -> None:
        if depth >= depth_limit or len(values) < 2 or values.min() == values.max():
            total[at] += depth + average(len(values))
            return
        cut = rng.uniform(values.min(), values.max())
        walk(values[values < cut], at[x[at] < cut], depth + 1)
        walk(values[values >= cut], at[x[at] >= cut], depth + 1)

    for _ in range(trees):
        walk(rng.choice(x, size, replace=False), np.arange(len(x)), 0)
    return 2 ** (-(total / trees) / max(average(size), 1e-12))


def isolation_forest(df: DataFrame, column: str, most: int = 10_000, seed: int = 42) -> list[float]:
    """Values of the sample with a score over one half; none if over a fifth."""
    x, _ = _sample(df, column, most, seed)
    if len(x) <= 100:
        return []
    hit = isolation_scores(x, seed=seed) > 0.5
    return sorted(x[hit].tolist()) if 0 < hit.mean() <= 0.2 else []


def local_outliers(df: DataFrame, column: str, most: int = 10_000, seed: int = 42, threshold: float = 1.5) -> list[float]:
    """One-dimensional local outlier factor over a bounded sample, by sorted neighbours."""
    _, x = _sample(df, column, most, seed)
    n = len(x)
    if n < 22 or len(np.unique(x)) <= 0.5 * n:
        return []
    top = int(np.unique(x, return_counts=True)[1].max())
    k = min(max(20, 2 * top), n - 1)
    start = np.zeros(n, int)
    lo = 0
    for i in range(n):  # the window of the k nearest slides to the right
        lo = max(lo, i - k)
        while lo + k + 1 < n and lo < i and x[lo + k + 1] - x[i] < x[i] - x[lo]:
            lo += 1
        start[i] = lo
    near = start[:, None] + np.arange(k + 1)
    near = np.minimum(near, n - 1)
    dist = np.abs(x[near] - x[:, None])
    k_dist = np.sort(dist, axis=1)[:, k]
    other = near != np.arange(n)[:, None]
    reach = np.where(other, np.maximum(dist, k_dist[near]), 0)
    density = k / np.maximum(reach.sum(axis=1), 1e-12)
    factor = np.where(other, density[near], 0).sum(axis=1) / k / density
    return x[factor > threshold].tolist()


def text_checks(df: DataFrame, name: str, thai: bool = True) -> list[Column]:
    c = F.col(f"`{name}`")
    held = F.count(c)
    kind = X.mojibake_kind(c)
    out = [
        _issue("mojibake", "critical", name, _n(c.rlike("Ã[\\x80-\\xbf]|â€|Â[\\xa0-\\xbf]")), held),
        _issue("thai_mojibake", "critical", name, _n(kind.isNotNull()), held),
        _issue("garbled", "critical", name, _n(X.control_count(c) > 0), held),
        _issue("repetition", "warning", name, _n(X.long_repetition(c)), held),
    ]
    if thai:
        out += [
            _issue("orphan_mark", "warning", name, _n(X.combining_order_issue(c)), held),
            _issue("tone_stacking", "warning", name, _n(X.tone_stacked(c)), held),
        ]
    return out


def diacritic_order(df: DataFrame, name: str) -> DataFrame:
    """Rows with Thai marks that NFC reorders; the UDF sees only candidates."""
    c = F.col(f"`{name}`")
    return df.where(c.rlike(X.COMBINING)).withColumn("__nfc", unicode_form(c)).where(F.col("__nfc") != c).drop("__nfc")


def length_outliers(df: DataFrame, name: str) -> DataFrame:
    return outliers_z(df.withColumn("__len", F.length(f"`{name}`")), "__len").drop("__len")


def column_checks(df: DataFrame, name: str) -> list[Column]:
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    rows, held = F.count(F.lit(1)), F.count(c)
    out = [_issue("high_null", "warning", name, rows - held, rows, (rows - held) > 0.5 * rows), _issue("constant", "info", name, held, rows, (held >= 2) & (F.min(c) == F.max(c)))]
    if isinstance(kind, T.StringType):
        numeric = _n(X.is_number(c))
        out.append(_issue("type_mixing", "warning", name, held - numeric, held, (held >= 8) & (numeric >= 0.5 * held) & ((held - numeric) > 0.05 * held)))
    return out


def findings(df: DataFrame, columns: Sequence[str] | None = None, thai: bool = True) -> DataFrame:
    """Text and column anomalies of all columns in one pass."""
    names = columns or df.columns
    all_checks = [x for n in names for x in column_checks(df, n) + (text_checks(df, n, thai) if isinstance(df.schema[n].dataType, T.StringType) else [])]
    return df.agg(F.array_compact(F.array(*all_checks)).alias("all")).select(F.inline("all"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rare_categories(df: DataFrame, name: str, share: float = 0.01) -> DataFrame:
    """Values under 1 % of at least 100 rows, with at least three values."""
    every = Window.partitionBy()
    c = value_counts(df, name).withColumns({"rows": F.sum("n").over(every), "k": F.count(F.lit(1)).over(every)})
    return c.where((F.col("rows") >= 100) & (F.col("k") >= 3) & (F.col("n") < share * F.col("rows"))).select("value", "n")


def case_variants(df: DataFrame, name: str) -> DataFrame:
    """Groups of labels that differ in case only: folded, variants, n."""
    return value_counts(df, name).groupBy(F.lower("value").alias("folded")).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n")).where("variants > 1")


def _really_distinct(a: str, b: str) -> bool:
    import re

    code = re.compile(r"[A-Za-z0-9_./-]+\Z")
    if len(a) < 10 and len(b) < 10 and abs(len(a) - len(b)) <= 1 and code.match(a) and code.match(b) and (re.search(r"\d", a) or a.isupper()):
        return True
    if re.search(r"\d", a) and re.search(r"\d", b) and code.match(a) and code.match(b):
        return True
    wa, wb = a.lower().split(), b.lower().split()
    return len(wa) > 1 and len(wb) > 1 and any(len(w) >= 2 and max(indel_ratio(w, x) for x in wb) <= 0.8 for w in wa)


def fuzzy_labels(df: DataFrame, name: str, labels: int = 300, pairs: int = 20) -> list[list[str]]:
    """Clusters of near-equal labels among the 300 most frequent ones."""
    top = [r.value for r in value_counts(df, name).orderBy(F.desc("n"), "value").limit(labels).collect()]
    root = {v: v for v in top}

    def find(v: str) -> str:
        while root[v] != v:
            v = root[v]
        return v

    found = 0
    for i, a in enumerate(top):
        for b in top[i + 1 :]:
            if found >= pairs:
                break
            if a.lower() != b.lower() and 2 * min(len(a), len(b)) > 0.8 * (len(a) + len(b)) and indel_ratio(a, b) > 0.8 and not _really_distinct(a, b):
                root[find(b)] = find(a)
                found += 1
    groups: dict[str, list[str]] = {}
    for v in top:
        groups.setdefault(find(v), []).append(v)
    return [g for g in groups.values() if len(g) > 1]


def mixed_date_formats(df: DataFrame, name: str) -> DataFrame:
    """signature, n of a column that is date-like in at least 60 % of its cells."""
    c = F.col(f"`{name}`")
    rows = df.where(c.isNotNull()).groupBy(X.date_signature(X.strip(c)).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(X.is_date_like(c)).alias("date"))
    every = Window.partitionBy()
    s = rows.withColumns({"share": F.sum(F.when(F.col("date"), F.col("n")).otherwise(0)).over(every) / F.sum("n").over(every), "k": F.count_if("date").over(every)})
    return s.where("date and share >= 0.6 and k >= 2").select("signature", "n")


def script_mixing(df: DataFrame, name: str) -> DataFrame:
    """Mostly non-Thai cells of a mostly Thai column."""
    c = F.col(f"`{name}`")
    thai, latin = X.thai_count(c), X.latin_count(c)
    cells = df.withColumn("__t", F.when(thai + latin >= 3, thai / (thai + latin)))
    facts = cells.agg(F.avg("__t").alias("__mean"), F.count("__t").alias("__cells"), F.approx_count_distinct(c).alias("__d"))
    return cells.join(F.broadcast(facts)).where("__d > 20 and __cells >= 8 and __mean >= 0.6 and __t <= 0.2").drop("__t", "__mean", "__cells", "__d")  # one row
