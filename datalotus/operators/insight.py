"""Insight engine: all breakdowns of a table in one GROUPING SETS pass, patterns as
windows over the grouped rows, FDR gate and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.functions import text as X
from datalotus.operators import stats, timeseries
from datalotus.operators.detect import detect_all, hints_geo, hints_id

LEAST_SEGMENT = 30


def perspectives(df: DataFrame, breakdowns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """breakdown, key, measure, n, total, mean: one pass for all of them."""
    keys = {b: f"__k{i}" for i, b in enumerate(breakdowns)}
    rows = df.select(*[X.normalize_key(F.col(f"`{b}`")).alias(k) for b, k in keys.items()], *[F.col(f"`{m}`").cast("double").alias(f"__m{j}") for j, m in enumerate(measures)])
    aggs = [F.count(F.lit(1)).alias("n")]
    for j in range(len(measures)):
        aggs += [F.sum(f"__m{j}").alias(f"s{j}"), F.avg(f"__m{j}").alias(f"a{j}")]
    sets = [[F.col(k)] for k in keys.values()]
    grouped = rows.groupingSets(sets, *[F.col(k) for k in keys.values()]).agg(*aggs, F.grouping_id().alias("gid"))
    last = len(breakdowns) - 1
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (b, k) in enumerate(keys.items()):
        mine = F.col("gid") == ((1 << len(breakdowns)) - 1 - (1 << (last - i)))
        name, key = F.when(mine, b).otherwise(name), F.when(mine, F.col(k)).otherwise(key)
    flat = grouped.select(name.alias("breakdown"), key.alias("key"), "n", F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"s{j}").alias("total"), F.col(f"a{j}").alias("mean")) for j, m in enumerate(measures)]).alias("all"))
    return flat.where("key is not null").select("breakdown", "key", "n", F.inline("all"))


def outstanding(grouped: DataFrame, value: str = "total", least: int = LEAST_SEGMENT) -> DataFrame:
    """A leader at least 1.5 times the second."""
    w = Window.partitionBy("breakdown", "measure").orderBy(F.desc(value), "key")
    r = grouped.where(F.col(value).isNotNull()).withColumns({"rank": F.row_number().over(w), "second": F.lead(value).over(w)}).where("rank = 1")
    lift = F.col(value) / F.col("second")
    return r.where((F.col("second") > 0) & (F.col(value) > 0) & (lift >= 1.5) & (F.col("n") >= least)).select("breakdown", "measure", "key", "n", F.lit("outstanding").alias("pattern"), (1 - F.col("second") / F.col(value)).alias("score"), F.least(lift / 5, F.lit(1.0)).alias("effect"))


def attribution(grouped: DataFrame) -> DataFrame:
    """One of at least three groups holds half of a total."""
    w = Window.partitionBy("breakdown", "measure")
    r = grouped.withColumns({"k": F.count(F.lit(1)).over(w), "all": F.sum("total").over(w), "lowest": F.min("total").over(w)})
    share = F.col("total") / F.col("all")
    return r.where((F.col("k") >= 3) & (F.col("all") > 0) & (F.col("lowest") >= 0) & (share >= 0.5)).select("breakdown", "measure", "key", "n", F.lit("attribution").alias("pattern"), share.alias("score"), F.least(share * F.col("k") / 5, F.lit(1.0)).alias("effect"))


def comparison(df: DataFrame, breakdown: str, measure: str, least: int = LEAST_SEGMENT) -> dict | None:
    """The group of the highest mean against the rest: ANOVA p and divergence."""
    g = df.where(F.col(f"`{breakdown}`").isNotNull() & F.col(f"`{measure}`").isNotNull()).groupBy(F.col(f"`{breakdown}`").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(f"`{measure}`").alias("m"))
    top = g.orderBy(F.desc("m"), "g").first()
    if top is None:
        return None
    rest = g.where(F.col("g") != top.g).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m")).first()
    if not rest.n or top.n < least or rest.n < least or not rest.m:
        return None
    a = stats.anova(df, breakdown, measure).first()
    p = stats.p_from_f(df.sparkSession, a.f, a.groups - 1, a.n - a.groups) if a.f is not None else 1.0
    return {"breakdown": breakdown, "measure": measure, "key": str(top.g), "n": top.n, "pattern": "comparison", "score": stats.jsd(df, breakdown, measure, top.g).first().jsd, "effect": min(abs(top.m / rest.m - 1), 1.0), "p": p}


def trend(df: DataFrame, time: str, measure: str, how: str = "sum") -> dict | None:
    """Mann-Kendall over 4 to 50 time buckets."""
    grain = timeseries.bucket_grain(df, time)
    if grain is None:
        return None
    r = stats.mann_kendall(timeseries.bucketed(df, time, measure, grain, how), "ts", "y").first()
    if r.n < 4 or abs(r.tau) < 0.3:
        return None
    p = 2 * (1 - stats.normal_cdf(abs(r.z)))
    return {"breakdown": time, "measure": measure, "key": "increasing" if r.tau > 0 else "decreasing", "n": r.n, "pattern": "trend", "score": 1 - p, "effect": abs(r.tau), "p": p}


def strong_correlations(df: DataFrame, measures: Sequence[str]) -> list[dict]:
    rows = stats.correlation_pairs(df, measures).where("abs(r) >= 0.7").orderBy(F.desc(F.abs("r")), "left", "right").limit(10).collect() if len(measures) > 1 else []
    return [{"breakdown": r.left, "measure": r.right, "key": "positive" if r.r > 0 else "negative", "n": 0, "pattern": "correlation", "score": abs(r.r), "effect": abs(r.r), "p": None} for r in rows]


def gate_and_rank(cards: list[dict], alpha: float = 0.01, top: int = 8) -> list[dict]:
    """Benjamini-Hochberg over tested cards, then score with novelty discounts."""
    tested = sorted((c["p"] for c in cards if c.get("p") is not None))
    cut = max((p for k, p in enumerate(tested, 1) if p <= k / len(tested) * alpha), default=-1.0)
    kept = [c for c in cards if c.get("p") is None or c["p"] <= cut]
    for c in kept:
        c["rank_score"] = 0.5 * c["score"] + 0.5 * c["effect"]
    kept.sort(key=lambda c: (-c["rank_score"], c["breakdown"], c["measure"], c["pattern"]))
    same: dict[tuple, int] = {}
    for c in kept:
        k = (c["breakdown"], c["pattern"])
        c["rank_score"] *= 0.6 ** same.get(k, 0)
        same[k] = same.get(k, 0) + 1
    return sorted(kept, key=lambda c: (-c["rank_score"], c["breakdown"], c["measure"], c["pattern"]))[:top]


def select_columns(df: DataFrame, types: dict[str, str] | None = None, most: int = 20) -> tuple[list[str], list[str], list[str]]:
    """(breakdowns, measures, time columns) worth scanning."""
    types = types or detect_all(df)
    cats = [c for c, t in types.items() if t == "categorical"]
    nums = [c for c, t in types.items() if t == "numeric" and not hints_id(c) and not hints_geo(c) and dict(df.dtypes)[c] != "string"]
    times = [c for c, t in types.items() if t == "datetime" and dict(df.dtypes)[c] != "string"]
    aggs = [F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cats)] + [F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(nums)]
    if not aggs:
        return [], [], times
    r = df.agg(*aggs).first()
    good = sorted((c for i, c in enumerate(cats) if 2 <= r[f"d{i}"] <= 50), key=lambda c: (-r[f"d{cats.index(c)}"], c))[:most]
    return good, [c for i, c in enumerate(nums) if r[f"s{i}"]][:most], times


def discover(df: DataFrame, types: dict[str, str] | None = None, top: int = 8, least: int | None = None) -> list[dict]:
    """Ranked insight cards over all rows; nothing is sampled."""
    breakdowns, measures, times = select_columns(df, types)
    n = df.count()
    least = least or (max(5, n // 20) if n < 300 else LEAST_SEGMENT)
    cards: list[dict] = []
    if breakdowns and measures:
        grouped = perspectives(df, breakdowns, measures).persist()
        cards += [r.asDict() | {"p": None} for r in outstanding(grouped, least=least).unionByName(attribution(grouped)).collect()]
        grouped.unpersist()
        cards += [c for b in breakdowns for m in measures if (c := comparison(df, b, m, least))]
    cards += [c for t in times for m in measures if (c := trend(df, t, m))]
    return gate_and_rank(cards + strong_correlations(df, measures), top=top)
