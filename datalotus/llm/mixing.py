"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all
words; a target stops at `cap` times its source's words, and the excess goes to
the others by weight until none is above (solved in closed form over the sources
in order of cap/weight).

Schedule: over the training time t in [0, 1] a source is drawn with density
target * (1 + ramp * (2t - 1)), whose integral is the target: early sources fall,
late ones rise. A document of the source stands at a cumulative demand u in [0, 1]
(its words before it over the target, epochs one after the other); the integral's
inverse at u is its training position. Output is range-sorted by position.

Within a source documents go in the order of md5(doc_id). Full epochs take every
document; the rest of the target takes those documents whose middle lies before
it, so a source's taken words miss its target by half a document at most.

Scale: prefix sums come in two steps. (source, first `DIGITS` hex digits of the
hash) buckets are summed, those sums are accumulated, and only a bucket is sorted
in one task: a source with a third of all rows is spread over 16**DIGITS buckets.
Ranks and sums over the sources are taken in ranges as well (`prefix_sums`).

Defined cases: null text has size 0; null source is a source of its own, last;
a source without words has target 0 and no copies; rows repeated with one doc_id
are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.llm.common import Tables, column, materialize, partitions, word_count

WEIGHTS, RAMPS, CAP, DIGITS = (1, 2, 3), (-0.5, 0.0, 0.5), 3, 3


def _cycle(values: Sequence[float], i: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str], tables: Tables) -> DataFrame:
    """`df` with, for each entry of `sums` (new name to column), the sum over the rows
    before in `order`; a column "" stands for ones. Rows are sorted in ranges: a task
    holds one range, and only the ranges' totals (one row each) meet in one task."""
    n = min(partitions(df.sparkSession), 1024)
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges", tables)
    value = {k: F.col(v) if v else F.lit(1) for k, v in sums.items()}
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    totals = ranged.groupBy("range").agg(*[F.sum(v).alias(k) for k, v in value.items()])
    offsets = totals.select("range", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_offset") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in value.items()})
    return local.join(F.broadcast(offsets), "range").withColumns({k: F.col(k) + F.col(f"{k}_offset") for k in sums}).drop("range", *[f"{k}_offset" for k in sums])


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[float] = RAMPS, cap: int = CAP, tables: Tables | None = None) -> DataFrame:
    """One row per source of `sized` (source, size): source_size, target, ramp. No task
    holds all sources, which may be as many as URLs."""
    tables = tables or Tables(sized.sparkSession)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = prefix_sums(per, [F.col("source").asc_nulls_last()], {"i": ""}, tables)
    per = per.withColumns({"w": _cycle(weights, F.col("i"), "double"), "ramp": _cycle(ramps, F.col("i"), "double"), "most": (F.lit(cap) * F.col("source_size")).cast("double")})
    per = prefix_sums(per, [F.col("most") / F.col("w"), F.col("i")], {"cap_before": "most", "w_before": "w"}, tables)
    per = materialize(per, "shares", tables)
    whole = per.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("all_w")).first()  # one row
    level = (F.lit(whole.total or 0.0) - F.col("cap_before")) / (F.lit(whole.all_w or 0.0) - F.col("w_before"))
    per = per.withColumn("full", F.col("most") < F.col("w") * level)
    free = per.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).alias("most"), F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).alias("w")).first()  # one row
    share = F.col("w") * F.lit((whole.total or 0.0) - (free.most or 0.0)) / F.lit(free.w or 1.0)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), share))
    return per.select("source", "source_size", target.alias("target"), "ramp")


def _position(u: Column, ramp: Column) -> Column:
    """Inverse of t * (1 - ramp) + ramp * t**2."""
    v, b = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)), F.lit(1.0) - ramp
    return F.when(u.isNotNull(), F.lit(2.0) * v / (b + F.sqrt(b * b + F.lit(4.0) * ramp * v)))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, ramps: Sequence[float] = RAMPS, cap: int = CAP, carry: Sequence[str] = (), tables: Tables | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies,
    position (of the first copy), step (from one copy's demand to the next) and
    `doc` with the columns of `carry`."""
    key = F.md5(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), word_count(column(text_col)).alias("size"), key.alias("key"), *([F.struct(*[column(c) for c in carry]).alias("doc")] if carry else []))
    rows = rows.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    plan = offsets.join(targets(sums.withColumnRenamed("bucket_size", "size"), weights, ramps, cap, tables).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target", "ramp")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("offset") + F.col("inner")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    both = both.withColumns({"start": start, "epochs": epochs}).withColumn("rest", rest)
    extra = (F.col("rest") > 0) & ((2 * F.col("start") + F.col("size")) <= (2 * F.col("rest")))
    copies = F.col("epochs") + F.when(extra, 1).otherwise(0)
    both = both.withColumn("copies", F.when(F.col("source_size") > 0, F.least(copies, F.lit(cap).cast("long"))).otherwise(F.lit(0).cast("long")))
    demand = (2 * F.col("start") + F.col("size")) / (F.lit(2.0) * F.nullif(F.col("target"), F.lit(0.0)))
    both = both.withColumns({"u": F.when(F.col("copies") > 0, demand), "step": F.col("source_size") / F.nullif(F.col("target"), F.lit(0.0))})
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", _position(F.col("u"), F.col("ramp")).alias("position"), "u", "step", "ramp", *(["doc"] if carry else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The training order: each document as often as it is taken, all columns of
    `docs`, range-sorted by position."""
    planned = assign(docs, id_col, text_col, source_col, carry=docs.columns, **options).where("copies > 0")
    copies = planned.select("doc", "u", "step", "ramp", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    placed = copies.withColumn("position", _position(F.col("u") + F.col("copy") * F.col("step"), F.col("ramp")))
    return placed.orderBy("position", "doc_id", "copy").select("doc.*")
