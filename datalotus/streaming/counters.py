from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(events: DataFrame, ts: str, columns: list[str], width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Null counts per column and time window; works on batches and streams. A
    stream that has a watermark already is given with late=None."""
    base = events.withWatermark(ts, late) if events.isStreaming and late else events
    return base.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_missing") for c in columns]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", *[f"{c}_missing" for c in columns])


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
