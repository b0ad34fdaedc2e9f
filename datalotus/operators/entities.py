"""Named entities by an optional library; rows of (row, type, text, start, end)."""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalotus.sources.tokenizers import iob_entities

ENTITY = "array<struct<text:string,type:string,start:int,end:int>>"


def ner_available() -> bool:
    return importlib.util.find_spec("pythainlp") is not None


def extract_entities(df: DataFrame, column: str, engine: str = "thainer") -> DataFrame:
    if not ner_available():
        raise ImportError("named entities need pythainlp")

    @F.pandas_udf(ENTITY)
    def find(texts: pd.Series) -> pd.Series:
        from pythainlp.tag import NER

        model = NER(engine)
        return texts.map(lambda s: [] if not s else iob_entities([(t[0], t[-1]) for t in model.tag(s)]))

    return df.select(F.explode(find(F.col(f"`{column}`"))).alias("e")).select("e.*")


def entity_summary(entities: DataFrame, k: int = 20) -> DataFrame:
    """type, text, n: the k most frequent of each type."""
    from pyspark.sql.window import Window

    c = entities.groupBy("type", "text").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "text"))).where(F.col("r") <= k).drop("r")
