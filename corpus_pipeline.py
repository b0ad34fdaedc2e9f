"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read back as the next stage's docs. A stage therefore begins by
deleting the intermediate tables of the stage before it over the same input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalotus.llm import bpe_codec, exact_dedup, language_id, mixing, near_dedup
from datalotus.llm.common import Tables, keep
from datalotus.session import ship

#: A document goes if its text has no letter or its language is this uncertain.
LEAST_SCORE = 0.4

_OWNED: dict[tuple[str, str], Tables] = {}


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The stage's intermediate tables. Those of the stage before it over the same
    input are deleted: its result is written by now."""
    ship(spark)
    owner = (spark.sparkContext.applicationId, sf_dir)
    if owner in _OWNED:
        _OWNED[owner].release()
    _OWNED[owner] = Tables(spark)
    return _OWNED[owner]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found. Null texts, texts without a letter and
    texts with a score under `LEAST_SCORE` go; repeated rows, null ids and long texts
    are judged like all others; other columns, also those named lang_pred or
    lang_score, are returned as they are; an empty table stays empty."""
    _tables(spark, sf_dir)
    done = language_id.judge(docs, language_id.fit(docs))
    return done.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id (a null one is smallest).
    A null text is the empty text; of rows repeated with one doc_id one stays;
    other columns are returned as they are; an empty table stays empty."""
    return exact_dedup.dedup(docs, tables=_tables(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.
    Null and empty texts are near to nothing and stay; rows repeated with one doc_id
    and text stay or go together; a row without doc_id goes only if its group has an
    id; other columns are returned as they are; an empty table stays empty."""
    return near_dedup.dedup(docs, tables=_tables(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the target mix: each document as often as it is taken,
    three times at most. Null and empty texts have no words, so they are taken as
    often as their source's words; a null source is a source of its own, the last;
    other columns are returned as they are; an empty table stays empty."""
    return mixing.mix(docs, tables=_tables(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row. A null text is
    empty; repeated rows each keep their row; other columns are ignored; an empty
    table stays empty."""
    _tables(spark, sf_dir)
    return bpe_codec.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Language models and BPE can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
