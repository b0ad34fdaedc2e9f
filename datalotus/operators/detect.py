"""Semantic column types from one wide aggregate; rules run on the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalotus.functions import text as X
from datalotus.operators.stats import distinct_counts

TYPES = ("numeric", "categorical", "thai_text", "english_text", "mixed_text", "datetime", "id", "phone_number", "empty")
_REVIEW = re.compile(r"(?i)review|comment|feedback|message|text|note|description|ความเห็น|รีวิว")
_INDEX = re.compile(r"(?i)^(rownames|index|idx|#|seq|no|row|row_?id|unnamed.*)$")
_GEO = re.compile(r"(?i)(^|_)(lat|lon|lng|long|latitude|longitude)($|_)")
_PHONE = re.compile(r"(?i)phone|tel|mobile|โทร")


def is_id_name(name: str) -> bool:
    return name.lower() == "id" or name.lower().endswith("_id")


def hints_id(name: str) -> bool:
    return name.lower().endswith("id") or bool(re.search(r"(?i)postal|zip", name))


def hints_geo(name: str) -> bool:
    return bool(_GEO.search(name))


def is_index_name(name: str) -> bool:
    return bool(_INDEX.match(name.strip()))


def _facts(df: DataFrame, f: T.StructField) -> list:
    c = F.col(f"`{f.name}`")
    text = c.cast("string")
    q = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    out = [F.count(c).alias("n")]
    if isinstance(f.dataType, T.NumericType):
        out += [F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), q(c.cast("double") == F.floor(c.cast("double"))).alias("whole")]
    if isinstance(f.dataType, T.StringType):
        words = F.size(F.split(X.strip(text), "(?U)\\s+"))
        out += [
            q(X.is_phone(text)).alias("phone"), q(X.is_number(text)).alias("number"), q(X.is_date_like(text)).alias("date"), q(text.rlike("^[A-Za-z]+[-_]?[0-9]")).alias("coded"), q(text.rlike(X.SPACE)).alias("spaced"),
            F.avg(F.length(text)).alias("length"), F.avg(X.thai_content_ratio(text)).alias("thai"), F.avg(X.latin_content_ratio(text)).alias("latin"), F.avg(words).alias("words"), q(X.latin_content_ratio(text) > 0.5).alias("latin_cells"),
        ]
    return out


def column_facts(df: DataFrame) -> dict[str, dict]:
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    r = df.agg(*[F.struct(*_facts(df, f)).alias(f"c{i}") for i, f in enumerate(flat)]).first()
    distinct = {x.column: x.distinct for x in distinct_counts(df, [f.name for f in flat]).collect()}
    return {f.name: r[f"c{i}"].asDict() | {"type": f.dataType, "d": distinct[f.name]} for i, f in enumerate(flat)}


def column_type(name: str, x: dict) -> str:
    n, d, kind = x["n"], x["d"], x["type"]
    if not n:
        return "empty"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if is_id_name(name):
        return "id"
    ratio = d / n
    if isinstance(kind, T.NumericType):
        serial = is_index_name(name) and x["whole"] == n and n >= 50 and x["lo"] >= 0 and d >= 50 and d / max(1.0, x["hi"] - x["lo"] + 1) >= 0.97 and ratio >= 0.5
        return "id" if (ratio >= 0.95 and n >= 5 and hints_id(name)) or serial else "numeric"
    if isinstance(kind, T.BooleanType):
        return "categorical"
    if x["phone"] >= 0.7 * n or (_PHONE.search(name) and x["phone"] >= 0.5 * n):
        return "phone_number"
    if x["number"] >= 0.95 * n:
        return "categorical" if d == 1 else "id" if hints_id(name) and ratio >= 0.95 else "numeric"
    if x["date"] >= 0.85 * n and x["coded"] < 0.6 * n:
        return "datetime"
    if ratio >= 0.95 and not x["spaced"] and x["length"] <= 40 and x["thai"] < 0.5 and (hints_id(name) or x["length"] <= 24) and n >= 5:
        return "id"
    if d <= 20 and x["length"] < 15 and not _REVIEW.search(name):
        return "categorical"
    thai, latin = x["thai"], x["latin"]
    if thai >= 0.5:
        return "thai_text" if latin < 0.2 else "mixed_text"
    if thai >= 0.15:
        return "mixed_text"
    if (d < 50 or ratio < 0.05) and x["words"] < 4:
        return "categorical"
    return "english_text" if x["latin_cells"] > 0.3 * n or x["words"] >= 2 else "categorical"


def detect_all(df: DataFrame) -> dict[str, str]:
    return {name: column_type(name, x) for name, x in column_facts(df).items()}


def duplicate_names(names: list[str]) -> list[str]:
    return sorted({n for n in names if names.count(n) > 1})


def ensure_unique(df: DataFrame) -> None:
    if twice := duplicate_names(df.columns):
        raise ValueError(f"column names occur twice: {twice}")


def dataset_kind(types: dict[str, str], rows: int, target: str | None = None) -> str:
    """transaction, registry, survey, timeseries, ml_tabular or mixed."""
    n = lambda *k: sum(t in k for t in types.values())
    score = {
        "transaction": 2 * bool(n("id")) + 2 * bool(n("datetime")) + 2 * any(re.search(r"(?i)amount|price|total|qty|quantity|revenue", c) for c in types),
        "registry": 3 * bool(n("phone_number")) + 2 * any(re.search(r"(?i)citizen|name|address", c) for c in types) + bool(n("id")),
        "survey": 2 * bool(n("thai_text", "english_text", "mixed_text")) + 2 * any(_REVIEW.search(c) for c in types) + 2 * any(re.search(r"(?i)rating|score|satisf", c) for c in types),
        "timeseries": 3 * (n("datetime") == 1 and n("numeric") >= 1 and n("categorical", "id") == 0) + 2 * bool(n("datetime")),
        "ml_tabular": (4 if target else 0) + 2 * (n("numeric") >= 3),
    }
    best = sorted(score.items(), key=lambda kv: -kv[1])
    return "mixed" if best[0][1] < 4 or (best[0][1] - best[1][1] < 1 and best[1][1] >= 4) else best[0][0]
