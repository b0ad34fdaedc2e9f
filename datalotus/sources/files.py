"""Reading and writing tables: format, encoding, delimiter and header are sniffed
from a file's first bytes; the scan itself is Spark's."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".orc": "orc", ".xlsx": "excel", ".xls": "excel"}
ENCODINGS = ("utf-8", "tis-620", "cp874", "cp1252")
_ALIASES = {"ascii": "utf-8", "iso-8859-11": "tis-620", "windows-874": "cp874", "utf-8-sig": "utf-8"}
_JAVA = {"cp874": "x-windows-874", "cp1252": "windows-1252", "tis-620": "TIS-620"}
MISSING = ("", "?", "NA", "N/A", "na", "null", "None")
_HEAD = 1 << 16


def normalize_encoding(name: str) -> str:
    return _ALIASES.get(name.lower(), name.lower())


def detect_encoding(path: str) -> str:
    raw = open(path, "rb").read(_HEAD)
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    for name in ENCODINGS:
        try:
            (raw[:-3] if name == "utf-8" and len(raw) == _HEAD else raw).decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "cp1252"


def sniff_format(path: str) -> str:
    head = open(path, "rb").read(4096)
    if head[:4] == b"PAR1":
        return "parquet"
    text = head.lstrip(b"\xef\xbb\xbf").decode("utf-8", "replace").lstrip()
    if text.startswith("["):
        return "json"
    lines = [line for line in text.splitlines() if line.strip()]
    return "jsonl" if lines and sum(line.startswith("{") for line in lines) > len(lines) / 2 else "csv"


def detect_format(path: str) -> str:
    p = Path(path)
    return FORMATS.get(p.suffix.lower()) or ("parquet" if p.is_dir() else sniff_format(path))


def sniff_delimiter(line: str) -> str:
    return max(",;\t", key=lambda d: (line.count(d), -",;\t".index(d)))


def _is_value(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return cell.strip() in MISSING
    return True


def sniff_csv(path: str, encoding: str) -> tuple[str, bool]:
    """(delimiter, whether there is a header)."""
    text = open(path, "rb").read(_HEAD).decode(encoding, "replace").lstrip("﻿")
    lines = text.splitlines()[:2]
    if not lines:
        return ",", True
    sep = sniff_delimiter(lines[0])
    return sep, not all(_is_value(c.strip('"')) for line in lines for c in line.split(sep))


def read_data(spark: SparkSession, path: str, format: str = "auto", encoding: str = "auto", *, infer: bool = True) -> DataFrame:
    """A table from a file or folder. NaN becomes null."""
    kind = detect_format(path) if format == "auto" else format
    if kind in ("csv", "tsv"):
        code = detect_encoding(path) if encoding == "auto" else normalize_encoding(encoding)
        sep, header = sniff_csv(path, code)
        if code not in ("utf-8", "iso-8859-1"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark refuses other charsets otherwise
        reader = spark.read.option("sep", "\t" if kind == "tsv" else sep).option("header", header).option("encoding", _JAVA.get(code, code)).option("inferSchema", infer).option("nullValue", "" if header else "?").option("multiLine", True).option("escape", '"')
        df = reader.csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns]) if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns) - 1)], "target")
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "json":
        df = spark.read.option("multiLine", True).json(path)
    elif kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
    elif kind == "excel":
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path))  # a workbook is small by its format's row limit
    else:
        raise ValueError(f"unsupported format {kind!r}")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in reals}) if reals else df


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the same ones on every run."""
    return df.orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns], F.lit(seed))).limit(n)


def list_tables(folder: str, pattern: str = "*", recursive: bool = False) -> list[str]:
    root = Path(folder)
    found = root.rglob(pattern) if recursive else root.glob(pattern)
    return sorted(str(p) for p in found if p.suffix.lower() in FORMATS)


def read_folder(spark: SparkSession, folder: str, **options: object) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables by name, and the errors of files that can't be read."""
    tables, errors = {}, {}
    for path in list_tables(folder):
        name = Path(path).stem
        try:
            tables[name if name not in tables else f"{name}_{len(tables)}"] = read_data(spark, path, **options)
        except Exception as e:  # noqa: BLE001  reported to the caller, file by file
            errors[path] = f"{type(e).__name__}: {e}"
    return tables, errors


def write_data(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if format in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if format == "tsv" else ",").option("escape", '"').csv(path)
    elif format in ("json", "jsonl"):
        writer.json(path)
    elif format in ("parquet", "orc"):
        writer.format(format).save(path)
    else:
        raise ValueError(f"unsupported format {format!r}")


def write_json_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
