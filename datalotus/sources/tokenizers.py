"""Word tokenizers by name. A missing library is an error, never a silent split."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENGINES = ("pythainlp", "nlpo3", "attacut")
ORDERS = {"auto": ENGINES, "auto-fast": ("nlpo3", "pythainlp", "attacut"), "auto-quality": ("attacut", "pythainlp", "nlpo3")}


def available_engines() -> list[str]:
    return [e for e in ENGINES if importlib.util.find_spec(e)]


def _load(engine: str) -> Callable[[str], list[str]]:
    if engine == "pythainlp":
        from pythainlp import word_tokenize

        return lambda s: word_tokenize(s, keep_whitespace=False)
    if engine == "nlpo3":
        from nlpo3 import segment

        return lambda s: [t for t in segment(s, "default") if t.strip()]
    from attacut import tokenize

    return lambda s: [t for t in tokenize(s) if t.strip()]


def get_tokenizer(engine: str = "auto") -> Callable[[Column], Column]:
    """A function from a text column to an array of tokens."""
    if engine == "whitespace":
        return lambda c: F.filter(F.split(c, "(?U)\\s+"), lambda t: t != "")
    if engine not in ORDERS and engine not in ENGINES:
        raise ValueError(f"unknown tokenizer {engine!r}")
    chosen = next((e for e in ORDERS.get(engine, (engine,)) if importlib.util.find_spec(e)), None)
    if chosen is None:
        raise ImportError(f"no tokenizer of {ORDERS.get(engine, (engine,))} is installed")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        cut = _load(chosen)
        return texts.map(lambda s: None if s is None else cut(s))

    return split


def iob_entities(tagged: list[tuple[str, str]]) -> list[dict]:
    """Tagged tokens to entities with offsets; an orphan I- starts one."""
    out: list[dict] = []
    at = 0
    for token, tag in tagged:
        kind = re.sub("^[BI]-", "", tag)
        if tag == "O":
            pass
        elif tag.startswith("I-") and out and out[-1]["end"] == at and out[-1]["type"] == kind:
            out[-1]["text"] += token
            out[-1]["end"] += len(token)
        else:
            out.append({"text": token, "type": kind, "start": at, "end": at + len(token)})
        at += len(token)
    return out
