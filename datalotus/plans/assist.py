"""Preparing aggregates for a language model. The call itself is a function given by
the user; what is sent depends on the privacy mode."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame

from datalotus.operators import privacy, stats
from datalotus.plans.narrative import build_prompt
from datalotus.plans.profile import Profile

MODES = ("insight_only", "summary", "anonymized", "synthetic", "noisy")


def prepare(df: DataFrame, result: Profile, mode: str = "insight_only", epsilon: float = 1.0, rows: int = 20) -> dict:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    out: dict = {"mode": mode, "overview": result.overview}
    numeric = [s["column"] for s in result.stats]
    if mode in ("summary", "noisy") and numeric:
        table = [r.asDict() for r in stats.basic_stats(df, numeric).collect()]
        out["summary"] = table if mode == "summary" else [{"column": r["column"], **privacy.noisy_summary({k: r[k] for k in ("count", "mean", "min", "max", "distinct")}, epsilon)} for r in table]
    if mode == "anonymized":
        text = [c for c, t in df.dtypes if t == "string"]
        out["rows"] = [r.asDict() for r in privacy.anonymize(df, text, secrets.token_hex(16)).limit(rows).collect()]
    if mode == "synthetic":
        out["rows"] = [r.asDict() for r in privacy.synthetic(df, rows).collect()]
    return out


def analyze(df: DataFrame, result: Profile, call: Callable[[str], str], mode: str = "insight_only", lang: str = "en") -> str:
    ready = prepare(df, result, mode)
    prompt = build_prompt(result.overview, result.findings, result.insights, lang)
    extra = {k: v for k, v in ready.items() if k not in ("mode", "overview")}
    return call(prompt + (f"\n\n{extra}" if extra else ""))
