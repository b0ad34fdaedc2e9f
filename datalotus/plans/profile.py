"""The facade: profile a table, clean it, compare before and after, write reports."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalotus.operators import anomaly, clean, detect, insight, quality, relate, stats, timeseries
from datalotus.plans.narrative import executive_summary, narrative
from datalotus.sources import files


@dataclass
class Profile:
    overview: dict
    types: dict[str, str]
    kind: str
    findings: list[dict]
    score: dict
    anomalies: list[dict]
    stats: list[dict]
    insights: list[dict]
    series: dict
    story: dict
    cleaning: list[dict] = field(default_factory=list)
    before: dict = field(default_factory=dict)
    cleaned: DataFrame | None = None

    def to_dict(self) -> dict:
        return asdict(self.__class__(**{k: v for k, v in self.__dict__.items() if k != "cleaned"}))

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.to_dict(), ensure_ascii=False, indent=2, default=str)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text

    def to_html(self, path: str | None = None) -> str:
        table = lambda rows: "<table><tr>" + "".join(f"<th>{html.escape(str(k))}</th>" for k in (rows[0] if rows else {})) + "</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"
        parts = [f"<h1>{html.escape(self.story['headline'])}</h1>", f"<p>{html.escape(executive_summary(self.findings))}</p>"]
        for title, rows in (("Findings", self.findings), ("Anomalies", self.anomalies), ("Statistics", self.stats), ("Insights", self.insights), ("Cleaning", self.cleaning)):
            parts.append(f"<h2>{title}</h2>{table(rows)}")
        text = "<!doctype html><meta charset='utf-8'><style>table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style>" + "".join(parts)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text


def all_findings(df: DataFrame, thai: bool = True) -> list[dict]:
    rows = [r.asDict() for r in quality.findings(df, thai=thai).collect()]
    d = quality.duplicate_rows(df).first()
    n = df.count()
    if d.in_groups:
        rows.append({"check_name": "duplicate_rows", "severity": "warning", "column": "_dataset_", "count": d.in_groups, "percentage": round(100.0 * d.in_groups / n, 2)})
    rank = {"critical": 0, "warning": 1, "info": 2}
    return sorted(rows, key=lambda r: (rank[r["severity"]], -r["percentage"], r["column"], r["check_name"]))


def profile(df: DataFrame, *, clean_first: bool = False, target: str | None = None, lang: str = "en", top: int = 8, with_series: bool = True, with_insights: bool = True) -> Profile:
    """Profile a table; a fixed number of passes, whatever the number of columns."""
    detect.ensure_unique(df)
    before, log = {}, []
    types = detect.detect_all(df)
    thai = any("thai" in t or t == "mixed_text" for t in types.values())
    if clean_first:
        first = all_findings(df, thai)
        before = quality.quality_score(df.sparkSession.createDataFrame(first, quality.FINDING), len(df.columns)).first().asDict()
        df, audit = clean.clean(df)
        log = [r.asDict() for r in audit.collect()]
        types = detect.detect_all(df)
    df = df.persist()
    try:
        found = all_findings(df, thai)
        score = quality.quality_score(df.sparkSession.createDataFrame(found, quality.FINDING), len(df.columns)).first().asDict()
        numeric = [c for c, t in types.items() if t == "numeric" and dict(df.dtypes)[c] != "string"]
        times = [c for c, t in types.items() if t == "datetime" and dict(df.dtypes)[c] != "string"]
        over = quality.overview(df).first().asDict()
        cards = insight.discover(df, types, top) if with_insights else []
        series = {c: timeseries.analyze(df, times[0], c) for c in numeric[:20]} if with_series and times else {}
        return Profile(over, types, detect.dataset_kind(types, over["rows"], target), found, score, [r.asDict() for r in anomaly.findings(df, thai=thai).collect()], [r.asDict() for r in stats.basic_stats(df, numeric).collect()] if numeric else [], cards, series, narrative(over, found, score, cards, lang), log, before, df if clean_first else None)
    finally:
        df.unpersist()


def profile_dataset(spark: SparkSession, folder: str) -> dict:
    """Keys, relationships and a diagram of all tables of a folder."""
    tables, errors = files.read_folder(spark, folder)
    links = relate.match_relationships(tables)
    keys = [r.asDict() for name, df in tables.items() for r in relate.key_candidates(df, name).collect()]
    return {"tables": sorted(tables), "errors": errors, "keys": keys, "links": links, "diagram": relate.to_mermaid(tables, links)}


def run_folder(spark: SparkSession, folder: str, output: str | None = None, **options: object) -> dict[str, Profile | str]:
    """Each file on its own; one that fails gives its error."""
    out: dict[str, Profile | str] = {}
    for path in files.list_tables(folder):
        try:
            out[path] = profile(files.read_data(spark, path), **options)
            if output:
                Path(output).mkdir(parents=True, exist_ok=True)
                out[path].to_html(str(Path(output) / f"{Path(path).stem}.html"))
        except Exception as e:  # noqa: BLE001  reported to the caller, file by file
            out[path] = f"{type(e).__name__}: {e}"
    return out


def analyze_target(df: DataFrame, target: str, features: list[str] | None = None) -> list[dict]:
    """Association of each feature with the target: Pearson, ANOVA or chi-square."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] not in ("string", "boolean", "timestamp", "timestamp_ntz", "date")
    out = []
    for c in features or [c for c in df.columns if c != target]:
        if numeric(c) and numeric(target):
            r = df.agg(stats.safe_corr(df[c], df[target]).alias("r"), F.count(df[c]).alias("n")).first()
            if r.r is None or r.n < 3:
                continue
            t = r.r * ((r.n - 2) / max(1e-12, 1 - r.r**2)) ** 0.5
            out.append({"feature": c, "test": "pearson", "score": r.r, "p": stats.p_from_t(df.sparkSession, t, r.n - 2)})
        elif numeric(c) != numeric(target):
            a = stats.anova(df, *((target, c) if numeric(c) else (c, target))).first()
            if a.f is not None:
                out.append({"feature": c, "test": "anova", "score": a.eta, "p": stats.p_from_f(df.sparkSession, a.f, a.groups - 1, a.n - a.groups)})
        else:
            x = stats.chi_square(df, c, target).first()
            if x.dof:
                out.append({"feature": c, "test": "chi2", "score": x.v, "p": stats.p_from_chi2(df.sparkSession, x.chi2, x.dof)})
    return sorted(out, key=lambda r: (r["p"], -abs(r["score"]), r["feature"]))
