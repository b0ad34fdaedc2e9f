"""Deterministic summaries in English or Thai."""

from __future__ import annotations

LABELS = {
    "en": {"rows": "rows", "columns": "columns", "score": "Quality score", "issues": "Issues", "none": "No issue was found.", "next": "Next steps", "missing": "has missing values", "insights": "Insights"},
    "th": {"rows": "แถว", "columns": "คอลัมน์", "score": "คะแนนคุณภาพ", "issues": "ปัญหา", "none": "ไม่พบปัญหา", "next": "ขั้นตอนต่อไป", "missing": "มีค่าว่าง", "insights": "ข้อค้นพบ"},
}
ADVICE = {"missing": "Decide how to fill or drop missing values", "zero_width": "Strip zero-width characters", "thai_numerals": "Convert Thai digits", "duplicate_rows": "Remove repeated rows", "buddhist_era": "Convert years to one era", "phone_format": "Check phone numbers", "thai_id": "Check identity numbers", "whitespace": "Normalise white space", "placeholder": "Turn placeholders into nulls", "constant_column": "Drop constant columns"}
_RANK = {"critical": 0, "warning": 1, "info": 2}


def label(key: str, lang: str = "en") -> str:
    return LABELS[lang].get(key, key)


def narrative(overview: dict, findings: list[dict], score: dict, cards: list[dict], lang: str = "en") -> dict:
    """headline, up to five findings, six recommendations, five questions."""
    words = LABELS[lang]
    order = sorted(findings, key=lambda f: (_RANK[f["severity"]], -f["percentage"], f["column"], f["check_name"]))
    return {
        "headline": f"{overview['rows']:,} {words['rows']}, {overview['columns']} {words['columns']}. {words['score']}: {score['score']:g} ({score['grade']}).",
        "findings": [f"{f['column']}: {f['check_name']} ({f['count']}, {f['percentage']:g} %)" for f in order[:5]] or [words["none"]],
        "recommendations": list(dict.fromkeys(ADVICE[f["check_name"]] for f in order if f["check_name"] in ADVICE))[:6],
        "questions": [f"Why is {c['key']} {c['pattern']} in {c['measure']} by {c['breakdown']}?" for c in cards[:5]],
    }


def executive_summary(findings: list[dict], lang: str = "en") -> str:
    n = {s: sum(f["severity"] == s for f in findings) for s in _RANK}
    return f"{LABELS[lang]['issues']}: {n['critical']} critical, {n['warning']} warning, {n['info']} info"


def build_prompt(overview: dict, findings: list[dict], cards: list[dict], lang: str = "en") -> str:
    """A prompt of aggregates only; no row of the table is in it."""
    lines = [f"# Table of {overview['rows']} rows and {overview['columns']} columns", "", "## Findings"]
    lines += [f"- {f['column']}: {f['check_name']} ({f['severity']}, {f['count']})" for f in findings[:20]]
    lines += ["", "## Insights", *[f"- {c['pattern']}: {c['key']} ({c['measure']} by {c['breakdown']})" for c in cards[:20]], "", f"Answer in {lang}."]
    return "\n".join(lines)
