"""Keys and relationships between tables: inclusion dependencies as semi and anti
joins over distinct normalised keys."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalotus.functions import text as X
from datalotus.operators.stats import distinct_counts


def key_candidates(df: DataFrame, table: str = "") -> DataFrame:
    """table, column, rows, distinct, ratio of columns that may identify rows."""
    flat = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("boolean", "array", "map", "struct"))]
    held = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("rows")) for c in flat]).alias("all")).select(F.inline("all"))
    x = held.join(distinct_counts(df, flat), "column").withColumn("ratio", F.when(F.col("rows") > 0, F.round(F.col("distinct") / F.col("rows"), 4)).otherwise(0.0))
    named = F.col("column").rlike("(?i)(^|_)(id|key)$|id$|key$")
    is_key = (F.col("distinct") > 1) & ((named & (F.col("distinct") == F.col("rows"))) | ((F.col("rows") >= 5) & (F.col("distinct") >= 0.95 * F.col("rows"))))
    return x.where(is_key).select(F.lit(table).alias("table"), "column", "rows", "distinct", "ratio")


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNotNull()).select(X.normalize_key(F.col(f"`{column}`")).alias("k")).distinct()


def overlap(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """child_keys, parent_keys, common, orphans, overlap in one full outer join."""
    a, b = distinct_keys(child, child_column).withColumn("c", F.lit(1)), distinct_keys(parent, parent_column).withColumn("p", F.lit(1))
    s = a.join(b, "k", "full_outer").agg(F.count("c").alias("child_keys"), F.count("p").alias("parent_keys"), F.count_if(F.col("c").isNotNull() & F.col("p").isNotNull()).alias("common"))
    return s.withColumn("orphans", F.col("child_keys") - F.col("common")).withColumn("overlap", F.round(F.when(F.col("child_keys") > 0, F.col("common") / F.col("child_keys")).otherwise(0.0), 6))


def orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return distinct_keys(child, child_column).join(distinct_keys(parent, parent_column), "k", "left_anti")


def match_relationships(tables: Mapping[str, DataFrame], least: float = 0.5) -> list[dict]:
    """Links between equally named columns of two tables, one side unique; sorted by
    confidence, then names."""
    facts = {}
    for name, df in tables.items():
        flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "boolean"))]
        held = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(flat)]).first()
        for r in distinct_counts(df, flat).collect():
            facts[name, r.column] = (held[f"n{flat.index(r.column)}"], r.distinct)
    out = []
    for (ta, ca), (tb, cb) in combinations(sorted(facts), 2):
        if ta == tb or ca.strip().lower() != cb.strip().lower():
            continue
        unique = {t: facts[t, c][1] > 1 and facts[t, c][0] >= 5 and facts[t, c][1] >= 0.95 * facts[t, c][0] for t, c in ((ta, ca), (tb, cb))}
        if not (unique[ta] or unique[tb]):
            continue
        both = unique[ta] and unique[tb]
        a_parent = facts[ta, ca][1] >= facts[tb, cb][1] if both else unique[ta]
        parent, child = ((ta, ca), (tb, cb)) if a_parent else ((tb, cb), (ta, ca))
        r = overlap(tables[child[0]], child[1], tables[parent[0]], parent[1]).first()
        share = r.overlap
        if (both or share < 0.5) and r.parent_keys and unique[child[0]] and r.common / r.parent_keys > share:
            parent, child, share = child, parent, r.common / r.parent_keys
        if share >= least:
            out.append({"child": child[0], "parent": parent[0], "column": child[1], "cardinality": "1:1" if both and facts[ta, ca][1] == facts[tb, cb][1] else "1:N", "overlap": share, "confidence": min(1.0, 0.4 + 0.6 * share), "orphans": r.orphans})
    return sorted(out, key=lambda r: (-r["confidence"], r["child"], r["parent"], r["column"]))


def to_mermaid(tables: Mapping[str, DataFrame], links: list[dict]) -> str:
    """An entity-relationship diagram as text."""
    plain = lambda s: re.sub(r"[^A-Za-z0-9_]", "_", s)
    parents, children = {(r["parent"], r["column"]) for r in links}, {(r["child"], r["column"]) for r in links}
    lines = ["erDiagram"]
    for name, df in tables.items():
        lines.append(f"    {plain(name)} {{")
        lines += [f"        {plain(t)} {plain(c)}{' PK' if (name, c) in parents else ' FK' if (name, c) in children else ''}" for c, t in df.dtypes]
        lines.append("    }")
    lines += [f"    {plain(r['parent'])} {'||--||' if r['cardinality'] == '1:1' else '||--o{'} {plain(r['child'])} : {plain(r['column'])}" for r in links]
    return "\n".join(lines)
