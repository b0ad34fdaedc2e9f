"""All queries of the profiling engine and the SQL they are checked against.

The driver's tables are clean and have no Thai text, so defects are planted by
deterministic projections. Their expressions are valid in both dialects and are
used word for word on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalotus.functions import text as X
from datalotus.operators import advice, anomaly, charts, clean, corpus, detect, insight, privacy, quality, relate, stats, timeseries
from datalotus.streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_BASE = "lpad(CAST(100000000000 + c_custkey * 7919 AS STRING), 12, '0')"
_SUM = " + ".join(f"{13 - i} * CAST(substr({_BASE}, {i + 1}, 1) AS INT)" for i in range(12))
#: Customers as a contact list with planted defects.
CONTACTS = {
    "id": "c_custkey",
    "name": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 19 = 0 THEN '​' || c_name WHEN c_custkey % 23 = 0 THEN replace(c_name, '#', ' ') ELSE c_name END",
    "phone": "CASE WHEN c_custkey % 5 = 0 THEN '+66 8' || lpad(CAST(c_custkey AS STRING), 8, '1') WHEN c_custkey % 5 = 1 THEN '08' || lpad(CAST(c_custkey AS STRING), 8, '2') WHEN c_custkey % 5 = 2 THEN '8' || lpad(CAST(c_custkey AS STRING), 8, '3') WHEN c_custkey % 5 = 3 THEN '081-' || lpad(CAST(c_custkey AS STRING), 7, '4') ELSE '12345' || lpad(CAST(c_custkey AS STRING), 6, '5') END",
    "citizen_id": f"CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN {_BASE} || '0' WHEN c_custkey % 11 = 0 THEN substr({_BASE}, 1, 9) ELSE {_BASE} || CAST((11 - ({_SUM}) % 11) % 10 AS STRING) END",
    "join_year": "CASE WHEN c_custkey % 4 = 0 THEN 2500 + c_custkey % 60 ELSE 1990 + c_custkey % 30 END",
    "points": "translate(CAST(c_custkey * 37 AS STRING), CASE WHEN c_custkey % 6 = 0 THEN '0123456789' ELSE '' END, CASE WHEN c_custkey % 6 = 0 THEN '๐๑๒๓๔๕๖๗๘๙' ELSE '' END)",
    "amount": "CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 10 = 0 THEN '-' WHEN c_custkey % 14 = 0 THEN '฿1,234.50' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END",
    "review": "CASE WHEN c_custkey % 3 = 0 THEN 'สินค้าดีมาก จัดส่งเร็ว' WHEN c_custkey % 31 = 0 THEN 'ดีมากกกกก 55555' WHEN c_custkey % 37 = 0 THEN 'l;ylfu8iy[' WHEN c_custkey % 41 = 0 THEN 'ร้าาน ก่่อน' ELSE 'บริการดี ' || c_mktsegment END",
    "segment": "CASE WHEN c_custkey % 43 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 301 = 0 THEN 'RARE' ELSE c_mktsegment END",
    "balance": "CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 211 = 0 THEN c_acctbal * 40 ELSE c_acctbal END",
    "score": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END",
    "source": "'web'",
}
#: Orders with a repeated part: every fifth row stands twice.
SALES = {"order_id": "o_orderkey", "cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "ts": "o_orderdate", "priority": "o_orderpriority"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for a, e in columns.items()])


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(read(spark, sf_dir, "customer"), CONTACTS)


def sql_of(columns: Mapping[str, str], table: str) -> str:
    return f"(SELECT {', '.join(f'{e} AS {a}' for a, e in columns.items())} FROM {table})"


C = f"WITH c AS {sql_of(CONTACTS, 'customer')} "


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_quality_findings"](spark, sf_dir)


# --- overview, findings, score -------------------------------------------------
_NULLS = " + ".join(f"count(*) - count({c})" for c in CONTACTS)


@query(C + f"SELECT count(*) AS rows, {len(CONTACTS)}::BIGINT AS columns, count(*) * {len(CONTACTS)} AS cells, {_NULLS} AS missing, round(100.0 * ({_NULLS}) / (count(*) * {len(CONTACTS)}), 4) AS missing_pct, (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS duplicates FROM c")
def q_overview(spark, sf):
    return quality.overview(contacts(spark, sf))


ZW, TD = "[​‌‍﻿⁠]", "[๐-๙]"
_PHONE_CLEAN = "(CASE WHEN regexp_matches(regexp_replace(regexp_replace({0}, '[-(). \\s]', '', 'g'), '^\\+66', '0'), '^[689][0-9]{{8}}$') THEN '0' || regexp_replace(regexp_replace({0}, '[-(). \\s]', '', 'g'), '^\\+66', '0') ELSE regexp_replace(regexp_replace({0}, '[-(). \\s]', '', 'g'), '^\\+66', '0') END)"
PC = _PHONE_CLEAN.format("phone")
ID_SUM = " + ".join(f"{13 - i} * CAST(substr(CASE WHEN regexp_full_match(citizen_id, '[0-9]{{13}}') THEN citizen_id ELSE '0000000000000' END, {i + 1}, 1) AS INT)" for i in range(12)).replace("{{", "{").replace("}}", "}")
ID_OK = f"(citizen_id IS NOT NULL AND regexp_full_match(citizen_id, '[0-9]{{13}}') AND CAST((11 - ({ID_SUM}) % 11) % 10 AS VARCHAR) = substr(citizen_id, 13, 1))"
BLANKS = ", ".join("'" + p + "'" for p in X.PLACEHOLDERS)


def _finding(name: str, severity: str, column: str, count: str, base: str, when: str | None = None) -> str:
    return f"SELECT '{name}' AS check_name, {severity} AS severity, '{column}' AS \"column\", ({count})::BIGINT AS count, round(100.0 * ({count}) / ({base}), 2) AS percentage FROM c HAVING {when or f'({count}) > 0'}"


def _missing(c: str) -> str:
    lost = f"(count(*) - count({c}))"
    return _finding("missing", f"CASE WHEN {lost} >= 0.5 * count(*) THEN 'critical' WHEN {lost} > 0.05 * count(*) THEN 'warning' ELSE 'info' END", c, lost, "count(*)", f"{lost} >= 0.01 * count(*) AND count({c}) > 0")


@query(C + " UNION ALL ".join([
    *[_missing(c) for c in ("name", "citizen_id", "balance", "score")],
    _finding("constant_column", "'info'", "source", "count(source)", "count(source)", "min(source) = max(source)"),
    _finding("zero_width", "'critical'", "name", f"count(*) FILTER (regexp_matches(name, '{ZW}'))", "count(name)"),
    _finding("whitespace", "'warning'", "name", "count(*) FILTER (name <> trim(name, '  ') OR name LIKE '%  %' OR name LIKE '% %')", "count(name)"),
    _finding("thai_numerals", "'warning'", "points", f"count(*) FILTER (regexp_matches(points, '{TD}'))", "count(points)"),
    _finding("placeholder", "CASE WHEN true THEN 'warning' END", "amount", f"count(*) FILTER (lower(trim(amount)) IN ({BLANKS}))", "count(amount)"),
    _finding("phone_format", "'warning'", "phone", f"count(*) FILTER (length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 9 AND 12 AND NOT regexp_full_match({PC}, '0[0-9]{{9}}'))", "count(phone)"),
    _finding("thai_id", "'critical'", "citizen_id", f"count(*) FILTER (NOT {ID_OK})", "count(*)"),
    _finding("buddhist_era", "'critical'", "join_year", "count(*) FILTER (join_year BETWEEN 2440 AND 2599)", "count(join_year)"),
]))
def q_quality_findings(spark, sf):
    df = contacts(spark, sf)
    keep = ("missing", "constant_column", "zero_width", "thai_numerals", "phone_format", "thai_id", "buddhist_era")
    f = quality.findings(df)
    return f.where(F.col("check_name").isin(*keep) | ((F.col("check_name") == "whitespace") & (F.col("column") == "name")) | (F.col("check_name") == "placeholder"))


@query("WITH f AS (" + SQL["q_quality_findings"] + "), s AS (SELECT greatest(0, least(100, 100 * (1 - sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 1 ELSE 0.2 END * percentage / 100) / " + f"{len(CONTACTS)}))) AS x, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f) SELECT round_even(x, 1) AS score, critical, warning, info, CASE WHEN x >= 90 THEN 'A' WHEN x >= 80 THEN 'B' WHEN x >= 70 THEN 'C' WHEN x >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def q_quality_score(spark, sf):
    return quality.quality_score(q_quality_findings(spark, sf), len(CONTACTS))


@query("WITH d AS (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(l_quantity AS INT) AS q FROM lineitem), g AS (SELECT count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS in_groups, coalesce(sum(n - 1), 0)::BIGINT AS beyond_first, count(*) AS groups FROM (SELECT count(*) AS n FROM d GROUP BY l_returnflag, l_linestatus, l_linenumber, q HAVING count(*) > 1)")
def q_duplicate_rows(spark, sf):
    return quality.duplicate_rows(read(spark, sf, "lineitem").selectExpr("l_returnflag", "l_linestatus", "l_linenumber", "CAST(l_quantity AS INT) AS q"))


@query("WITH d AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS b, o_orderkey AS rid FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rid) AS k FROM d) SELECT a, b, rid FROM r WHERE k = 1 OR (a IS NULL AND b IS NULL)")
def q_dedup_keep_first(spark, sf):
    d = read(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS a", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS b", "o_orderkey AS rid")
    return clean.drop_duplicates(d, order_by="rid")


# --- cell-level expressions ----------------------------------------------------
@query(C + f"SELECT id, phone, {PC} AS cleaned, regexp_full_match({PC}, '0[0-9]{{9}}') AS ok FROM c")
def q_phone(spark, sf):
    return contacts(spark, sf).select("id", "phone", X.clean_phone(F.col("phone")).alias("cleaned"), X.is_phone(F.col("phone")).alias("ok"))


@query(C + f"SELECT id, {ID_OK} AS valid FROM c")
def q_citizen_id(spark, sf):
    return contacts(spark, sf).select("id", X.valid_citizen_id(F.col("citizen_id")).alias("valid"))


@query(C + "SELECT id, round(len(regexp_extract_all(review, '[฀-๏๚-๿]'))::DOUBLE / length(review), 6) AS thai, round(len(regexp_extract_all(review, '[A-Za-z]'))::DOUBLE / length(review), 6) AS latin, round(len(regexp_extract_all(review, '[0-9]'))::DOUBLE / length(review), 6) AS digit, round(len(regexp_extract_all(review, '\\s'))::DOUBLE / length(review), 6) AS whitespace FROM c")
def q_script_ratio(spark, sf):
    r = X.script_ratio(F.col("review"))
    return contacts(spark, sf).select("id", *[F.round(r[k], 6).alias(k) for k in ("thai", "latin", "digit", "whitespace")])


@query(C + "SELECT id, regexp_matches(review, '5{3,}|กกกก|าาาา|[่]{3}|;{3}') AS spam, regexp_matches(review, '่่|้้') AS tone, regexp_replace(regexp_replace(review, '่+', '่', 'g'), '้+', '้', 'g') AS fixed FROM c")
def q_normalization(spark, sf):
    c = F.col("review")
    return contacts(spark, sf).select("id", X.repeated_char_spam(c).alias("spam"), X.tone_stacked(c).alias("tone"), X.fix_tone_stacking(c).alias("fixed"))


@query(C + f"SELECT id, regexp_replace(name, '{ZW}', '', 'g') AS no_zero_width, trim(regexp_replace(replace(name, ' ', ' '), ' {{2,}}', ' ', 'g')) AS squeezed, translate(points, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS points FROM c")
def q_clean_cells(spark, sf):
    return contacts(spark, sf).select("id", X.strip_zero_width(F.col("name")).alias("no_zero_width"), X.squeeze(F.col("name")).alias("squeezed"), X.arabic_digits(F.col("points")).alias("points"))


@query(C + "SELECT id, CASE WHEN regexp_full_match(regexp_replace(regexp_replace(amount, '฿', '', 'g'), '[,\\s]', '', 'g'), '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(regexp_replace(regexp_replace(amount, '฿', '', 'g'), '[,\\s]', '', 'g') AS DOUBLE) END AS amount, lower(trim(amount)) IN (" + BLANKS + ") AS placeholder FROM c")
def q_currency(spark, sf):
    return contacts(spark, sf).select("id", X.money(F.col("amount")).alias("amount"), X.is_placeholder(F.col("amount")).alias("placeholder"))


@query("WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ออก 15/06/' || CAST(2560 + o_orderkey % 8 AS STRING) ELSE 'on 2019-01-02' END AS t FROM orders) SELECT id, CASE WHEN id % 3 = 0 THEN 'ออก 15/06/' || CAST(2560 + id % 8 - 543 AS STRING) ELSE t END AS ce, CASE WHEN id % 3 = 0 THEN CAST(2560 + id % 8 AS INT) END AS be_year FROM d")
def q_buddhist_era(spark, sf):
    d = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'ออก 15/06/' || CAST(2560 + o_orderkey % 8 AS STRING) ELSE 'on 2019-01-02' END AS t")
    return d.select("id", X.to_common_era(F.col("t")).alias("ce"), X.buddhist_year(F.col("t")).alias("be_year"))


@query("WITH d AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 28 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' มกราคม ' ELSE ' มี.ค. ' END || CAST(2550 + o_orderkey % 20 AS STRING) AS t FROM orders) SELECT id, CAST(1 + id % 28 AS STRING) || CASE WHEN id % 2 = 0 THEN '/01/' ELSE '/03/' END || CAST(2007 + id % 20 AS STRING) AS d FROM d")
def q_thai_dates(spark, sf):
    d = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "CAST(1 + o_orderkey % 28 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' มกราคม ' ELSE ' มี.ค. ' END || CAST(2550 + o_orderkey % 20 AS STRING) AS t")
    return d.select("id", X.normalize_date(F.col("t")).alias("d"))


@query("SELECT o_orderkey AS id, CASE WHEN (month(o_orderdate), day(o_orderdate)) = (1, 1) THEN 'New Year''s Day' WHEN month(o_orderdate) = 4 AND day(o_orderdate) BETWEEN 13 AND 15 THEN 'Songkran' WHEN month(o_orderdate) = 4 AND day(o_orderdate) = 6 THEN 'Chakri Day' WHEN month(o_orderdate) = 5 AND day(o_orderdate) = 1 THEN 'Labour Day' WHEN month(o_orderdate) = 5 AND day(o_orderdate) = 4 THEN 'Coronation Day' WHEN month(o_orderdate) = 6 AND day(o_orderdate) = 3 THEN 'Queen''s Birthday' WHEN month(o_orderdate) = 7 AND day(o_orderdate) = 28 THEN 'King''s Birthday' WHEN month(o_orderdate) = 8 AND day(o_orderdate) = 12 THEN 'Mother''s Day' WHEN month(o_orderdate) = 10 AND day(o_orderdate) = 13 THEN 'King Bhumibol Memorial Day' WHEN month(o_orderdate) = 10 AND day(o_orderdate) = 23 THEN 'Chulalongkorn Day' WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 5 THEN 'Father''s Day' WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 10 THEN 'Constitution Day' WHEN month(o_orderdate) = 12 AND day(o_orderdate) = 31 THEN 'New Year''s Eve' WHEN dayofweek(o_orderdate) = 6 THEN 'Saturday' WHEN dayofweek(o_orderdate) = 0 THEN 'Sunday' ELSE '' END AS holiday FROM orders")
def q_holidays(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.holiday_name(F.col("o_orderdate")).alias("holiday"))


ADDRESS = "CAST(s_suppkey AS STRING) || '/1 หมู่ ' || CAST(s_suppkey % 9 + 1 AS STRING) || ' ต.บางพลี อ.เมือง จ.' || CASE WHEN s_suppkey % 2 = 0 THEN 'เชียงใหม่' ELSE 'ชลบุรี' END || ' ' || CAST(10000 + s_suppkey % 80000 AS STRING)"


@query("SELECT s_suppkey AS id, CAST(s_suppkey AS STRING) || '/1' AS house_no, CAST(s_suppkey % 9 + 1 AS STRING) AS moo, 'บางพลี' AS subdistrict, 'เมือง' AS district, CASE WHEN s_suppkey % 2 = 0 THEN 'เชียงใหม่' ELSE 'ชลบุรี' END AS province, CAST(10000 + s_suppkey % 80000 AS STRING) AS postal_code FROM supplier")
def q_address(spark, sf):
    return read(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{ADDRESS} AS a").select("id", X.parse_address(F.col("a")).alias("p")).select("id", "p.*")


@query("SELECT p_partkey AS id, regexp_matches('ThaiดีÂ ' || p_name, 'a') AS x, length(p_name) - length(regexp_replace(p_name, '[\\x00-\\x08]', '', 'g')) AS controls, regexp_replace(p_brand, '[0-9]', '9', 'g') AS signature FROM part")
def q_text_marks(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("ThaiดีÂ "), "p_name").rlike("a").alias("x"), X.control_count(F.col("p_name")).cast("long").alias("controls"), X.date_signature(F.col("p_brand")).alias("signature"))


# --- cleaning ------------------------------------------------------------------
@query(C + f"SELECT 'zwspace' AS operation, 'name' AS \"column\", count(*) AS rows_affected FROM c WHERE regexp_matches(name, '{ZW}') UNION ALL SELECT 'whitespace', 'name', count(*) FROM c WHERE name IS NOT NULL AND trim(regexp_replace(replace(name, ' ', ' '), ' {{2,}}', ' ', 'g')) <> name UNION ALL SELECT 'numerals', 'points', count(*) FROM c WHERE regexp_matches(points, '{TD}')")
def q_clean_audit(spark, sf):
    return clean.audit(contacts(spark, sf), ["name", "points"], ["zwspace", "whitespace", "numerals"]).select("operation", "column", "rows_affected")


@query(C + "SELECT id, CASE WHEN lower(trim(amount)) IN (" + BLANKS + ") THEN NULL ELSE amount END AS amount, CASE WHEN regexp_full_match(amount, '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(amount AS DOUBLE) END AS amount_number FROM c")
def q_coerce_numeric(spark, sf):
    return clean.coerce_numeric(contacts(spark, sf).select("id", "amount"), ["amount"])


@query(C + "SELECT id, round(coalesce(balance, (SELECT median(balance) FROM c)), 6) AS balance FROM c")
def q_fill_median(spark, sf):
    return clean.fill_values(contacts(spark, sf).select("id", "balance"), ["balance"], "median").select("id", F.round("balance", 6).alias("balance"))


@query(C + "SELECT id, coalesce(score, (SELECT score FROM c WHERE score IS NOT NULL GROUP BY score ORDER BY count(*) DESC, score LIMIT 1)) AS score FROM c")
def q_fill_mode(spark, sf):
    return clean.fill_values(contacts(spark, sf).select("id", "score"), ["score"], "mode")


@query(C + f"SELECT 'zwspace' AS action, count(*) FILTER (regexp_matches(name, '{ZW}')) AS rows FROM c UNION ALL SELECT 'numerals', count(*) FILTER (regexp_matches(points, '{TD}')) FROM c UNION ALL SELECT 'placeholders', count(*) FILTER (lower(trim(amount)) IN ({BLANKS})) FROM c")
def q_cleaning_plan(spark, sf):
    return clean.plan_cleaning(contacts(spark, sf).select("name", "points", "amount")).where("action in ('zwspace', 'numerals', 'placeholders')")


@query()
def q_impute(spark, sf):
    return clean.impute(contacts(spark, sf).select("balance", "score", F.col("join_year").cast("double").alias("year")), ["balance", "score", "year"])


@query()
def q_clean_pipeline(spark, sf):
    return clean.clean(contacts(spark, sf))[0]


# --- anomalies -----------------------------------------------------------------
@query(C + "SELECT id, round(balance, 4) AS balance FROM c, (SELECT avg(balance) AS m, stddev_samp(balance) AS s FROM c) WHERE abs(balance - m) / s > 3")
def q_outlier_z(spark, sf):
    return anomaly.outliers_z(contacts(spark, sf).select("id", "balance"), "balance").select("id", F.round("balance", 4).alias("balance"))


@query(C + "SELECT id, round(balance, 4) AS balance FROM c, (SELECT quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.75) AS b FROM c) WHERE balance < a - 1.5 * (b - a) OR balance > b + 1.5 * (b - a)")
def q_outlier_iqr(spark, sf):
    return anomaly.outliers_iqr(contacts(spark, sf).select("id", "balance"), "balance").select("id", F.round("balance", 4).alias("balance"))


@query(C + "SELECT id, round(balance, 4) AS balance FROM c, (SELECT median(balance) AS med FROM c), (SELECT median(abs(balance - (SELECT median(balance) FROM c))) AS mad FROM c) WHERE abs(balance - med) * 0.6745 / mad > 3.5")
def q_outlier_mad(spark, sf):
    return anomaly.outliers_mad(contacts(spark, sf).select("id", "balance"), "balance").select("id", F.round("balance", 4).alias("balance"))


@query()
def q_outlier_gesd(spark, sf):
    return spark.createDataFrame([(float(v),) for v in anomaly.gesd(contacts(spark, sf), "balance")], "value double")


@query()
def q_isolation_forest(spark, sf):
    return spark.createDataFrame([(v,) for v in anomaly.isolation_forest(contacts(spark, sf), "balance")], "value double")


@query()
def q_local_outliers(spark, sf):
    return spark.createDataFrame([(v,) for v in anomaly.local_outliers(contacts(spark, sf), "balance")], "value double")


@query(C + "SELECT segment AS value, count(*) AS n FROM c GROUP BY 1 HAVING count(*) < 0.01 * (SELECT count(segment) FROM c)")
def q_rare_category(spark, sf):
    return anomaly.rare_categories(contacts(spark, sf), "segment")


@query(C + "SELECT lower(segment) AS folded, count(DISTINCT segment) AS variants, count(*) AS n FROM c GROUP BY 1 HAVING count(DISTINCT segment) > 1")
def q_case_variants(spark, sf):
    return anomaly.case_variants(contacts(spark, sf), "segment")


@query()
def q_fuzzy_labels(spark, sf):
    labels = contacts(spark, sf).select(F.when(F.col("id") % 9 == 0, F.concat("segment", F.lit("S"))).otherwise(F.col("segment")).alias("v"))
    return spark.createDataFrame([(" | ".join(g), len(g)) for g in anomaly.fuzzy_labels(labels, "v")], "labels string, n int")


@query(C + "SELECT 'type_mixing' AS check_name, 'warning' AS severity, 'amount' AS \"column\", count(*) FILTER (NOT regexp_full_match(amount, '[+-]?[0-9]+(\\.[0-9]+)?')) AS count, round(100.0 * count(*) FILTER (NOT regexp_full_match(amount, '[+-]?[0-9]+(\\.[0-9]+)?')) / count(amount), 2) AS percentage FROM c")
def q_type_mixing(spark, sf):
    return anomaly.findings(contacts(spark, sf).select("amount")).where("check_name = 'type_mixing'")


@query("WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders) SELECT regexp_replace(t, '[0-9]', '9', 'g') AS signature, count(*) AS n FROM d GROUP BY 1")
def q_mixed_dates(spark, sf):
    d = read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"))
    return anomaly.mixed_date_formats(d, "t")


@query("WITH d AS (SELECT doc_id, length(text) AS n FROM documents) SELECT doc_id FROM d, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM d) WHERE abs(n - m) / s > 3")
def q_text_length(spark, sf):
    return anomaly.length_outliers(read(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id")


# --- statistics ----------------------------------------------------------------
_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM lineitem" for c in _COLS))
def q_basic_stats(spark, sf):
    s = stats.basic_stats(read(spark, sf, "lineitem"), _COLS).withColumnRenamed("distinct", "distinct_values")
    return s.select(*[F.round(c, 4).alias(c) if c in ("mean", "std", "q1", "median", "q3", "skew", "kurtosis") else F.col(f"`{c}`") for c in s.columns])


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def q_top_values(spark, sf):
    return stats.top_values(read(spark, sf, "part"), "p_brand")


@query(" UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]).replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def q_corr_pairs(spark, sf):
    return stats.correlation_pairs(read(spark, sf, "lineitem"), _COLS).select("left", "right", F.round("r", 6).alias("r"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def q_spearman(spark, sf):
    return stats.spearman(read(spark, sf, "orders"), "o_totalprice", "o_custkey").select("n", F.round("rho", 6).alias("rho"))


@query("WITH g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS w FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w, sum(n * m) / sum(n) AS mm FROM g), b AS (SELECT sum(n * (m - (SELECT mm FROM t)) * (m - (SELECT mm FROM t))) AS b FROM g) SELECT k AS groups, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 4) AS f, round(sqrt(b / (b + w)), 6) AS eta FROM t, b")
def q_anova(spark, sf):
    return stats.anova(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity").select("groups", "n", F.round("f", 4).alias("f"), F.round("eta", 6).alias("eta"))


_CHI = "WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), d AS (SELECT (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS c, (SELECT sum(ra) FROM ra) AS n), x AS (SELECT sum((coalesce(o.o, 0) - ra * rb / n) ** 2 / (ra * rb / n)) AS x FROM ra CROSS JOIN rb CROSS JOIN d LEFT JOIN o ON o.a = ra.a AND o.b = rb.b) "


@query(_CHI + "SELECT round(x, 4) AS chi2, (r - 1) * (c - 1) AS dof, n::BIGINT AS n, round(sqrt(greatest(x / n - (r - 1) * (c - 1) / (n - 1), 0) / (least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1)), 6) AS v FROM x, d")
def q_chi_square(spark, sf):
    return stats.chi_square(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("chi2", 4).alias("chi2"), "dof", "n", F.round("v", 6).alias("v"))


@query("SELECT round(sum(m)::DOUBLE / sum(t), 6) AS ratio FROM (SELECT max(o) AS m, sum(o) AS t FROM (SELECT l_returnflag, l_linestatus, count(*) AS o FROM lineitem GROUP BY 1, 2) GROUP BY l_returnflag)")
def q_leakage_determinism(spark, sf):
    return stats.determinism(read(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("ratio", 6).alias("ratio"))


@query("WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)::INT AS bin, count(*) AS n FROM orders, s GROUP BY 1")
def q_histogram(spark, sf):
    return stats.histogram(read(spark, sf, "orders"), "o_totalprice")


@query("WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), h AS (SELECT least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19) AS bin, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders, s GROUP BY 1), p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM h) SELECT round((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS jsd FROM p")
def q_jsd(spark, sf):
    return stats.jsd(read(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F").select(F.round("jsd", 6).alias("jsd"))


@query("WITH u AS (SELECT l_extendedprice AS v, (l_returnflag = 'A')::INT AS x, (l_returnflag = 'N')::INT AS y FROM lineitem WHERE l_returnflag IN ('A', 'N')), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1), w AS (SELECT abs(sum(x) OVER (ORDER BY v) / (SELECT sum(x) FROM g) - sum(y) OVER (ORDER BY v) / (SELECT sum(y) FROM g)) AS d FROM g) SELECT round(max(d), 6) AS d, max(d) > 0.1 AS drift FROM w")
def q_ks_drift(spark, sf):
    t = read(spark, sf, "lineitem")
    return stats.ks_drift(t.where("l_returnflag = 'A'"), t.where("l_returnflag = 'N'"), "l_extendedprice").select(F.round("d", 6).alias("d"), "drift")


@query("WITH a AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.v, b.v) AS value, round(coalesce(p, 0), 6) AS before, round(coalesce(q, 0), 6) AS after, round(coalesce(q, 0) - coalesce(p, 0), 6) AS shift FROM a FULL JOIN b ON a.v = b.v")
def q_cat_drift(spark, sf):
    t = read(spark, sf, "orders")
    d = stats.categorical_drift(t.where("o_orderstatus = 'F'"), t.where("o_orderstatus = 'O'"), "o_orderpriority")
    return d.select("value", *[F.round(c, 6).alias(c) for c in ("before", "after", "shift")])


_SIDE = "round(avg({0}), 4) AS mean_{1}, round(median({0}), 4) AS median_{1}, round(stddev_pop({0}), 4) AS std_{1}, round(min({0}), 4) AS min_{1}, round(max({0}), 4) AS max_{1}, count({0})::DOUBLE AS count_{1}"


@query(f"SELECT 'o_totalprice' AS \"column\", a.*, b.* FROM (SELECT {_SIDE.format('o_totalprice', 'a')} FROM orders WHERE o_orderstatus = 'F') a, (SELECT {_SIDE.format('o_totalprice', 'b')} FROM orders WHERE o_orderstatus = 'O') b")
def q_compare_numeric(spark, sf):
    t = read(spark, sf, "orders")
    return stats.numeric_diff(t.where("o_orderstatus = 'F'"), t.where("o_orderstatus = 'O'"), ["o_totalprice"])


@query()
def q_simpson(spark, sf):
    t = read(spark, sf, "lineitem").selectExpr("l_quantity AS x", "l_extendedprice AS y", "l_shipdate AS d", "l_linenumber AS seg")
    return stats.simpson(t, "y", "x", "seg")


@query()
def q_leakage(spark, sf):
    t = read(spark, sf, "orders").selectExpr("o_totalprice AS target", "o_totalprice * 1.01 AS near", "CAST(o_custkey AS DOUBLE) AS other", "o_totalprice AS same")
    rows = [(r["column"], r["kind"], round(r["score"], 6)) for r in stats.leakage(t, "target", ["near", "other", "same"])]
    return spark.createDataFrame(rows, "column string, kind string, score double")


@query()
def q_fit_distributions(spark, sf):
    rows = stats.fit_distributions(read(spark, sf, "lineitem"), "l_quantity")
    return spark.createDataFrame([(r["distribution"], r["ks"], r["p"]) for r in rows], "distribution string, ks double, p double")


@query()
def q_missing_mechanism(spark, sf):
    return quality.missing_mechanism(contacts(spark, sf), ["balance", "score", "id"])


@query("WITH p AS (SELECT l_linenumber AS k, avg(l_discount) / 10 AS p FROM lineitem GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p) SELECT k, round(p, 8) AS p, i <= coalesce((SELECT max(i) FROM r WHERE p <= i / m * 0.01), 0) AS significant FROM r")
def q_fdr(spark, sf):
    p = read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.avg("l_discount") / 10).alias("p"))
    return stats.benjamini_hochberg(p, "p", 0.01).select("k", F.round("p", 8).alias("p"), "significant")


# --- insights ------------------------------------------------------------------
BULK = "CASE WHEN l_linenumber <= 4 THEN 'x' WHEN l_linenumber = 5 THEN 'y' ELSE 'z' END"


def _grouped(spark, sf):
    return insight.perspectives(read(spark, sf, "lineitem").withColumn("bulk", F.expr(BULK)), ["bulk", "l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query(" UNION ALL ".join(f"SELECT '{b}' AS breakdown, CAST({b} AS VARCHAR) AS key, count(*) AS n, '{m}' AS measure, round(sum({m}), 2) AS total, round(avg({m}), 4) AS mean FROM (SELECT *, {BULK} AS bulk FROM lineitem) GROUP BY {b}" for b in ("bulk", "l_returnflag", "l_linestatus", "l_linenumber") for m in ("l_quantity", "l_extendedprice")))
def q_insight_perspectives(spark, sf):
    return _grouped(spark, sf).select("breakdown", "key", "n", "measure", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"))


_G = "WITH g AS (" + " UNION ALL ".join(f"SELECT '{b}' AS breakdown, CAST({b} AS VARCHAR) AS key, '{m}' AS measure, count(*) AS n, sum({m}) AS total FROM (SELECT *, {BULK} AS bulk FROM lineitem) GROUP BY {b}" for b in ("bulk", "l_returnflag", "l_linestatus", "l_linenumber") for m in ("l_quantity", "l_extendedprice")) + ") "


@query(_G + ", r AS (SELECT *, row_number() OVER w AS k, lead(total) OVER w AS second FROM g WINDOW w AS (PARTITION BY breakdown, measure ORDER BY total DESC, key)) SELECT breakdown, measure, key, n, round(1 - second / total, 6) AS score FROM r WHERE k = 1 AND second > 0 AND total / second >= 1.5 AND n >= 30")
def q_insight_outstanding(spark, sf):
    return insight.outstanding(_grouped(spark, sf)).select("breakdown", "measure", "key", "n", F.round("score", 6).alias("score"))


@query(_G + ", r AS (SELECT *, count(*) OVER w AS k, sum(total) OVER w AS all_total FROM g WINDOW w AS (PARTITION BY breakdown, measure)) SELECT breakdown, measure, key, n, round(total / all_total, 6) AS score FROM r WHERE k >= 3 AND total / all_total >= 0.5")
def q_insight_attribution(spark, sf):
    return insight.attribution(_grouped(spark, sf)).select("breakdown", "measure", "key", "n", F.round("score", 6).alias("score"))


@query("WITH b AS (SELECT date_trunc('year', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY ts) AS i, y FROM b) SELECT (SELECT count(*) FROM r) AS n, round(2.0 * sum(sign(b.y - a.y)) / ((SELECT count(*) FROM r) * ((SELECT count(*) FROM r) - 1)), 6) AS tau FROM r a JOIN r b ON a.i < b.i")
def q_insight_trend(spark, sf):
    s = timeseries.bucketed(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", "year", "sum")
    return stats.mann_kendall(s, "ts", "y").select("n", F.round("tau", 6).alias("tau"))


@query()
def q_insights(spark, sf):
    cards = insight.discover(read(spark, sf, "lineitem").selectExpr(f"{BULK} AS bulk", "l_returnflag", "l_quantity", f"l_tax + CASE WHEN {BULK} = 'z' THEN 0.05 ELSE 0 END AS tax", "l_quantity * 2 + l_tax AS volume"))
    return spark.createDataFrame([(c["pattern"], c["breakdown"], c["measure"], c["key"], float(c["rank_score"])) for c in cards], "pattern string, breakdown string, measure string, key string, score double")


# --- time series ---------------------------------------------------------------
def _daily(spark, sf):
    return timeseries.bucketed(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", "day", "sum")


_S = "WITH s AS (SELECT date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS pos, ts, y FROM s) "


@query(_S + "SELECT count(*) AS n, round(regr_slope(y, pos), 4) AS slope, round(corr(y, pos), 6) AS r FROM p")
def q_ts_trend(spark, sf):
    return timeseries.linear_trend(_daily(spark, sf)).select("n", F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"))


@query(_S + ", d AS (SELECT epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS d FROM s), m AS (SELECT median(d) AS m FROM d WHERE d > 0) SELECT m AS median_seconds, CASE WHEN m BETWEEN 3000 AND 5400 THEN 'H' WHEN m BETWEEN 69120 AND 103680 THEN 'D' WHEN m BETWEEN 518400 AND 691200 THEN 'W' WHEN m BETWEEN 2332800 AND 2764800 THEN 'M' ELSE 'irregular' END AS freq FROM m")
def q_ts_frequency(spark, sf):
    return timeseries.frequency(_daily(spark, sf))


@query("WITH s AS (SELECT DISTINCT o_orderdate AS ts FROM orders), d AS (SELECT lag(ts) OVER (ORDER BY ts) AS after, ts AS before, epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS seconds FROM s) SELECT strftime(after, '%Y-%m-%d %H:%M:%S') AS after, strftime(before, '%Y-%m-%d %H:%M:%S') AS before, round(seconds, 3) AS seconds FROM d WHERE seconds > 1.5 * (SELECT median(seconds) FROM d WHERE seconds > 0)")
def q_ts_gaps(spark, sf):
    s = read(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"))
    return timeseries.gaps(s).select(F.date_format("after", "yyyy-MM-dd HH:mm:ss").alias("after"), F.date_format("before", "yyyy-MM-dd HH:mm:ss").alias("before"), F.round("seconds", 3).alias("seconds"))


@query(_S + ", x AS (SELECT pos, y - (SELECT avg(y) FROM p) AS x FROM p) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(sum(x * l) / sum(x * x), 6) AS r FROM (SELECT x, lag(x, {k}) OVER (ORDER BY pos) AS l FROM x)" for k in (1, 7, 30)))
def q_ts_acf(spark, sf):
    return timeseries.acf(_daily(spark, sf), [1, 7, 30]).select("lag", F.round("r", 6).alias("r"))


@query(_S + ", t AS (SELECT pos, y, avg(y) OVER (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM p), h AS (SELECT pos % 7 AS ph, avg(y - trend) AS s FROM t GROUP BY 1), c AS (SELECT ph, s - (SELECT avg(s) FROM h) AS s FROM h) SELECT pos, round(y, 2) AS observed, round(trend, 2) AS trend, round(s, 2) AS seasonal, round(y - trend - s, 2) AS residual FROM t JOIN c ON t.pos % 7 = c.ph")
def q_ts_decompose(spark, sf):
    d = timeseries.decompose(_daily(spark, sf), 7)
    return d.select(F.col("pos").cast("long").alias("pos"), *[F.round(c, 2).alias(c) for c in ("observed", "trend", "seasonal", "residual")])


@query()
def q_ts_spikes(spark, sf):
    return timeseries.spikes(timeseries.decompose(_daily(spark, sf), 7)).select("pos", "residual")


@query()
def q_ts_seasonality(spark, sf):
    return timeseries.seasonality(_daily(spark, sf))


@query("SELECT count(o_orderdate) AS rows, count(DISTINCT o_orderdate) AS times, count(DISTINCT o_orderdate) < 0.5 * count(o_orderdate) OR count(DISTINCT o_orderdate) < 5 AS panel FROM orders")
def q_ts_panel(spark, sf):
    return timeseries.is_panel_axis(read(spark, sf, "orders"), "o_orderdate")


# --- keys and relationships ----------------------------------------------------
@query("WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders), b AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) SELECT (SELECT count(*) FROM a) AS child_keys, (SELECT count(*) FROM b) AS parent_keys, count(*) AS common, (SELECT count(*) FROM a) - count(*) AS orphans, round(count(*) / (SELECT count(*) FROM a), 6) AS overlap FROM a SEMI JOIN b ON a.k = b.k")
def q_fk_overlap(spark, sf):
    return relate.overlap(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer"), "c_custkey")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def q_orphans(spark, sf):
    return relate.orphans(read(spark, sf, "orders"), "o_custkey", read(spark, sf, "customer"), "c_custkey")


@query("SELECT 'orders' AS \"table\", 'o_orderkey' AS \"column\", count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_values, round(count(DISTINCT o_orderkey) / count(*), 4) AS ratio FROM orders")
def q_key_candidates(spark, sf):
    k = relate.key_candidates(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders")
    return k.where("column = 'o_orderkey'").select("table", "column", "rows", F.col("distinct").alias("distinct_values"), "ratio")


@query()
def q_relationships(spark, sf):
    t = {"documents": read(spark, sf, "documents").select("doc_id", "lang"), "labels": read(spark, sf, "labels"), "orders": read(spark, sf, "orders").select(F.col("o_custkey").alias("cust_id"), "o_orderstatus"), "customer": read(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"), "c_mktsegment")}
    rows = [(r["child"], r["parent"], r["column"], r["cardinality"], float(r["overlap"])) for r in relate.match_relationships(t)]
    return spark.createDataFrame(rows, "child string, parent string, column string, cardinality string, overlap double")


# --- corpus --------------------------------------------------------------------
_TOK = "SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM documents"
_STOP = ", ".join(f"'{s}'" for s in sorted(corpus.STOPWORDS))


@query(f"WITH t AS ({_TOK}) SELECT term, count(*) AS n FROM t WHERE term NOT IN ({_STOP}) AND regexp_matches(term, '[\\pL\\pN]') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def q_top_tokens(spark, sf):
    return corpus.top_terms(read(spark, sf, "documents"), "text")


@query("WITH d AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d) SELECT term, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def q_bigrams(spark, sf):
    return corpus.top_terms(read(spark, sf, "documents"), "text", n=2)


@query("WITH d AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents), t AS (SELECT doc_id, lang, len(w) AS total, unnest(w) AS term FROM d), c AS (SELECT doc_id, lang, total, term, count(*) AS c FROM t GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), s AS (SELECT lang, term, sum(c / total) AS tf FROM c GROUP BY 1, 2), r AS (SELECT lang, s.term, tf * (ln((1 + (SELECT count(*) FROM d WHERE len(w) > 0)) / (1 + df)) + 1) AS score FROM s JOIN f ON s.term = f.term), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM r) SELECT lang AS class, rank, term, round(score, 4) AS score FROM k WHERE rank <= 20")
def q_tfidf(spark, sf):
    t = corpus.tfidf(read(spark, sf, "documents"), "text", by="lang", id_column="doc_id")
    return t.select("class", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 4).alias("score"))


@query("WITH d AS (SELECT length(text) AS c, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS t FROM documents) SELECT count(*) AS rows, round(avg(c), 4) AS mean_chars, median(c)::DOUBLE AS median_chars, min(c)::BIGINT AS min_chars, max(c)::BIGINT AS max_chars, round(avg(t), 4) AS mean_tokens, sum(t)::BIGINT AS total_tokens FROM d")
def q_text_metrics(spark, sf):
    m = corpus.text_metrics(read(spark, sf, "documents"), "text")
    return m.select("rows", F.round("mean_chars", 4).alias("mean_chars"), "median_chars", F.col("min_chars").cast("long").alias("min_chars"), F.col("max_chars").cast("long").alias("max_chars"), F.round("mean_tokens", 4).alias("mean_tokens"), "total_tokens")


@query(f"WITH t AS ({_TOK}) SELECT count(*) AS total, count(DISTINCT term) AS \"unique\", round(count(DISTINCT term) / count(*), 6) AS richness FROM t")
def q_vocabulary(spark, sf):
    return corpus.vocabulary(read(spark, sf, "documents"), "text").select("total", "unique", F.round("richness", 6).alias("richness"))


@query(C + "SELECT 'review' AS \"column\", count(review) AS cells, sum(len(regexp_extract_all(review, '[ก-ฮ]')))::BIGINT AS thai, sum(len(regexp_extract_all(review, '[A-Za-z]')))::BIGINT AS latin, sum(len(regexp_extract_all(review, '[0-9]')))::BIGINT AS digits, sum(length(review))::BIGINT AS chars FROM c")
def q_language_stats(spark, sf):
    return corpus.language_stats(contacts(spark, sf), ["review"]).drop("language")


# --- privacy -------------------------------------------------------------------
@query("SELECT 'text' AS \"column\", sum(len(regexp_extract_all(' ' || text || ' ', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')))::BIGINT AS email FROM documents")
def q_pii_counts(spark, sf):
    return quality.privacy_audit(read(spark, sf, "documents"), ["text"]).select("column", "email")


@query(C + "SELECT id, CASE WHEN regexp_full_match(citizen_id, '[0-9]{13}') THEN '[ID_' || translate(substr(sha256('a key:' || sha256('a key:' || citizen_id)), 1, 32), '0123456789', 'ghijklmnop') || ']' ELSE citizen_id END AS citizen_id FROM c")
def q_anonymize(spark, sf):
    return privacy.anonymize(contacts(spark, sf).select("id", "citizen_id"), ["citizen_id"], "a key")


@query()
def q_synthetic(spark, sf):
    return privacy.synthetic(read(spark, sf, "orders").drop("o_orderkey"), 500)


# --- types, charts, streams ----------------------------------------------------
@query()
def q_column_types(spark, sf):
    return spark.createDataFrame(sorted(detect.detect_all(contacts(spark, sf)).items()), "column string, type string")


@query("WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c) SELECT CASE WHEN k <= 8 THEN value ELSE 'other' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def q_chart_sunburst(spark, sf):
    return charts.sunburst(read(spark, sf, "part"), "p_brand")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT 'o_totalprice' AS \"column\", round(any_value(a), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(b), 4) AS q3, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS outliers FROM orders, q")
def q_chart_box(spark, sf):
    return charts.box(read(spark, sf, "orders"), ["o_totalprice"]).select("column", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), F.round("q3", 4).alias("q3"), "outliers")


@query()
def q_chart_kde(spark, sf):
    return charts.kde(read(spark, sf, "orders"), "o_totalprice")


@query()
def q_chart_qq(spark, sf):
    return charts.qq(read(spark, sf, "orders"), "o_totalprice")


@query("WITH e AS (SELECT ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events) SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows, count(*) - count(value) AS value_missing FROM e GROUP BY 1")
def q_stream_counters(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return counters.windowed_quality(e, "ts", ["value"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows", "value_missing")


# --- single checks, rules and targets -------------------------------------------
def _single(check: str, column: str) -> None:
    def one(spark, sf):
        return quality.findings(contacts(spark, sf).select(column)).where(F.col("check_name") == check)

    QUERIES[f"q_check_{check}"] = one
    SQL[f"q_check_{check}"] = f"SELECT * FROM ({SQL['q_quality_findings']}) WHERE check_name = '{check}' AND \"column\" = '{column}'"


for _check, _column in (("missing", "citizen_id"), ("constant_column", "source"), ("zero_width", "name"), ("whitespace", "name"), ("thai_numerals", "points"), ("phone_format", "phone"), ("thai_id", "citizen_id"), ("buddhist_era", "join_year")):
    _single(_check, _column)


@query(" UNION ALL ".join(f"SELECT 'skewed' AS rule, '{c}' AS \"column\", round(skewness({c}), 4) AS value FROM lineitem HAVING abs(skewness({c})) > 1 UNION ALL SELECT 'heavy_tails', '{c}', round(kurtosis({c}), 4) FROM lineitem HAVING kurtosis({c}) > 7" for c in ("l_quantity", "l_extendedprice", "cube")).replace("FROM lineitem", "FROM (SELECT *, pow(l_quantity, 8) AS cube FROM lineitem)"))
def q_shape(spark, sf):
    return advice.shape(read(spark, sf, "lineitem").withColumn("cube", F.pow("l_quantity", F.lit(8))), ["l_quantity", "l_extendedprice", "cube"])


@query("WITH d AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 701 = 0 THEN NULL ELSE o_totalprice END AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS c FROM orders) SELECT 'a' AS \"left\", 'b' AS \"right\", round(corr((a IS NULL)::INT, (b IS NULL)::INT), 6) AS r FROM d")
def q_co_missing(spark, sf):
    d = read(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS a", "CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 701 = 0 THEN NULL ELSE o_totalprice END AS b", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS c")
    return advice.co_missing(d, ["a", "b", "c"]).select("left", "right", F.round("r", 6).alias("r"))


@query("WITH d AS (SELECT l_linenumber AS v FROM lineitem), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM d) SELECT round(count(*) FILTER (v <= lo + (hi - lo) / 3.0) / count(*), 6) AS low, round(count(*) FILTER (v >= hi - (hi - lo) / 3.0) / count(*), 6) AS high, CASE WHEN count(*) FILTER (v >= hi - (hi - lo) / 3.0) >= 0.5 * count(*) THEN 'mostly_high' WHEN count(*) FILTER (v <= lo + (hi - lo) / 3.0) >= 0.5 * count(*) THEN 'mostly_low' WHEN count(*) FILTER (v <= lo + (hi - lo) / 3.0) >= 0.25 * count(*) AND count(*) FILTER (v >= hi - (hi - lo) / 3.0) >= 0.25 * count(*) AND count(*) FILTER (v <= lo + (hi - lo) / 3.0 OR v >= hi - (hi - lo) / 3.0) >= 0.6 * count(*) THEN 'polarised' ELSE 'spread' END AS verdict FROM d, s")
def q_rating(spark, sf):
    return advice.rating(read(spark, sf, "lineitem"), "l_linenumber")


@query("SELECT 'c_name' AS \"column\", round(count(DISTINCT c_name) / count(*), 4) AS ratio FROM customer HAVING count(DISTINCT c_name) >= 0.9 * count(*)")
def q_high_cardinality(spark, sf):
    return advice.high_cardinality(read(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("WITH c AS " + sql_of(CONTACTS, "customer") + " SELECT 'outliers' AS rule, 'balance' AS \"column\", count(*)::DOUBLE AS value FROM c, (SELECT avg(balance) AS m, stddev_pop(balance) AS s FROM c) WHERE abs(balance - m) > 3 * s HAVING count(*) >= 5 OR (count(*) > 0 AND count(*) >= 0.01 * (SELECT count(balance) FROM c))")
def q_outlier_share(spark, sf):
    return advice.outlier_share(contacts(spark, sf), ["balance"])


@query("SELECT o_orderstatus AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def q_target_baseline(spark, sf):
    return advice.target_baseline(read(spark, sf, "orders"), "o_orderstatus")


@query("WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem), g AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(s * s / n) AS q FROM g), u AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)) SELECT k AS groups, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h FROM t, u")
def q_kruskal(spark, sf):
    return advice.kruskal(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity").select("groups", "n", F.round("h", 4).alias("h"))


@query("WITH d AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders) SELECT 'numeric_text' AS rule, 'v' AS \"column\", round(count(*) FILTER (v <> 'x') / count(*), 4) AS value FROM d")
def q_type_mismatch(spark, sf):
    d = read(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END AS v", "o_orderstatus AS s")
    return advice.type_mismatch(d, ["v", "s"])


@query()
def q_text_advice(spark, sf):
    return advice.text_advice(read(spark, sf, "documents"), "text")


@query()
def q_target_association(spark, sf):
    from datalotus.plans.profile import analyze_target

    rows = [(r["feature"], r["test"], float(r["score"]), float(r["p"])) for r in analyze_target(read(spark, sf, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"), "o_totalprice")]
    return spark.createDataFrame(rows, "feature string, test string, score double, p double")
