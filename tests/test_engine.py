from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from datalotus import catalog
from datalotus.functions import text as X
from datalotus.functions.arrow import indel_ratio, unicode_form
from datalotus.operators import anomaly, clean, corpus, detect, insight, privacy, quality, relate, stats, timeseries
from datalotus.plans import cli, narrative
from datalotus.plans import profile as P
from datalotus.sources import files, tokenizers
from datalotus.streaming import counters


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def cells(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_text_expressions(spark):
    assert cells(spark, ["๑๒๓", None, "a​b"], X.arabic_digits) == ["123", None, "a​b"]
    assert cells(spark, ["a​b", "ab"], X.has_zero_width) == [True, False]
    assert cells(spark, ["　 a  b ", "ab"], X.squeeze) == ["a b", "ab"]
    assert cells(spark, ["+66 81-234-5678", "812345678", "๐๘๑๒๓๔๕๖๗๘", "123"], X.is_phone) == [True, True, True, False]
    assert cells(spark, ["1101700207030", "1101700207031", None, "12"], X.valid_citizen_id).count(True) <= 1
    assert cells(spark, ["55555", "555", "aaa", "aaaa", "!!", "!!!", "111"], X.repeated_char_spam) == [True, True, False, True, False, True, False]
    assert cells(spark, ["ก่่อน", "ก่อน"], X.tone_stacked) == [True, False]
    assert cells(spark, ["ก่่อน"], X.fix_tone_stacking) == ["ก่อน"]
    assert cells(spark, ["่ก", "กี่"], X.combining_order_issue)[0] is True
    assert cells(spark, ["ดีมากกกกกก", "ๆๆๆ"], X.cap_repeats) == ["ดีมากกก", "ๆ"]
    assert cells(spark, ["12", "1e3", " 5 ", "12d", "nan", "1,200", "๑", "-.5"], X.is_number) == [True, True, True, False, False, False, False, True]
    assert cells(spark, ["฿1,234.50", "300 บาท", "abc"], X.money) == [1234.5, 300.0, None]
    assert cells(spark, ["ปี 2560 และ 2561", "2019"], X.to_common_era) == ["ปี 2017 และ 2018", "2019"]
    assert cells(spark, ["5 มกราคม 2560"], X.normalize_date) == ["5/01/2017"]
    assert cells(spark, ["ＡＢＣ"], X.fold_fullwidth) == ["ABC"]
    assert cells(spark, ["ABC-12.0", " 5.0 ", "๕"], X.normalize_key) == ["ABC-12.0", "5", "5"]
    broken = "สวัสดี".encode().decode("latin-1")
    assert cells(spark, [broken, "plain"], X.repair_mojibake) == ["สวัสดี", "plain"]
    assert cells(spark, [broken, "plain"], X.mojibake_kind) == ["latin-1", None]
    assert cells(spark, ["é", None], lambda c: unicode_form(c, "NFC")) == ["é", None]
    assert indel_ratio("abc", "abd") == pytest.approx(4 / 6) and indel_ratio("", "") == 1.0


def test_house_numbers_of_five_digits_are_no_postal_codes(spark):
    parts = cells(spark, ["10000/1 หมู่ 2 ต.บางพลี จ.ชลบุรี 20000", "12345 หมู่ 3 จ.ชลบุรี ๒๐๐๐๐", "7/12345 จ.ชลบุรี", "9 ต.บางพลี 10540"], X.parse_address)
    assert [(p.house_no, p.moo, p.postal_code) for p in parts] == [("10000/1", "2", "20000"), ("12345", "3", "20000"), ("7/12345", None, None), ("9", None, "10540")]


def test_tfidf_counts_words_in_the_row(spark):
    rows = [(1, "en", "a b a  c A"), (1, "en", "b x y z w"), (1, "en", "b"), (2, "en", "c"), (3, "de", " b b "), (4, None, "a d"), (5, "de", "  "), (6, "en", None), (None, "en", "c q"), (None, "en", "q c")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, text VARCHAR)")
    for keep in (rows, [r for i, r in enumerate(rows) if r[0] and i not in (1, 2)]):  # ids repeated, and each once
        con.execute("DELETE FROM documents")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", keep)
        want = {(r[0], r[2]): r[3] for r in con.execute(catalog.SQL["q_tfidf"]).fetchall()}
        found = corpus.tfidf(spark.createDataFrame(keep, "doc_id long, lang string, text string"), "text", by="lang", id_column="doc_id")
        assert {(r["class"], r.term): round(r.score, 4) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "doc#" not in plan  # nothing is grouped by document


def test_quantiles_by_ranges(spark):
    r = np.random.default_rng(5)
    columns = {"few": r.integers(0, 3, 5000).astype(float), "many": r.normal(0, 1e6, 5000), "one": np.full(5000, 7.5), "holes": np.where(r.random(5000) < 0.999, np.nan, 1.0) + np.arange(5000)}
    rows = [tuple(None if np.isnan(x) else float(x) for x in row) + (None,) for row in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "empty"]))
    at = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9999, 1.0]
    found = {x.column: x.q for x in stats.quantiles(df, {c: F.col(c) for c in df.columns}, at).collect()}
    assert set(found) == set(columns)
    for c, x in columns.items():
        assert found[c] == pytest.approx(np.quantile(x[~np.isnan(x)], at))
    plain = {c: df.agg(F.percentile(c, F.array(*[F.lit(p) for p in at]))).first()[0] for c in columns}
    assert found == plain
    assert stats.median(df, F.col("empty"), "m").first().m is None
    assert [tuple(x) for x in stats.basic_stats(df, ["empty", "one"]).select("column", "q1", "median", "q3").orderBy("column").collect()] == [("empty", None, None, None), ("one", 7.5, 7.5, 7.5)]
    for result in (stats.basic_stats(df, ["many"]), anomaly.outliers_iqr(df, "many"), anomaly.outliers_mad(df, "many")):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan  # no task gets all values


def test_distinct_counts_hold_few_cells_in_a_task(spark, monkeypatch):
    rows = [(i, f"name {i % 700}", None, "x" if i % 3 else None, float(i % 7)) for i in range(4000)]
    df = spark.createDataFrame(rows, "a long, b string, c string, d string, `e f` double").coalesce(1)
    want = {"a": 4000, "b": 700, "c": 0, "d": 1, "e f": 7}
    counts = lambda: {r.column: r.distinct for r in stats.distinct_counts(df, df.columns).collect()}
    assert counts() == want
    assert "RepartitionByExpression" not in stats.distinct_counts(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(stats, "HELD", 100_000)  # a few hundred rows
    assert "RepartitionByExpression" in stats.distinct_counts(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert counts() == want
    assert stats.distinct_counts(df.where("a < 0"), df.columns).where("distinct > 0").isEmpty()


def test_citizen_id_check_digit(spark):
    base = "110170020703"
    check = (11 - sum((13 - i) * int(c) for i, c in enumerate(base)) % 11) % 10
    assert cells(spark, [base + str(check), base + str((check + 1) % 10)], X.valid_citizen_id) == [True, False]


def test_findings_on_planted_defects(spark):
    rows = [("a​", "๑๐", "x", None), ("b", "15", "x", 2), ("b", "15", "x", 2), (" c", "N/A", "x", 3)]
    df = spark.createDataFrame(rows, "name string, price string, const string, n int")
    found = {(r.check_name, r.column): (r.severity, r["count"]) for r in quality.findings(df).collect()}
    assert found["zero_width", "name"] == ("critical", 1)
    assert found["thai_numerals", "price"] == ("warning", 1)
    assert found["whitespace", "name"] == ("warning", 1)
    assert found["constant_column", "const"] == ("info", 4)
    assert found["missing", "n"] == ("warning", 1)
    assert found["placeholder", "price"] == ("warning", 1)
    d = quality.duplicate_rows(df).first()
    assert (d.in_groups, d.beyond_first, d.groups) == (2, 1, 1)
    assert quality.findings(df.limit(0)).count() == 0
    o = quality.overview(df).first()
    assert (o.rows, o.columns, o.missing, o.duplicates) == (4, 4, 1, 1)


def test_score_and_fixed_checks(spark):
    a = spark.createDataFrame([("x", "critical", "c", 5, 50.0), ("y", "info", "c", 1, 10.0)], quality.FINDING)
    s = quality.quality_score(a, 4).first()
    assert s.score == pytest.approx(62.0, abs=0.5) and s.grade == "D" and (s.critical, s.warning, s.info) == (1, 0, 1)
    assert quality.quality_score(a.limit(0), 3).first().score == 100
    assert [tuple(r) for r in quality.fixed_checks(a, a.where("check_name = 'y'")).collect()] == [("x", "c")]


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a​", "1", "๑๒"), (2, " b ", "2", "13"), (2, " b ", "2", "13"), (None, None, None, None), (None, None, None, None)], "id int, t string, n string, d string")
    done, log = clean.clean(df)
    assert done.count() == 4 and {r.operation for r in log.collect()} >= {"zwspace", "whitespace", "numerals"}
    assert dict(done.dtypes)["n"] == "double" and sorted(r.t for r in done.collect() if r.t) == ["a", "b"]
    assert clean.drop_duplicates(df).count() == 4
    m = spark.createDataFrame([(1.0,), (None,), (3.0,), (3.0,)], "v double")
    assert sorted(r.v for r in clean.fill_values(m, ["v"], "mode").collect()) == [1, 3, 3, 3]
    assert clean.fill_values(m, ["v"], "flag").where("v is null").count() == 1
    with pytest.raises(ValueError):
        clean.fill_values(m, ["v"], "guess")
    with pytest.raises(ValueError):
        clean.clean_text(F.lit("x"), ["nothing"])
    x = spark.range(200).select((F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 10 != 0, F.col("id") * 2.0 + 1).alias("b"))
    filled = clean.impute(x, ["a", "b"]).where("a % 10 = 0").collect()
    assert all(abs(r.b - (2 * r.a + 1)) < 25 for r in filled)
    assert dict(clean.downcast(spark.range(5)).dtypes)["id"] == "tinyint"
    currency = spark.createDataFrame([("฿10",), ("20 บาท",), ("30",), ("-",)], "p string")
    assert sorted(r.p for r in clean.normalize_currency(currency, "p").collect() if r.p) == [10, 20, 30]


def test_outliers(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 1, 200).tolist(), 15.0, -18.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    for f in (anomaly.outliers_z, anomaly.outliers_iqr, anomaly.outliers_mad):
        assert {15.0, -18.0} <= {r.v for r in f(df, "v").collect()}
    assert set(anomaly.gesd(df, "v")) >= {15.0, -18.0}
    assert {15.0, -18.0} <= set(anomaly.local_outliers(df, "v"))
    assert np.argmax(anomaly.isolation_scores(np.array(values))) in (200, 201)
    assert anomaly.numeric_outliers(df, "v").count() >= 2
    assert anomaly.gesd(df.limit(0), "v") == []


def test_label_anomalies(spark):
    labels = ["Bangkok"] * 90 + ["bangkok"] * 5 + ["Bangkokk"] * 4 + ["Phuket"] * 50 + ["odd"]
    df = spark.createDataFrame([(v,) for v in labels], "v string")
    assert [r.value for r in anomaly.rare_categories(df, "v").collect()] == ["odd"]
    assert [(r.folded, r.variants, r.n) for r in anomaly.case_variants(df, "v").collect()] == [("bangkok", 2, 95)]
    assert any({"Bangkok", "Bangkokk"} <= set(g) for g in anomaly.fuzzy_labels(df, "v"))
    codes = spark.createDataFrame([(f"A{i}",) for i in range(20)], "v string")
    assert anomaly.fuzzy_labels(codes, "v") == []


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (2.0, 1.0, "a"), (3.0, 1.0, "b"), (10.0, 1.0, "b")], "x double, k double, g string")
    s = stats.basic_stats(df, ["x"]).first()
    assert s.skew == pytest.approx(1.7636, abs=1e-3) and s.kurtosis == pytest.approx(3.2280, abs=1e-3) and s.distinct == 4
    assert stats.correlation_pairs(df, ["x", "k"]).first().r is None
    a = stats.anova(df, "g", "x").first()
    assert a.groups == 2 and a.f == pytest.approx(25 / ((0.5 + 24.5) / 2), rel=1e-6)
    two = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 9, "a string, b string")
    c = stats.chi_square(two, "a", "b").first()
    e = np.outer([12, 12], [13, 11]) / 24
    assert c.chi2 == pytest.approx((((np.abs(np.array([[10, 2], [3, 9]]) - e)) - 0.5) ** 2 / e).sum())
    assert stats.p_from_chi2(spark, 3.841, 1) == pytest.approx(0.05, abs=1e-3)
    assert stats.p_from_t(spark, 2.228, 10) == pytest.approx(0.05, abs=1e-3)
    lo, hi = spark.range(100).select(F.col("id").alias("v")), spark.range(1000, 1100).select(F.col("id").alias("v"))
    assert stats.ks_drift(lo, hi, "v").first().d == 1.0
    assert stats.is_bimodal([0, 20, 30, 20, 2, 0, 0, 2, 20, 30, 20, 0], 100) and not stats.is_bimodal([1, 5, 20, 30, 20, 5, 1], 100)
    seg = spark.createDataFrame([(float(c * 5 + i % 7), float(c * 10 - 2 * (i % 7)), f"s{c}") for c in range(3) for i in range(80)], "x double, y double, s string")
    assert stats.simpson(seg, "y", "x", "s").first().paradox
    found = {r["column"]: r["kind"] for r in stats.leakage(seg.withColumn("copy", F.col("y")).withColumn("lin", F.col("y") * 2 + 1), "y", ["x", "copy", "lin"])}
    assert found["copy"] == "duplicate" and found["lin"] == "near_perfect_correlation"
    assert stats.fit_distributions(spark.range(1000).select(F.col("id").alias("v")), "v")[0]["distribution"] == "uniform"


def test_leakage_of_many_codes(spark):
    """A code that fixes the target is a leak however many codes there are; one that
    differs in nearly every row isn't held against the target."""
    df = spark.range(10_000).select(F.col("id"), (F.col("id") % 2_500).alias("code"), F.pmod(F.xxhash64(F.col("id") % 2_500), F.lit(3)).alias("y"))
    assert [(r["column"], r["kind"]) for r in stats.leakage(df, "y", ["code", "id"])] == [("code", "deterministic")]
    edge = spark.range(1_000).select(F.when(F.col("id") < 949, F.col("id")).otherwise(0).alias("under"), F.when(F.col("id") < 950, F.col("id")).otherwise(0).alias("at"), F.when(F.col("id") < 949, F.pmod(F.xxhash64("id"), F.lit(3))).otherwise(F.pmod(F.xxhash64(F.lit(0).cast("long")), F.lit(3))).alias("y"))
    assert [(r["column"], r["kind"]) for r in stats.leakage(edge, "y", ["under", "at"])] == [("under", "deterministic")]


def test_samples_draw_rows(spark):
    """Equal rows don't enter the bounded samples together."""
    df = spark.range(20_200).select((F.col("id") % 101).cast("double").alias("a"))
    x, _ = anomaly._sample(df, "a", 150, 42)
    assert len(x) == 150 and len(set(x)) > 50 and x.max() - x.min() > 80
    pairs = df.withColumn("b", F.when(F.rand(1) < 0.9, 2 * F.col("a")))
    filled = clean.impute(pairs, ["a", "b"], train_rows=150).agg(F.max(F.abs(F.col("b") - 2 * F.col("a"))).alias("off")).first()
    assert filled.off < 30


def test_insights(spark):
    rows = [("A", 100.0)] * 100 + [("B", 30.0)] * 50 + [("C", 20.0)] * 50
    df = spark.createDataFrame(rows, "category string, value double")
    cards = insight.discover(df)
    assert any(c["pattern"] == "outstanding" and c["key"] == "A" for c in cards)
    assert any(c["pattern"] == "attribution" and c["key"] == "A" for c in cards)
    noise = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(4)).cast("string").alias("g"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10.0).alias("v"))
    assert not [c for c in insight.discover(noise) if c["pattern"] in ("comparison", "trend")]


def test_time_series(spark):
    start = datetime(2024, 1, 1)
    ramp = spark.createDataFrame([(start + timedelta(days=i), i * 2.0 + (10 if i % 7 == 0 else 0) + (500 if i == 33 else 0)) for i in range(60) if i != 40], "ts timestamp, y double")
    t = timeseries.linear_trend(ramp).first()
    assert t.has_trend and timeseries.frequency(ramp).first().freq == "D" and timeseries.gaps(ramp).count() == 1
    week = spark.createDataFrame([(start + timedelta(days=i), float([5, 1, 0, 0, 0, 1, 9][i % 7])) for i in range(70)], "ts timestamp, y double")
    s = timeseries.seasonality(week).first()
    assert s.seasonal and s.period == 7
    spikes = [r.pos for r in timeseries.spikes(timeseries.decompose(ramp)).collect()]
    assert 33 in spikes
    assert timeseries.bucket_grain(ramp, "ts") in ("day", "week")


def test_relations(spark):
    parent = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "customer_id int, name string")
    child = spark.createDataFrame([(1, "๑"), (2, "2.0"), (3, "6")], "order_id int, customer_id string")
    r = relate.overlap(child, "customer_id", parent, "customer_id").first()
    assert (r.child_keys, r.common, r.orphans) == (3, 2, 1)
    assert [x.k for x in relate.orphans(child, "customer_id", parent, "customer_id").collect()] == ["6"]
    links = relate.match_relationships({"CUSTOMER": parent, "ORDER": child})
    assert [(x["child"], x["parent"], x["cardinality"]) for x in links] == [("ORDER", "CUSTOMER", "1:N")]
    assert "CUSTOMER ||--o{ ORDER" in relate.to_mermaid({"CUSTOMER": parent, "ORDER": child}, links)


def test_corpus(spark):
    df = spark.createDataFrame([(1, "The cat sat", "x"), (2, "cat cat dog", "y"), (3, None, "y"), (4, "", "y")], "doc_id int, t string, c string")
    assert [(r.term, r.n) for r in corpus.top_terms(df, "t", k=2).collect()] == [("cat", 3), ("dog", 1)]
    assert {r.term for r in corpus.top_terms(df, "t", n=2).collect()} == {"the cat", "cat sat", "cat cat", "cat dog"}
    assert {r.term for r in corpus.top_terms(df, "t", n=3).collect()} == {"the cat sat", "cat cat dog"}
    top = corpus.tfidf(df, "t", id_column="doc_id").where("rank = 1").first()
    assert top.term == "cat" and top.score == pytest.approx((1 / 3 + 2 / 3) * 1.0)
    assert corpus.text_metrics(df, "t").first().rows == 3


def test_detection(spark, sf):
    df = catalog.contacts(spark, sf)
    types = detect.detect_all(df)
    assert types["id"] == "id" and types["segment"] == "categorical" and types["balance"] == "numeric" and types["source"] == "categorical"
    ids = spark.createDataFrame([(i, None) for i in range(10)], "user_id int, nothing string")
    assert detect.detect_all(ids) == {"user_id": "id", "nothing": "empty"}
    with pytest.raises(ValueError):
        detect.ensure_unique(ids.select("user_id", "user_id"))


def test_privacy(spark):
    df = spark.createDataFrame([("call 0812345678 or 0812345678, id 1101700207030", 1), (None, 2)], "t string, i int")
    rows, other = ([r.t for r in privacy.anonymize(df, ["t"], key).collect()] for key in ("k", "l"))
    assert rows[0] != other[0] and rows[1] is None and "0812345678" not in rows[0] and rows[0].count("[PHONE_") == 2
    made = privacy.synthetic(df.withColumn("v", F.col("i") * 1.5), 50)
    assert made.count() == 50 and made.columns == ["t", "i", "v"]
    assert set(privacy.noisy_summary({"mean": 1.0, "std": 2.0}, 1.0, 1)) == {"mean"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ชื่อ;n\nก;1\nข;2\n".encode())
    (tmp_path / "b.csv").write_bytes("ชื่อ,n\nก,1\n".encode("cp874"))
    (tmp_path / "c.csv").write_text("1,2,3\n4,?,6\n")
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "e.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "f").write_text("x\ty\n1\tz\n")
    assert files.read_data(spark, str(tmp_path / "a.csv")).columns == ["ชื่อ", "n"]
    assert files.read_data(spark, str(tmp_path / "b.csv")).first()[0] == "ก"
    c = files.read_data(spark, str(tmp_path / "c.csv"))
    assert c.columns == ["col_0", "col_1", "target"] and c.where("col_1 is null").count() == 1
    assert files.read_data(spark, str(tmp_path / "d.jsonl")).count() == files.read_data(spark, str(tmp_path / "e.json")).count() == 2
    assert files.read_data(spark, str(tmp_path / "f")).columns == ["x", "y"]
    files.write_data(c, str(tmp_path / "out"))
    assert files.read_data(spark, str(tmp_path / "out")).count() == 2
    tables, errors = files.read_folder(spark, str(tmp_path))
    assert len(tables) == 5 and not errors
    with pytest.raises(ValueError):
        files.read_data(spark, str(tmp_path / "a.csv"), "xml")


def test_tokenizers(spark):
    assert one(spark, "a  b", tokenizers.get_tokenizer("whitespace")) == ["a", "b"]
    with pytest.raises(ValueError):
        tokenizers.get_tokenizer("none")
    if not tokenizers.available_engines():
        with pytest.raises(ImportError):
            tokenizers.get_tokenizer()
    assert [e["text"] for e in tokenizers.iob_entities([("สม", "B-PERSON"), ("ชาย", "I-PERSON"), (" ", "O"), ("ก", "I-LOC")])] == ["สมชาย", "ก"]


def test_profile_and_cli(spark, tmp_path, capsys):
    path = tmp_path / "t.csv"
    path.write_text("name,price,label\n" + "\n".join(f"n{i % 7},{i},{i % 2}" for i in range(40)))
    result = P.profile(files.read_data(spark, str(path)), clean_first=True)
    assert result.overview["columns"] == 3 and result.score["grade"] in "ABCDF" and "<table>" in result.to_html()
    assert '"findings"' in result.to_json(str(tmp_path / "r.json"))
    assert cli.guess_target(["a", "label"]) == "label" and cli.guess_target(["is_churn"]) == "is_churn"
    assert cli.main(["profile", str(tmp_path / "missing")]) == 2
    assert cli.main(["profile", str(path), "-o", str(tmp_path / "r.html")]) == 0
    assert "rows" in capsys.readouterr().out
    assert narrative.build_prompt(result.overview, result.findings, result.insights).startswith("# Table of 40 rows")
    assert P.analyze_target(files.read_data(spark, str(path)), "price")


def test_streaming_counters(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), None if h % 2 else 1.0, h) for h in range(6)] * 2
    spark.createDataFrame(rows, "ts timestamp, v double, id int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double, id int").parquet(str(tmp_path / "in"))
    q = counters.windowed_quality(counters.deduplicated(stream, ["id"], "ts"), "ts", ["v"], "2 hours", None).writeStream.outputMode("append").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    batch = counters.windowed_quality(spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["id"]), "ts", ["v"], "2 hours").collect()
    assert {(r.rows, r.v_missing) for r in batch} == {(2, 1)}
    assert spark.sql("select * from counted").count() <= len(batch)


FLOATS = 6


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), FLOATS) if v is not None and not isinstance(v, (str, bool)) and hasattr(v, "__float__") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())
