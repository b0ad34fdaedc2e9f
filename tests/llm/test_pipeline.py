import hashlib
import math

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datalotus.llm import language_id
from tests.llm import brute


def mixed(docs):
    """Copies of each document, by brute force."""
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in docs}
    sizes = {}
    for d, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size[d]
    want, start, copies = brute.targets(sizes), dict.fromkeys(sizes, 0), {}
    for d, _, s in sorted(docs, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        full = math.floor(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        rest = want[s] - full * sizes[s]
        copies[d] = full + (rest > 1e-9 and 2 * start[s] + size[d] <= 2 * rest) if sizes[s] else 0
        start[s] += size[d]
    return copies


def test_pipeline_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    judged = language_id.predict(docs, language_id.fit(docs))
    rejected = {r.doc_id for r in judged.where((F.col("lang_pred") == "und") | (F.col("lang_score") < corpus_pipeline.LEAST_SCORE)).collect()}
    assert len(rejected) <= 0.02 * len(text)
    kept = {d: t for d, (t, _) in text.items() if d not in rejected}
    kept = {d: kept[d] for d, (_, _, stays, _) in brute.exact(kept.items()).items() if stays}
    kept = {d: kept[d] for d, (_, _, stays) in brute.near(kept.items()).items() if stays}
    copies = mixed([(d, t, text[d][1]) for d, t in kept.items()])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, len(library.encode(kept[d], add_special_tokens=False).ids)) for d, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_keep_columns_and_survive_odd_tables(spark):
    rows = [(1, "some plain english words here", "en", "a", 5, "x"), (2, None, "en", "a", None, None), (None, "other words of the text", None, None, 3, "y"), (3, "", "fr", "a", 0, "z"), (3, "again and again", "fr", "b", 0, "z"), (3, "again and again", "fr", "b", 0, "z")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, copy string")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
            assert docs.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
