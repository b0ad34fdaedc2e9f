"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. For an unseen word its
character n-grams (with marks at both ends) decide, the longest known length
first, then progressively shorter ones. A text's score for a language is the mean
over its words; the returned score is the posterior of the best language, with the
evidence of at most `EVIDENCE` words counted in full.

The model is fitted on a bounded sample: at most `PER_LANG` documents of each
language, chosen by a hash of the text (copies of a text count once), whose crc32(doc_id as text) mod 4 is not 2,
and it keeps the `VOCABULARY` most frequent words of each language. Prediction
reads every whole text and never lang, source or doc_id.

Words are runs of letters (Unicode category L) in lower case, found by the same
code when learning and when predicting; numerals such as ½ or Ⅷ are no letters.
The worker splits a slice of texts at a time, so its memory doesn't grow with them.

Defined cases: null texts and texts without a letter are `und` with score 0; a
null lang isn't learned from; a null doc_id isn't held out; with nothing to learn
from every text is `und`; ties go to the smaller language code; repeated rows each
keep their row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from datalotus.llm.common import column, row, slices, trim

PER_LANG, VOCABULARY, EVIDENCE, NGRAM = 2000, 20_000, 20, 4
LANGUAGES = 1000  # the model's tables are bounded by this times VOCABULARY
CACHE = 200_000
SLICE = 1 << 20  # characters of text that a worker splits at once


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def letter_runs(text: str) -> list[str]:
    """Words: the runs of letters (Unicode category L) in lower case."""
    out = []
    for token in text.lower().split():
        # str.isalpha() holds for category L only
        out += (token,) if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()
    return out


class Model:
    """Log frequencies by word and by n-gram: dictionaries from key to the row of one
    matrix. Plain data, so that it can be sent to the tasks."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.langs = sorted(counts)
        grams: list[list[Counter]] = [[Counter() for _ in self.langs] for _ in range(NGRAM)]
        for i, lang in enumerate(self.langs):
            for word, n in counts[lang].items():
                w = f"<{word}>"
                for size in range(1, NGRAM + 1):
                    for at in range(len(w) - size + 1):
                        grams[size - 1][i][w[at : at + size]] += n
        rows: list[np.ndarray] = [np.zeros((1, len(self.langs)), np.float32)]
        self.words = self._table([counts[lang] for lang in self.langs], rows)
        self.grams = [self._table(g, rows) for g in grams]
        self.rows = np.concatenate(rows)

    @staticmethod
    def _table(counts: list[dict[str, int]], rows: list[np.ndarray]) -> dict[str, int]:
        start = sum(len(r) for r in rows)
        keys = {k: i for i, k in enumerate(dict.fromkeys(k for c in counts for k in c))}
        table = np.zeros((len(keys), len(counts)), np.float32)
        for i, c in enumerate(counts):
            for k, n in c.items():
                table[keys[k], i] = n
        total = table.sum(axis=0, dtype=float)
        rows.append((np.log(table + 0.5) - np.log(total + 0.5 * len(keys) + 1)).astype(np.float32))
        return {k: start + i for k, i in keys.items()}

    def parts(self, word: str) -> list[int]:
        """Rows whose mean is the word's score: the word's own, or those of its known
        n-grams of the longest length that has any."""
        at = self.words.get(word)
        if at is not None:
            return [at]
        w = f"<{word}>"
        for size in range(NGRAM, 0, -1):
            get = self.grams[size - 1].get
            known = [r for i in range(len(w) - size + 1) if (r := get(w[i : i + size])) is not None]
            if known:
                return known
        return [0]


class _Tokens:
    """Scores of tokens seen by this worker: a bounded table from token to the row of
    a matrix with the summed scores and the number of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.at = model, np.zeros((CACHE, len(model.langs) + 1), np.float32), {}

    def learn(self, tokens: set[str]) -> None:
        """Score new tokens, all in one pass over the model's matrix."""
        new = [t for t in tokens if t not in self.at]
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = list(tokens)
        parts: list[int] = []
        starts, owner, runs = [], [], np.zeros(len(new), np.float32)
        for i, token in enumerate(new):
            found = letter_runs(token)
            runs[i] = len(found)
            for word in found:
                starts.append(len(parts))
                owner.append(i)
                parts += self.model.parts(word)
        base = len(self.at)
        self.at.update((t, base + i) for i, t in enumerate(new))
        here = self.rows[base : base + len(new)]
        here[:] = 0
        here[:, -1] = runs
        if parts:
            sums = np.add.reduceat(self.model.rows[parts], starts, axis=0)
            sizes = np.diff(np.append(starts, len(parts)))[:, None]
            np.add.at(here[:, :-1], owner, sums / sizes)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        split = [(t or "").split() for t in texts]
        start = 0
        while start < len(split):  # as many documents at once as the table holds with ease
            end, size = start + 1, len(split[start])
            while end < len(split) and size + len(split[end]) <= CACHE // 4:
                size += len(split[end])
                end += 1
            few = size <= CACHE // 2
            if few:
                self.learn(set().union(*split[start:end]))
            out += [self._one(tokens, few) for tokens in split[start:end]]
            start = end
        return out

    def _one(self, tokens: list[str], known: bool) -> tuple[str, float]:
        sums = np.zeros(self.rows.shape[1])
        for i in range(0, len(tokens), CACHE // 2):
            part = tokens[i : i + CACHE // 2]
            if not known:
                self.learn(set(part))
            sums += self.rows[list(map(self.at.__getitem__, part))].sum(axis=0, dtype=float)
        n, langs = sums[-1], self.model.langs
        if not n or not langs:
            return "und", 0.0
        scores = sums[:-1] / n * min(n, EVIDENCE)
        best = int(np.argmax(scores))
        return langs[best], float(1 / np.exp(scores - scores[best]).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, vocabulary: int = VOCABULARY) -> Model:
    text, lang = column(text_col), column(lang_col)
    usable = docs.where(text.isNotNull() & lang.isNotNull() & ~held_out(column(id_col))).select(text.alias("text"), lang.alias("lang"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model({})
    every = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, max(1, math.ceil(n / per_lang)))])
    # copies of a text are one document here, so a hot text is one row of the sample
    sample = usable.where(F.pmod(F.xxhash64("text"), every[F.col("lang")]) == 0).withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    sample = sample.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, batch.column(1), SLICE):
                seen = Counter((lang, word) for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for word in letter_runs(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    found = sample.mapInArrow(split, "lang string, word string, n long")
    counts = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= vocabulary).select("lang", "word", "n")
    table: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for r in kept.toLocalIterator():
        table[r.lang][r.word] = r.n
    return Model(table)


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc (the whole row as a struct), lang_pred, lang_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES * VOCABULARY words and their n-grams
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(sent.value)
        for batch in batches:
            for rows in slices(batch, batch.column(0).field(at), SLICE):
                out = tokens.predict(rows.column(0).field(at).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc", "lang_pred", "lang_score"])
        del tokens
        trim()

    rows = docs.select(row(docs).alias("doc"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and lang_score, which replace columns of these names."""
    new = ("lang_pred", "lang_score")
    return judge(docs, model, text_col).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *new)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, id_col, text_col, lang_col)
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    done = judge(slim, model)
    return done.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
