"""Quality classifier by co-training.

Two views of a document: the content of its text (hashed words, hashed token
shapes, immediate repeats) and its page metadata (source, language and size as the
table states them; nothing is taken from the text). Each view has a naive Bayes
classifier, as in the original co-training algorithm, because its fit is a sum over
documents: a round is one pass, and no document is left out of it.

1. Features of all documents are computed once and written to the shared folder.
2. Round 0 fits both views on the labelled documents outside the calibration fold.
3. In each of `ROUNDS` rounds every view scores all other documents. Those it is
   sure of (calibrated probability at least `SURE` for a class) count with that
   class in the other view's next fit, beside the labelled ones.
4. Calibration: on the labelled documents of the fold, Platt scaling turns a view's
   score into log odds, and a logistic function combines the two views.

Text score: the mean over the document's tokens of the features' log odds, so that
long texts aren't overrated. Sums are integers (shares in units of 1 / `UNIT`), so
reruns and other partitionings give the same model.

At most `LABELLED` labelled documents are used as such, chosen by a hash of the id;
the others take part as unlabelled ones. That is the only bound.

Defined cases: null text is the empty text (only intercepts and metadata speak);
null metadata is a value of its own, and so is a metadata column that the table
lacks; documents with several labels count by their mean, ties as good; labels
without document are ignored; if a class has no label inside or outside the fold,
every score is the good class's share (0.5 without labels); repeated rows each keep
their row and weight; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalotus.llm.common import Tables, column, materialize, partitions, slices, trim

LABELLED, ROUNDS, SURE = 4000, 3, 0.97
META = ("source", "lang", "n_chars")
TEXT_DIM, META_DIM, THRESHOLD = 1 << 12, 1 << 9, 0.5
UNIT = 1 << 24
CACHE, SLICE = 200_000, 2 << 20
_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "9"))
FEATURES = "y int, fold boolean, at binary, share binary, meta binary"


class _Features(dict):
    """Token to a small number; its word and shape features stand in arrays."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.shape = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32)

    def __missing__(self, token: str) -> int:
        at = len(self)
        shape = token
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        self.word[at] = zlib.crc32(token.lower().encode()) % (TEXT_DIM // 2)
        self.shape[at] = TEXT_DIM // 2 + 1 + zlib.crc32(shape[:40].encode()) % (TEXT_DIM // 2 - 1)
        self[token] = at
        return at

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's features and their shares of its tokens in units of 1 / UNIT."""
        counts = np.zeros(TEXT_DIM, np.int64)
        tokens = (text or "").split()
        before = None
        for start in range(0, len(tokens), CACHE // 2):
            part = tokens[start : start + CACHE // 2]
            if len(self) + len(part) > CACHE:
                self.clear()
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            counts += np.bincount(self.word[at], minlength=TEXT_DIM) + np.bincount(self.shape[at], minlength=TEXT_DIM)
            counts[TEXT_DIM // 2] += int((at[1:] == at[:-1]).sum()) + (part[0] == before)
            before = part[-1]
        found = np.nonzero(counts)[0]
        return found.astype(np.uint16), np.ceil(counts[found] * (UNIT / max(1, len(tokens)))).astype(np.int32)


def facts(values: Sequence[object]) -> list[int]:
    """Metadata features: each value (numbers by their bit length), then all in one."""
    shown = [f"{i}:{v.bit_length() if isinstance(v, int) else v}" for i, v in enumerate(values)]
    return sorted({zlib.crc32(f.encode()) % META_DIM for f in [*shown, "|".join(shown)]})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and intercept (last) of a logistic fit by Newton's method."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = _sigmoid(z @ w)
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return w


class Counts:
    """Sums by class (bad, good) of both views, as one vector of integers."""

    SIZE = 2 * TEXT_DIM + 2 * META_DIM + 4

    def __init__(self, flat: np.ndarray | None = None) -> None:
        self.flat = np.zeros(self.SIZE, np.int64) if flat is None else flat
        self.text = self.flat[: 2 * TEXT_DIM].reshape(2, TEXT_DIM)
        self.meta = self.flat[2 * TEXT_DIM : -4].reshape(2, META_DIM)
        self.docs = self.flat[-4:].reshape(2, 2)  # view, class


class View:
    """Naive Bayes of both views: log odds of every feature."""

    def __init__(self, c: Counts) -> None:
        smooth = UNIT / 8
        text = np.log(c.text + smooth) - np.log(c.text.sum(axis=1, keepdims=True) + smooth * TEXT_DIM)
        meta = np.log(c.meta + 1.0) - np.log(c.docs[1][:, None] + 2.0)
        self.text, self.meta = text[1] - text[0], meta[1] - meta[0]


class Rows:
    """A batch of features as flat arrays."""

    def __init__(self, at: Sequence[bytes], share: Sequence[bytes], meta: Sequence[bytes]) -> None:
        self.n = len(at)
        self.at, self.share = np.frombuffer(b"".join(at), np.uint16), np.frombuffer(b"".join(share), np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n), [len(a) // 2 for a in at])
        self.meta = np.frombuffer(b"".join(meta), np.uint16)
        self.owner = np.repeat(np.arange(self.n), [len(m) // 2 for m in meta])

    def scores(self, view: View) -> np.ndarray:
        """One column for each view."""
        text = np.bincount(self.doc, self.share * view.text[self.at], self.n) / UNIT
        return np.stack([text, np.bincount(self.owner, view.meta[self.meta], self.n)], axis=1)

    def count(self, into: Counts, text_class: np.ndarray, meta_class: np.ndarray) -> None:
        """Add the rows by class in each view; class -1 takes no part."""
        for c in (0, 1):
            t, m = text_class == c, meta_class == c
            into.text[c] += np.bincount(self.at, self.share * t[self.doc], TEXT_DIM).astype(np.int64)
            into.meta[c] += np.bincount(self.meta, m[self.owner], META_DIM).astype(np.int64)
            into.docs[:, c] += (int(t.sum()), int(m.sum()))


class Model:
    def __init__(self, view: View, platt: list[np.ndarray], blend: np.ndarray) -> None:
        self.view, self.platt, self.blend = view, platt, blend

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Log odds of each view."""
        return np.stack([w[0] * raw[:, i] + w[1] for i, w in enumerate(self.platt)], axis=1)

    def score(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.calibrated(raw)
        return _sigmoid(c), _sigmoid(c @ self.blend[:-1] + self.blend[-1])

    def sure(self, raw: np.ndarray, at: float) -> np.ndarray:
        """The class each view is sure of, or -1."""
        p = _sigmoid(self.calibrated(raw))
        return np.where(p >= at, 1, np.where(1 - p >= at, 0, -1))


def calibrate(view: View, rows: Rows, y: np.ndarray) -> Model:
    raw = rows.scores(view)
    platt = [logistic(raw[:, i : i + 1], y) for i in (0, 1)]
    c = np.stack([w[0] * raw[:, i] + w[1] for i, w in enumerate(platt)], axis=1)
    return Model(view, platt, logistic(c, y))


def features(docs: DataFrame, labels: DataFrame | None = None, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = META) -> DataFrame:
    """doc_id, y (null: unlabelled), fold (of calibration), at and share (features of
    the text), meta."""
    have = {c.lower() for c in docs.columns}
    meta = [column(c) if c.lower() in have else F.lit(None).cast("string") for c in meta_cols]
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), *[m.alias(f"m{i}") for i, m in enumerate(meta)])
    if labels is not None:
        per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        picked = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
        rows = rows.join(F.broadcast(picked), "doc_id", "left")  # at most `labelled` rows
    else:
        rows = rows.withColumn("y", F.lit(None).cast("int"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 0
    rows = rows.select("doc_id", "y", fold.alias("fold"), "text", *[f"m{i}" for i in range(len(meta))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for whole in batches:
            for batch in slices(whole, whole.column(3), SLICE):
                text = [known.of(t) for t in batch.column(3).to_pylist()]
                m = [np.array(facts(v), np.uint16).tobytes() for v in zip(*[batch.column(i).to_pylist() for i in range(4, batch.num_columns)], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a.tobytes() for a, _ in text], pa.binary()), pa.array([s.tobytes() for _, s in text], pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "y", "fold", "at", "share", "meta"])
        del known
        trim()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FEATURES}")


def _rows(batch: pa.RecordBatch) -> Rows:
    return Rows(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "share", "meta")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield batch.slice(start, 1000)


def _sum(table: DataFrame, model: Model | None, sure: float) -> Counts:
    """Class sums of a pass over all documents: in the tasks, then in a shuffle of one
    vector a task, then over one vector a shuffle partition."""
    sent = table.sparkSession.sparkContext.broadcast(model)  # TEXT_DIM + META_DIM weights

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, m = Counts(), sent.value
        for batch in _pieces(batches):
            rows = _rows(batch)
            y = np.array([-1 if v is None else v for v in batch.column(0).to_pylist()])
            known = np.where(np.array(batch.column(1).to_pylist(), bool), -1, y)
            classes = np.full((rows.n, 2), -1) if m is None else np.where(y[:, None] < 0, m.sure(rows.scores(m.view), sure), -1)
            # what one view is sure of counts in the other
            rows.count(into, np.where(known >= 0, known, classes[:, 1]), np.where(known >= 0, known, classes[:, 0]))
        yield pa.RecordBatch.from_pydict({"sums": [into.flat.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(Counts.SIZE, np.int64)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    used = table.select("y", "fold", "at", "share", "meta")
    if model is None:
        used = used.where("y is not null")
    per_task = used.mapInArrow(count, "sums binary").repartition(min(partitions(table.sparkSession), 64))
    return Counts(np.frombuffer(per_task.mapInArrow(add, "sums binary").coalesce(1).mapInArrow(add, "sums binary").first().sums, np.int64).copy())


def fit(table: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> Model | float:
    """`table` as `features` gives it, written."""
    held = table.where("y is not null and fold").select("y", "at", "share", "meta").collect()  # a quarter of LABELLED documents
    counts = _sum(table, None, sure)
    y, n = np.array([r.y for r in held], float), counts.docs[0]
    if not len(y) or y.min() == y.max() or not n.min():
        good, of = float(y.sum() + n[1]), float(len(y) + n.sum())
        return good / of if of else 0.5
    rows = Rows(*[[bytes(r[c]) for r in held] for c in ("at", "share", "meta")])
    model = calibrate(View(counts), rows, y)
    for _ in range(rounds):
        model = calibrate(View(_sum(table, model, sure)), rows, y)
    return model


def score(table: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every document of `features`."""
    sent = table.sparkSession.sparkContext.broadcast(model)  # TEXT_DIM + META_DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in _pieces(batches):
            n = batch.num_rows
            parts, whole = (np.full((n, 2), m), np.full(n, m)) if isinstance(m, float) else m.score(_rows(batch).scores(m.view))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(whole)], names=["doc_id", "text_score", "meta_score", "score"])

    used = table.select("doc_id", "at", "share", "meta")
    out = used.mapInArrow(run, f"doc_id {used.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Fit on `docs` and their `labels` (doc_id, quality), and score every document."""
    table = materialize(features(docs, labels), "features", tables)
    return score(table, fit(table))
