"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the token counts of frequent pre-tokens (the pieces
between single spaces), at most `TABLE` entries, broadcast to all tasks. It is
filled from a bounded sample of `SAMPLE` documents and only saves time: whatever it
lacks is encoded by the tokenizer and kept in the worker's cache (tier 2), so the
counts don't depend on it. No pre-token is shuffled; documents stay in their tasks.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings
inside texts are handled as the library does by default; repeated rows each keep
their row; an empty table gives an empty result; other columns are ignored.
A `.json` path is read with tokenizers, a `.model` path with sentencepiece.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalotus.llm.byte_bpe import LONGEST, Lengths, Pieces, Unsafe, _OPEN, shared
from datalotus.llm.common import column, slices

TABLE, SAMPLE = 1 << 16, 4096
SLICE = 4 << 20  # bytes of text that a worker reads at once


class _Sentences:
    """Counts by sentencepiece, which has no separable pre-tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text", sample: int = SAMPLE, table: int = TABLE) -> tuple[str, bytes]:
    """The most frequent pieces of a bounded sample, joined by spaces, and their
    token counts as 16-bit numbers."""
    rows = docs.count()
    every = max(1, rows // sample)
    text = column(text_col)
    picked = docs.where(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(every)) == 0)).select(text.alias("text")).limit(sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(t.split(" ")[1:])
        pieces, keys, counts = Pieces(tokenizer_path), [], array("H")
        for piece, _ in seen.most_common(table):
            try:
                n = len(pieces._piece(piece)) // 4
            except Unsafe:
                continue
            if len(piece) <= LONGEST:
                keys.append(piece)
                counts.append(n)
        yield pa.RecordBatch.from_pydict({"keys": [" ".join(keys)], "counts": [counts.tobytes()]})

    found = picked.mapInArrow(run, "keys string, counts binary").collect()
    return (found[0].keys, bytes(found[0].counts)) if found else ("", b"")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, sample: int = SAMPLE, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    slim = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    slim = slim.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    pieces = tokenizer_path.endswith(".json")
    found = frequent_lengths(docs, tokenizer_path, text_col, sample, table) if pieces else None
    key = ("Lengths", tokenizer_path, found and hashlib.sha256(found[0].encode() + found[1]).digest())
    packed = docs.sparkSession.sparkContext.broadcast(found)  # at most `table` entries of LONGEST characters

    def counter():  # noqa: ANN202
        if not pieces:
            return shared(_Sentences, tokenizer_path)
        if key not in _OPEN:
            for other in [k for k in _OPEN if k[:2] == key[:2]]:
                del _OPEN[other]
            keys, counts = packed.value
            known = dict(zip(keys.split(" "), array("H", counts), strict=True)) if counts else {}
            _OPEN[key] = Lengths(Pieces(tokenizer_path), known)
        return _OPEN[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter().count
        for batch in batches:
            for rows in slices(batch, batch.column(2), SLICE):
                n = pa.array([count(t) for t in rows.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = slim.mapInArrow(run, slim.schema["doc_id"].simpleString().replace(":", " ") + ", n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
