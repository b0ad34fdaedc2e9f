"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts into chunks wherever its low bits are
zero, so a passage that many documents share is cut alike in each. A worker keeps
the ids of the chunks it has met, and a shared chunk is encoded once per worker.
At a join the encodings of the two chunks may disagree with that of the whole
text, so the join is repaired: the text around it is encoded again, from the left
chunk's last safe stretch to the right chunk's first one, both included. The new ids
must begin with the left chunk's own ids of its last stretch and end with the right
chunk's own ids of its first one. Where they don't, the text to encode again grows
by the chunk that disagrees (and the one before it on the left), until both sides
agree or the text's ends are reached. A stretch lies between safe places: spaces that
a non-space follows, where a pre-token starts in every context. A chunk without two
safe places is added to the text to encode again.

The new pieces (runs between spaces) of about 1 MB of texts are encoded in one call of
the library before the texts themselves, which then mostly join known ids.

The chunks stay in the tasks that read them, and a worker forgets chunks at the end
of a task and once their ids and keys pass `CHUNK_BYTES`; a chunk is then encoded again, with the same ids. A
tokenizer whose pre-tokens don't start at spaces (`Pieces.splits` is false) has no
safe places, so its texts are encoded whole.

Ids are those of the tokenizers library with add_special_tokens=False; decoding is
its decode(ids, skip_special_tokens=False). Defined cases: null text encodes as the
empty text (no ids, decodes to ''); repeated rows each keep their row; an empty
table gives an empty result; other columns are not touched, but `ids` and `decoded`
replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalotus.llm.byte_bpe import Decoder, Pieces, shared
from datalotus.llm.common import column, row, slices, trim

MASK, LEAST = (1 << 10) - 1, 64  # chunks of 1 KB on average
CHUNK_BYTES = 32 << 20  # of ids and keys kept by a worker
PIECES, PRE_TOKENS = 80_000, 10_000  # of each generation kept by a worker
ROWS, BYTES = 512, 1 << 20  # of texts coded at once
_SAFE = re.compile(rb" (?=[\x21-\x7e\xc3-\xdf])")
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; the last one is the text's end."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    ends, last = [], 0
    for at in (np.nonzero((h & np.uint32(MASK << 10)) == 0)[0] + 1).tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:  # inside a character
            at += 1
        if at - last >= LEAST and at < len(data):
            ends.append(at)
            last = at
    return [*ends, len(data)]


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path, PIECES, PRE_TOKENS)
        self.decoder = Decoder(path, self.pieces.tokenizer)
        self.decimals: list[bytes] = []
        self.chunks: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.held = self.hits = self.widened = 0

    def _chunk(self, chunk: bytes) -> tuple | None:
        """First and last safe place, the ids between them, where the first stretch
        ends and its ids, where the last one starts and its ids; None without two."""
        found = self.chunks.get(chunk) or self.old.get(chunk)
        if found is None:
            found = self._made(chunk)
        else:
            self.hits += 1
        if chunk not in self.chunks:
            self.held += len(chunk) + len(found[2]) + len(found[4]) + len(found[6]) + 400
            if self.held > CHUNK_BYTES // 2:
                self.old, self.chunks, self.held = self.chunks, {}, 0
            self.chunks[chunk] = found
        return found if found[1] > found[0] else None

    def _made(self, chunk: bytes) -> tuple:
        first = _SAFE.search(chunk)
        second = first and _SAFE.search(chunk, first.end())
        if not second:
            return (-1, -1, b"", -1, b"", -1, b"")
        places = [first.start(), second.start(), *self._last_two(chunk, second.start())]
        encode = lambda a, b: self.pieces.encode(chunk[a:b].decode())
        whole = encode(places[0], places[3])
        head = encode(places[0], places[1])
        return (places[0], places[3], whole, places[1], head, places[2], encode(places[2], places[3]))

    def forget(self) -> None:
        """Drop the chunks and half of the pieces: an idle worker holds little."""
        self.chunks, self.old, self.held = {}, {}, 0
        self.pieces.forget()

    @staticmethod
    def _last_two(chunk: bytes, second: int) -> tuple[int, int]:
        found, at = [], len(chunk)
        while len(found) < 2 and at > second:
            at = chunk.rfind(b" ", 0, at)
            if _SAFE.match(chunk, at):
                found.append(at)
        return (found[1], found[0]) if len(found) == 2 else (_SAFE.search(chunk).start(), second)

    def learn(self, texts: list[str]) -> None:
        """Learn the pieces of texts that are encoded next; long texts are learnt by and by."""
        self.pieces.learn([t for t in texts if len(t) <= BYTES])

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of them as a list with commas and of the decoded text."""
        if not self.decimals:
            self.decimals = [b"%d" % i for i in range(len(self.decoder.lengths))]
        each = np.frombuffer(ids, np.int32)
        text = self.decoder.decode(each).decode("utf-8", "replace")
        return len(each), sha256(b",".join(map(self.decimals.__getitem__, each.tolist()))).hexdigest(), sha256(text.encode()).hexdigest()

    def encode(self, text: str) -> bytes:
        if not self.pieces.splits:
            return self.pieces.encode(text)
        data = text.encode()
        learnt = 0 if len(text) > BYTES else len(data)
        done: list[tuple[int, bytes, bytes]] = []  # settled ids, with the seam and known ids before them
        seam, known, start = 0, b"", 0  # text from `seam` on is open; its first ids must be `known`
        for end in cuts(data):
            if end > learnt:
                learnt = max(end, start + BYTES)
                self.pieces.learn([data[start:learnt].decode("utf-8", "ignore")])
            chunk = self._chunk(data[start:end])
            if chunk is not None:
                first, last, ids, upto, head, tail_at, tail = chunk
                while True:
                    joint = self.pieces.encode(data[seam : start + upto].decode())
                    if joint.startswith(known):
                        break
                    self.widened += 1  # the left chunk disagrees: it is opened again
                    seam, known = done.pop()[:2]
                if len(joint) >= len(known) + len(head) and joint.endswith(head):
                    done.append((seam, known, joint[len(known) : len(joint) - len(head)] + ids))
                    seam, known = start + tail_at, tail
                else:
                    self.widened += 1
            start = end
        while not (joint := self.pieces.encode(data[seam:].decode())).startswith(known):
            self.widened += 1
            seam, known = done.pop()[:2]
        return b"".join([d[2] for d in done]) + joint[len(known) :]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, at: int | None) -> Iterator[tuple[pa.Array, ChunkEncoder, list[bytes]]]:
    """The first column's rows, in runs, with their ids. Texts are the column's field
    `at`, or the second column."""
    coder = shared(ChunkEncoder, path)
    for batch in batches:
        for part in slices(batch, batch.column(1) if at is None else batch.column(0).field(at), BYTES):
            for start in range(0, part.num_rows, ROWS):
                run = part.slice(start, ROWS)
                texts = [t or "" for t in (run.column(1) if at is None else run.column(0).field(at)).to_pylist()]
                coder.learn(texts)
                yield run.column(0), coder, [coder.encode(t) for t in texts]
    coder.forget()
    trim()


def _coder(path: str, at: int | None, decode: bool):  # noqa: ANN202
    """Batches of the first column with ids (and decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, coder, parts in _encoded(batches, path, at):
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            columns = [first, pa.ListArray.from_arrays(pa.array(offsets), values)]
            if decode:
                columns.append(pa.array([coder.decoder.decode(np.frombuffer(p, np.int32)).decode("utf-8", "replace") for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "ids", "decoded"][: len(columns)])

    return run


def _coded(rows: DataFrame, path: str, at: int | None, decode: bool) -> DataFrame:
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decode]
    return rows.mapInArrow(_coder(path, at, decode), T.StructType([rows.schema.fields[0], *new]))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """`docs` with `ids` (array<int>) and, if asked for, `decoded`."""
    new = ["ids", *["decoded"] * decode]
    coded = _coded(docs.select(row(docs).alias("doc")), tokenizer_path, docs.columns.index(text_col), decode)
    return coded.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *new)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the text of its ids; null ids decode to ''."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared(Decoder, tokenizer_path)
        for batch in batches:
            lists = batch.column(0).field(at)
            for start in range(0, batch.num_rows, ROWS):
                texts = [decoder.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in lists.slice(start, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, ROWS), pa.array(texts, pa.string())], names=["doc", "decoded"])

    rows = encoded.select(row(encoded).alias("doc"))
    done = rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("decoded", T.StringType())]))
    return done.select(*[F.col("doc").getField(c).alias(c) for c in encoded.columns if c.lower() != "decoded"], "decoded")


def digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, coder, parts in _encoded(batches, tokenizer_path, None):
            counts, ids, decoded = zip(*map(coder.digests, parts), strict=True)
            yield pa.RecordBatch.from_arrays([first, pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], *new]))
