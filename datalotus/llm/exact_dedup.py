"""Exact dedup by an extendible-hash index kept on shared files.

1. Each scan task hashes its texts (SHA-256; the first 64 bits are the key) and
   writes entries to the shared folder. A task stores equal texts once, within an
   Arrow batch and, as long as its `HELD` bytes of recent texts last, over all its
   batches: a repeat keeps only a pointer, so a text that makes up a third of all
   rows is shuffled about once per task and not once per row.
2. A histogram of the key's leading `MAX_BITS` bits (at most 65,536 rows) lets the
   driver build the directory: a bucket over its capacity splits, and the
   directory doubles when that bucket's depth equals the directory's.
3. Buckets are key ranges; consecutive buckets go to one owner task, which reads
   its texts in key order, chains different texts under one key and compares
   bytes. It writes one row for each stored text to the shared folder. A bucket
   that is still overfull at `MAX_BITS` is streamed like any other.
4. Entries meet their text's row through the pointer; only ids are moved.

Defined cases: a null text counts as the empty text; texts are equal only byte
for byte. Of equal texts the largest doc_id stays; a null doc_id is smaller than
any other; of rows repeated with one doc_id exactly one stays. An empty table
gives an empty result. Columns other than the two named ones are ignored here,
so clashing names do no harm; `dedup` returns them untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalotus.llm.common import Tables, column, materialize, partitions, row, slices, trim

MAX_BITS = 16
BUCKET_BYTES = 64 << 20
SLICE = 4 << 20  # bytes of text looked at together
HELD = 16 << 20  # bytes of recent texts a task compares with

ENTRY = "id long, uid long, rep long, key long, sha binary, n_bytes long, n long, top long, top_uid long, body binary"
OWNED = "rep long, keep_id long, keep_uid long, group_size long"
_ENTRY = pa.schema([("id", pa.int64()), ("uid", pa.int64()), ("rep", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("top", pa.int64()), ("top_uid", pa.int64()), ("body", pa.binary())])
_OWNED = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])


def _above(a: tuple, b: tuple) -> bool:
    """Whether (doc_id, uid) a stays rather than b."""
    return ((a[0] is not None, a[0] or 0), a[1]) > ((b[0] is not None, b[0] or 0), b[1])


class _Held:
    """Recent texts with where they are stored, in two generations of bounded size."""

    def __init__(self) -> None:
        self.young: dict[bytes, tuple[int, bytes]] = {}
        self.old: dict[bytes, tuple[int, bytes]] = {}
        self.size = 0

    def get(self, body: bytes) -> tuple[int, bytes] | None:
        found = self.young.get(body) or self.old.get(body)
        if found is not None and body not in self.young:
            self.add(body, found)
        return found

    def add(self, body: bytes, found: tuple[int, bytes]) -> None:
        if len(body) > HELD // 8:
            return
        self.size += len(body) + 150
        if self.size > HELD // 2:
            self.young, self.old, self.size = {}, self.young, len(body) + 150
        self.young[body] = found


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid, held = TaskContext.get().partitionId() << 36, _Held()
    for whole in batches:
        for batch in slices(whole, whole.column(1), SLICE):
            yield _entered(batch, uid, held)
            uid += batch.num_rows
    del held
    trim()


def _entered(batch: pa.RecordBatch, uid: int, held: _Held) -> pa.RecordBatch:
    ids, bodies = batch.column(0).to_pylist(), batch.column(1)
    first: dict[bytes, int] = {}
    out: dict[str, list] = {name: [] for name in _ENTRY.names[:-1]}
    take: list[int | None] = []
    for i, body in enumerate(bodies.to_pylist()):
        at = first.setdefault(body, i)
        if at == i:
            stored = held.get(body)
            rep, digest = stored or (uid + i, hashlib.sha256(body).digest())
            if stored is None:
                held.add(body, (rep, digest))
            out["rep"].append(rep)
            out["key"].append(int.from_bytes(digest[:8], "big", signed=True))
            out["sha"].append(digest)
            out["n"].append(1)
            out["top"].append(ids[i])
            out["top_uid"].append(uid + i)
            take.append(i if stored is None else None)
        else:
            for name in ("rep", "key", "sha"):
                out[name].append(out[name][at])
            out["n"][at] += 1
            if _above((ids[i], uid + i), (out["top"][at], out["top_uid"][at])):
                out["top"][at], out["top_uid"][at] = ids[i], uid + i
            for name in ("n", "top", "top_uid"):
                out[name].append(None)
            take.append(None)
        out["id"].append(ids[i])
        out["uid"].append(uid + i)
        out["n_bytes"].append(len(body))
    columns = [pa.array(out[f.name], f.type) for f in _ENTRY if f.name != "body"]
    return pa.RecordBatch.from_arrays([*columns, bodies.take(pa.array(take, pa.int32())).cast(pa.binary())], schema=_ENTRY)


def directory(histogram: dict[int, int], capacity: int, bits: int = MAX_BITS) -> list[int]:
    """Bucket numbers by leading key bits; the list's length is a power of two.

    `histogram` has bytes by the key's first `bits` bits. Starts as one bucket of
    depth 0; overfull buckets split until they fit or `bits` is reached.
    """
    below = [dict(histogram)]
    for _ in range(bits):
        level: dict[int, int] = {}
        for prefix, size in below[-1].items():
            level[prefix >> 1] = level.get(prefix >> 1, 0) + size
        below.append(level)
    size_at = below[::-1]  # by depth
    depth, slots = 0, [(0, 0)]  # slots: (local depth, prefix) of the slot's bucket
    todo = [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        if size_at[local].get(prefix, 0) <= capacity or local == bits:
            continue
        if local == depth:
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        width = 1 << (depth - local)
        start, half = prefix * width, width // 2
        for side in (0, 1):
            child = (local + 1, prefix * 2 + side)
            slots[start + side * half : start + (side + 1) * half] = [child] * half
            todo.append(child)
    number: dict[tuple[int, int], int] = {}
    return [number.setdefault(s, len(number)) for s in slots]


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order, of one key those with a text first. A chain holds the
    key's different texts; a row without its text belongs to the stored one it names."""
    key, chain, stored = None, [], {}

    def rows(chain: list) -> Iterator[tuple]:
        for _, size, top, reps in chain:
            for rep in reps:
                yield rep, top[0], top[1], size

    for batch in batches:
        done: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for rep, k, n, top, top_uid, body in zip(*columns, strict=True):
            if k != key:
                done.extend(rows(chain))
                key, chain, stored = k, [], {}
            link = stored[rep] if body is None else next((x for x in chain if x[0] == body), None)
            if link is None:
                chain.append([body, n, (top, top_uid), [rep]])
                stored[rep] = chain[-1]
                continue
            link[1] += n
            if _above((top, top_uid), link[2]):
                link[2] = (top, top_uid)
            if body is not None:
                link[3].append(rep)
                stored[rep] = link
        yield _batch(done)
    yield _batch(list(rows(chain)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_OWNED)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, tables: Tables | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """(entries, owned, directory); both tables lie in the shared folder."""
    spark = docs.sparkSession
    slim = docs.select(column(id_col).cast("long"), F.coalesce(column(text_col), F.lit("")).cast("binary"))
    entries = materialize(slim.mapInArrow(_entries, ENTRY), "dedup-entries", tables)
    top_bits = F.shiftrightunsigned("key", 64 - MAX_BITS)
    counts = entries.where("body is not null").groupBy(top_bits.alias("p")).agg(F.sum("n_bytes").alias("b")).collect()  # at most 2**MAX_BITS rows
    slots = directory({r.p: r.b for r in counts}, bucket_bytes)
    depth, buckets = len(slots).bit_length() - 1, max(slots) + 1
    owners = max(1, min(buckets, 4 * partitions(spark)))
    table = spark.createDataFrame([(i, b * owners // buckets) for i, b in enumerate(slots)], "slot int, owner int")  # at most 2**MAX_BITS rows
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    routed = entries.where("n is not null").select("rep", "key", "n", "top", "top_uid", "body", slot.alias("slot")).join(F.broadcast(table), "slot")
    ranges = routed.repartitionById(owners, F.col("owner")).sortWithinPartitions("key", F.col("body").isNull()).drop("slot", "owner")
    owned = materialize(ranges.mapInArrow(_owner, OWNED), "dedup-owned", tables)
    return entries, owned, slots


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, tables: Tables | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. It reads
    the index's tables, so `tables` may be released once it is written."""
    entries, owned, _ = build_index(docs, id_col, text_col, bucket_bytes, tables)
    return (
        entries.select("id", "uid", "rep", "sha")
        .join(owned, "rep")
        .select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """`docs` without repeats, all columns. Rows are matched by id and text hash;
    of rows repeated with one id and text one stays."""
    groups = exact_groups(docs, id_col, text_col, tables=tables).where("kept").select(F.col("doc_id").alias("keep_key"), F.unhex("text_sha256").alias("keep_sha"))
    sha = F.unhex(F.sha2(F.coalesce(column(text_col), F.lit("")).cast("binary"), 256))
    tagged = docs.select(row(docs).alias("doc"), column(id_col).cast("long").alias("key"), sha.alias("sha"))
    same = F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("sha") == F.col("keep_sha"))
    return tagged.join(groups, same, "left_semi").dropDuplicates(["key", "sha"]).select("doc.*")
