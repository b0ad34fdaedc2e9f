"""Exact top-k search by inner product, pruned with multi-resolution segment
statistics.

Vectors are cut into segments; for two vectors the squared distance is at least
    sum over segments of m * ((mean_a - mean_b)**2 + (dev_a - dev_b)**2),
coarse segments first, then finer ones. As |a - b|**2 = |a|**2 + |b|**2 - 2ab, a
candidate whose lower bound exceeds |a|**2 + |b|**2 - 2 * (k-th best score so far)
can't enter the top k and is left out. In the products' terms: the dot product of
the two rows of statistics bounds ab from above and must reach the k-th best score.
Where few pairs of a tile survive, the exact product is computed for the survivors;
where many do (random vectors), the tile is multiplied whole, which is faster than
picking pairs and just as exact: float32 below 2**24, float64 below 2**53. Ties at the k-th score survive, so smaller ids win as asked.

First `SEED` candidates, chosen by a hash, are scored with all queries; the k-th
best of them is each query's first floor. The query set is written to the shared
folder with these floors, in blocks of `BLOCK` rows. Each task streams its candidates
in pieces and meets the blocks one by one. It keeps the best k and the floors of up
to `OPEN` blocks from batch to batch, so floors only rise; further blocks are read
again for each batch, from their first floors. A task's memory is thus bounded
whatever the size of either side, and only k rows per query and task are shuffled.

Scores are exact integers: products that could pass 2**62 are taken with integers of
any size, and a score that fits no long is an error. Bounds are floating-point, with
a slack above their rounding.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; vectors of different lengths aren't compared; a query's
own rows (its vec_id) are no candidates; candidate rows repeated with one vec_id
count once each, query rows repeated with one vec_id once (the first by value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.llm.common import Tables, column, new_path

BLOCK, PIECE, PAIRS = 2048, 4096, 1 << 15
SEED, OPEN = 1024, 32
TILE, DENSE = 256, 32  # queries of a tile; a tile with more than a DENSE-th of its pairs left is multiplied whole
SEGMENTS = (4, 16)

_NONE = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and q, the components as floor(scale * x)."""
    v, key = column(vector_col), column(id_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad & key.isNotNull()).select(key.cast("long").alias("vec_id"), q.alias("q"))


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, scaled so that the dot product of two rows bounds the
    vectors' product from above."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row of integer matrices, exact."""
    if len(a) == 0 or np.sqrt((a.astype(float) ** 2).sum(axis=1).max()) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max()) < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(x * y for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)


class _Piece:
    """Up to `PIECE` candidates in the order of their ids, prepared once for all blocks."""

    def __init__(self, ids: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], y[order]
        z = y.astype(float)
        self.ids, self.y, self.kinds = ids, y, {}
        self.norm, self.stats = (z * z).sum(axis=1), [_stats(z, s) for s in SEGMENTS]

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.y.astype(kind)
        return self.kinds[kind]


class _Block:
    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        x = q.astype(float)
        self.ids, self.exact_x, self.k = ids, q, k
        self.norm = (x * x).sum(axis=1)
        self.stats = [_stats(x, s) for s in SEGMENTS]
        self.q = np.empty(0, np.int64)
        self.v = np.empty(0, np.int64)
        self.s = np.empty(0, np.int64)
        self.floor, self.known = floor.copy(), floor > _NONE

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        q, v, s = np.concatenate([self.q, q]), np.concatenate([self.v, v]), np.concatenate([self.s, s])
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.v, self.s = q[keep], v[keep], s[keep]
        full = rank[keep] == self.k - 1
        at = self.q[full]
        self.floor[at] = np.maximum(self.floor[at], self.s[full])
        self.known[at] = True

    def search(self, piece: _Piece) -> None:
        hits = []
        for at in range(0, len(self.ids), TILE):
            rows = slice(at, at + TILE)
            other = self.ids[rows, None] != piece.ids[None, :]
            slack = 1e-9 * (self.norm[rows] + piece.norm.max()) + 1e-6
            least = np.where(self.known[rows], self.floor[rows].astype(float), -np.inf)
            passed = (self.stats[0][rows] @ piece.stats[0].T >= (least - slack)[:, None]) & other
            left = np.count_nonzero(passed)
            most = np.sqrt(self.norm[rows].max() * piece.norm.max()) * (1 + 1e-9)
            if left * DENSE > passed.size and most < 2.0**53:
                hits.append(self._dense(at, rows, other, piece, np.float32 if most < 2.0**24 else np.float64))
            elif left:
                self._sparse(at, passed, slack, piece)
        if hits:
            self.add(*map(np.concatenate, zip(*hits, strict=True)))

    def _dense(self, at: int, rows: slice, other: np.ndarray, piece: _Piece, kind: type) -> tuple:
        """All products of a tile at once. Each partial sum is an integer below the
        product of the lengths, which `kind` holds exactly."""
        s = self.exact_x[rows].astype(kind) @ piece.as_kind(kind).T
        good = other & (s >= self.floor[rows].astype(kind)[:, None])
        if np.count_nonzero(good) > 4 * self.k * len(s) and s.shape[1] > self.k:
            # first floors or many ties: the piece's k best of each query will do, of equal ones the smallest ids
            s = np.where(other, s, -np.inf)
            least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]
            tied = (s == least) & other
            good &= (s > least) | (tied & (np.cumsum(tied, axis=1) <= self.k))
        q, c = np.nonzero(good)
        return q + at, piece.ids[c], s[q, c].astype(np.int64)

    def _sparse(self, at: int, passed: np.ndarray, slack: np.ndarray, piece: _Piece) -> None:
        """The products of the pairs that the fine segments leave."""
        if not self.known[at : at + TILE].all():  # the nearest by the coarse bound give a floor
            upper = np.where(passed, self.stats[0][at : at + TILE] @ piece.stats[0].T, -np.inf)
            near = np.argpartition(-upper, min(self.k, upper.shape[1] - 1), axis=1)[:, : self.k]
            q, c = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
            q, c = q[passed[q, c]], c[passed[q, c]]
            self.add(q + at, piece.ids[c], _products(self.exact_x[q + at], piece.y[c]))
            passed[q, c] = False
        q, c = np.nonzero(passed)
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], c[i : i + PAIRS]
            least = np.where(self.known[a + at], self.floor[a + at].astype(float), -np.inf) - slack[a]
            fine = np.einsum("ij,ij->i", self.stats[1][a + at], piece.stats[1][b]) >= least
            a, b = a[fine] + at, b[fine]
            s = _products(self.exact_x[a], piece.y[b])
            good = ~self.known[a] | (s >= self.floor[a])
            self.add(a[good], piece.ids[b[good]], s[good])


def _blocks(path: str, dim: int, skip: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of queries of this length from number `skip` on: number, ids, vectors,
    floors. Their order is that of the files' names."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    number = 0
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        for batch in pq.ParquetFile(fs.open_input_file(info.path)).iter_batches(batch_size=BLOCK, columns=["vec_id", "q", "floor"]):
            for length, ids, x, rows in _matrices(batch):
                if length == dim:
                    if number >= skip:
                        yield number, ids, x, batch.column(2).to_numpy(zero_copy_only=False)[rows]
                    number += 1


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's vectors as a matrix for each length, with their row numbers."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = lists.offsets.to_numpy()
    lengths, starts = np.diff(offsets), offsets[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.nonzero(lengths == length)[0]
        yield int(length), ids[rows], flat[starts[rows][:, None] + np.arange(length)], rows


def _seeder(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, _NONE)
            for dim, ids, x, rows in _matrices(batch):
                if dim not in sample:
                    continue
                cids, y = sample[dim]
                for i, r in enumerate(rows):
                    others = y[cids != ids[i]]
                    s = _products(np.broadcast_to(x[i], others.shape), others)
                    if len(s) >= k:
                        floor[r] = np.partition(s, len(s) - k)[len(s) - k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor)], names=["vec_id", "q", "floor"])

    return run


def _searcher(path: str, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, list[_Block]] = {}
        left = OPEN

        def best(block: _Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(block.ids[block.q]), pa.array(block.v), pa.array(block.s)], schema=_FOUND)

        for batch in batches:
            for dim, ids, y, _ in _matrices(batch):
                pieces = [_Piece(ids[at : at + PIECE], y[at : at + PIECE]) for at in range(0, len(ids), PIECE)]
                mine = opened.setdefault(dim, [])

                def meet(block: _Block) -> None:
                    for piece in pieces:
                        block.search(piece)

                for block in mine:
                    meet(block)
                for number, qids, x, floor in _blocks(path, dim, len(mine)):
                    block = _Block(qids, x, floor, k)
                    meet(block)
                    if left and len(mine) == number:
                        mine.append(block)
                        left -= 1
                    else:
                        yield best(block)
        for blocks in opened.values():
            for block in blocks:
                yield best(block)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, tables: Tables | None = None) -> DataFrame:
    """`candidates` and `queries` as `quantise` gives them (integers). One row per
    query and rank: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    path = (tables or Tables(spark)).own(new_path(spark, "query-blocks"))
    once = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    picked = candidates.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(SEED).collect()  # at most SEED vectors
    sample = {n: [r for r in picked if len(r.q) == n] for n in {len(r.q) for r in picked}}
    sample = {n: (np.array([r.vec_id for r in rows]), np.array([r.q for r in rows], np.int64)) for n, rows in sample.items()}
    once.mapInArrow(_seeder(sample, k), "vec_id long, q array<long>, floor long").write.parquet(path)
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1)
    found = candidates.mapInArrow(_searcher(uri, k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
