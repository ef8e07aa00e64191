"""Exact top-k inner products with a bit-sliced index.

Vectors are whole numbers. The index is a written table of blocks of up to BLOCK
vectors: their exact values, and for every component COARSE_BITS bitmaps (slices) of its value
rounded to a coarser step, offset so that it is not negative. A query adds the
slices of all components, weighted by its own rounded values, with carry-save
bitmap arithmetic; the sum is again a set of slices. From the most significant
slice downward the k-th best coarse score is found. Rounding errors are bounded,
so every row that could still be among the best is above that score less twice
the bound; those boundary rows are scored exactly.

The index is not moved: queries, in blocks, come to it by broadcasts of at most
QUERY_BYTES, as many one after the other as their table needs. So there are as many
tasks as the index has splits. A block returns k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import cut_lineage, scratch

BLOCK = 16384
QUERY_BLOCK = 256
#: Bytes of queries broadcast at a time.
QUERY_BYTES = 32 << 20
COARSE_BITS = 7
QUERY_BITS = 7


def quantised(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, values): floor(scale * x) of each component; vectors that are null or hold null or non-finite components go."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return df.filter(fine).select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("values"))


def _blocks(rows: DataFrame, size: int, sliced: bool) -> DataFrame:
    """(dim, ids, matrix): blocks of up to `size` vectors of one length, as bytes of 64-bit numbers; and `slices`, `bounds` of a `Slices`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            index = Slices.of(vectors).stored() if sliced else (None, None)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), vectors.tobytes(), *index)]], names=["dim", "ids", "matrix", "slices", "bounds"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, length = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(length)])
            for dim in np.unique(length).tolist():
                own = np.flatnonzero(length == dim)
                for lo in range(0, len(own), size):
                    part = own[lo : lo + size]
                    vectors = flat[start[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0), np.int64)
                    held.setdefault(dim, []).append((ids[part], vectors))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.filter("id IS NOT NULL").mapInArrow(run, "dim int, ids binary, matrix binary, slices binary, bounds binary")


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words."""
    pad = -bits.shape[-1] % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], axis=-1)
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


class Slices:
    """The coarse values of one block: slices[d][b] is the bitmap of bit b of component d."""

    def __init__(self, bits: np.ndarray, bounds: np.ndarray):
        self.bits = bits  # dim x COARSE_BITS x words
        self.rows, self.dim, self.shift, self.off, self.total = bounds.tolist()
        self.all = _packed(np.ones(self.rows, bool))

    @classmethod
    def of(cls, matrix: np.ndarray) -> "Slices":
        rows, dim = matrix.shape
        most = int(np.abs(matrix).max(initial=0))
        shift = max(0, most.bit_length() + 1 - COARSE_BITS)
        half, offset = (1 << shift) >> 1, 1 << (COARSE_BITS - 1)
        coarse = np.clip(((matrix + half) >> shift) + offset, 0, 2 * offset - 1)
        # The most that a component is off, the clipping of the largest values included.
        off = int(np.abs(((coarse - offset) << shift) - matrix).max(initial=0))
        total = int(np.abs(matrix).sum(axis=1).max(initial=0))
        bits = np.stack([_packed(((coarse.T >> b) & 1).astype(bool)) for b in range(COARSE_BITS)], axis=1)
        return cls(bits, np.array([rows, dim, shift, off, total], np.int64))

    def stored(self) -> tuple[bytes, bytes]:
        return self.bits.tobytes(), np.array([self.rows, self.dim, self.shift, self.off, self.total], np.int64).tobytes()

    @classmethod
    def read(cls, slices, bounds) -> "Slices":
        sizes = np.frombuffer(bounds, np.int64)
        words = np.frombuffer(slices, np.uint64) if len(slices) else np.zeros(0, np.uint64)
        return cls(words.reshape(int(sizes[1]), COARSE_BITS, -(-int(sizes[0]) // 64)), sizes)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of a coarse score, least significant first, and by how much an exact score can differ from it, in its unit.

        Where the query is negative the complement's slices are added, which changes
        all rows' scores by the same amount.
        """
        most = int(np.abs(query).max(initial=0))
        shift = max(0, most.bit_length() - QUERY_BITS)
        weight = (np.abs(query) + ((1 << shift) >> 1)) >> shift
        heap: list[list[np.ndarray]] = [[] for _ in range(64)]
        for d in np.flatnonzero(weight).tolist():
            w, negative = int(weight[d]), query[d] < 0
            for b, bitmap in enumerate(self.bits[d]):
                x = bitmap ^ self.all if negative else bitmap
                for j in range(w.bit_length()):
                    if w >> j & 1:
                        heap[b + j].append(x)
        out = []
        for level in range(63):
            todo = heap[level]
            while len(todo) > 2:
                x, y, z = todo.pop(), todo.pop(), todo.pop()
                half = x ^ y
                todo.insert(0, half ^ z)
                heap[level + 1].append((x & y) | (half & z))
            if len(todo) == 2:
                x, y = todo
                heap[level + 1].append(x & y)
                todo[:] = [x ^ y]
            out.append(todo[0] if todo else None)
        while out and out[-1] is None:
            out.pop()
        zero = np.zeros_like(self.all)
        error = int(np.abs(query).sum()) * self.off + ((1 << shift) >> 1) * (self.total + self.dim * self.off)
        return [zero if x is None else x for x in out], (error >> (self.shift + shift)) + 1

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best."""
        if self.rows <= k:
            return np.arange(self.rows)
        slices, error = self.scores(query)
        sure, tied, kth = np.zeros_like(self.all), self.all, 0
        n_sure = 0
        for i in range(len(slices) - 1, -1, -1):
            top = tied & slices[i]
            n = int(np.bitwise_count(top).sum())
            if n_sure + n >= k:
                tied, kth = top, kth | 1 << i
            else:
                sure, n_sure, tied = sure | top, n_sure + n, tied & ~slices[i]
        floor = max(0, kth - 2 * error)
        above, equal = np.zeros_like(self.all), self.all
        for i in range(len(slices) - 1, -1, -1):
            if floor >> i & 1:
                equal = equal & slices[i]
            else:
                above, equal = above | (equal & slices[i]), equal & ~slices[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.rows])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (dim, ids, matrix, slices, bounds, q_ids, q_matrix) -> the k best of each block for each of the queries."""
    for batch in batches:
        for r in range(batch.num_rows):
            dim = batch.column(0)[r].as_py()
            ids, q_ids = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (1, 5))
            matrix, queries = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64).reshape(-1, dim) if dim else np.zeros((n, 0), np.int64) for c, n in ((2, len(ids)), (6, len(q_ids))))
            index = Slices.read(*(batch.column(c)[r].as_buffer() for c in (3, 4)))
            found = []
            for q, vector in zip(q_ids.tolist(), queries):
                # One more than asked for: the query's own row may be among them.
                near = index.boundary(vector, k + int((ids == q).sum()))
                near = near[ids[near] != q]
                score = matrix[near] @ vector
                best = np.lexsort((ids[near], -score))[:k]
                found.append((np.full(len(best), q), ids[near][best], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["query_id", "vec_id", "score"])


def build(vectors: DataFrame, keep=cut_lineage) -> DataFrame:
    """The index of (id, values) rows as a written table; `search` may use it again and again."""
    return keep(_blocks(vectors, BLOCK, True))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products per query, ties to the smaller id.

    Both frames are (id, values) as from `quantised`. A row with the query's own id is
    no candidate; vectors of another length than the query's are none either. Fewer
    candidates give fewer rows. Ids that are null take no part. Queries that repeat an
    id count once (the least vector); candidates that repeat one come as often. Empty
    tables give no rows. Scores are 64-bit numbers. The result's columns are fixed.
    """
    with scratch(vectors.sparkSession) as keep:
        return cut_lineage(search_index(build(vectors, keep), queries, k, keep))


def search_index(index: DataFrame, queries: DataFrame, k: int, keep=cut_lineage) -> DataFrame:
    """As `search`, over an index that was built before."""
    least = queries.filter("id IS NOT NULL").groupBy("id").agg(F.min("values").alias("values"))
    asked = keep(_blocks(least, QUERY_BLOCK, False).select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")))
    size = asked.agg(F.coalesce(F.sum(F.length("q_ids") + F.length("q_matrix")), F.lit(0))).first()[0]
    turns = max(1, -(-size // QUERY_BYTES))
    turn = F.pmod(F.xxhash64("q_ids"), F.lit(turns))
    best = None
    for n in range(turns):
        met = index.join(F.broadcast(asked.filter(turn == n)), "dim").select("dim", "ids", "matrix", "slices", "bounds", "q_ids", "q_matrix")
        part = met.mapInArrow(lambda batches: _search(batches, k), "query_id bigint, vec_id bigint, score bigint")
        best = part if best is None else best.union(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
