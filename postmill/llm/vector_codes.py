"""Short codes for vectors: each of PARTS parts is the index of its nearest codebook entry.

Nearest entries are found exactly by slicing and intersecting bitmasks. For each
coordinate of a part the codebook's entries are sorted, and beside the sorted
values lie masks of the first 0, 1, 2, .. entries (one bit an entry, so 64 entries
fit a uint64). For a part and a radius, two binary searches per coordinate give the
entries within that radius as the difference of two prefix masks; the masks of all
coordinates are ANDed. The initial radius is the distance to the best of the
entries that are nearest in a single coordinate. No entry outside the box can be
nearer, so the few entries left are measured and the best is exact.

Codebooks are the model: PARTS * ENTRIES rows, fitted in rounds over all vectors.
A task returns counts and sums for each entry; Spark adds them up, and only those
totals reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut_lineage, scratch

from .columns import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components are held within this, so that squared distances of up to 1024 components add up in 64 bits.
BOUND = 1 << 25


def quantised(df: DataFrame, key: str, vector: str, label: str | None = None, scale: int = SCALE) -> DataFrame:
    """(id, label, values): floor(scale * x) of each component, held within BOUND.

    Vectors that are null or hold null or non-finite components go.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-1.0 * BOUND), F.least(F.lit(1.0 * BOUND), v * scale))).cast("long"))
    tag = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    return df.filter(fine).select(F.col(f"`{key}`").cast("long").alias("id"), tag.alias("label"), whole.alias("values"))


@dataclass
class Slices:
    """One part's codebook with its sorted coordinates and prefix masks."""

    book: np.ndarray  # entries x width
    order: np.ndarray  # width x entries
    coordinates: np.ndarray  # width x entries, sorted
    prefixes: np.ndarray  # width x (entries + 1)

    @classmethod
    def of(cls, book: np.ndarray) -> "Slices":
        entries, width = book.shape
        order = np.argsort(book.T, axis=1, kind="stable")
        bits = np.uint64(1) << order.astype(np.uint64)
        prefixes = np.zeros((width, entries + 1), np.uint64)
        prefixes[:, 1:] = np.bitwise_or.accumulate(bits, axis=1)
        return cls(book, order, np.take_along_axis(book.T, order, axis=1), prefixes)

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.book[entry]) ** 2).sum(axis=1)

    def _initial(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to an entry that is near: of those next to each coordinate, the best."""
        best = self._distance(x, np.zeros(len(x), np.int64))
        for j, (values, order) in enumerate(zip(self.coordinates, self.order)):
            at = np.searchsorted(values, x[:, j]).clip(0, len(values) - 1)
            before = (at - 1).clip(0)
            at = np.where(np.abs(values[before] - x[:, j]) < np.abs(values[at] - x[:, j]), before, at)
            best = np.minimum(best, self._distance(x, order[at]))
        return best

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; ties go to the lower index."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        radius = np.ceil(np.sqrt(self._initial(x).astype(np.float64))).astype(np.int64) + 1
        entries = len(self.book)
        mask = np.full(len(x), (1 << entries) - 1, np.uint64)
        for j, (values, prefix) in enumerate(zip(self.coordinates, self.prefixes)):
            low = np.searchsorted(values, x[:, j] - radius, side="left")
            high = np.searchsorted(values, x[:, j] + radius, side="right")
            mask &= prefix[high] & ~prefix[low]
        held = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")
        row, entry = np.nonzero(held)
        distance = self._distance(x[row], entry)
        least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(x))))
        hit = np.flatnonzero(distance == least[row])[::-1]
        index = np.empty(len(x), np.int64)
        index[row[hit]] = entry[hit]  # the last written, so the lowest, stays
        return index, least


@dataclass
class Codebooks:
    """`books` is parts x entries x width; vectors of `length` components, filled up with zeros to parts * width."""

    length: int
    books: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def slices(self) -> list[Slices]:
        return [Slices.of(b) for b in self.books]

    def cut(self, lists: pa.Array) -> np.ndarray:
        """Rows of a list column as rows x parts x width."""
        return _filled(lists.flatten().to_numpy().reshape(len(lists), self.length), len(self.books))


def _filled(rows: np.ndarray, parts: int) -> np.ndarray:
    width = -(-rows.shape[1] // parts)
    full = np.zeros((len(rows), parts * width), np.int64)
    full[:, : rows.shape[1]] = rows
    return full.reshape(len(rows), parts, width)


def _of_length(vectors: DataFrame, books: Codebooks) -> DataFrame:
    return vectors.filter(F.size("values") == books.length)


def start(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of the `entries` vectors of smallest id (null last, then by components)."""
    if not 1 <= entries <= 64:
        raise ValueError("a mask of 64 bits holds 1 to 64 entries")
    order = [F.col("id").asc_nulls_last(), F.col("values")]
    first = vectors.orderBy(*order).select("values").first()
    length = len(first["values"]) if first else 0
    rows = vectors.filter(F.size("values") == length).orderBy(*order).limit(entries).select("values").collect()
    whole = np.array([r["values"] for r in rows], np.int64).reshape(len(rows), length)
    return Codebooks(length, _filled(whole, parts).transpose(1, 0, 2).copy())


def _totals(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, count, s0, s1, ..): each task's counts and sums of the parts next to an entry, added up."""
    parts, entries, width = books.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, count, sums = books.slices(), np.zeros((parts, entries), np.int64), np.zeros((width, parts, entries), np.int64)
        for batch in batches:
            x = books.cut(batch.column(0))
            for p in range(parts):
                index, _ = slices[p].nearest(x[:, p])
                count[p] += np.bincount(index, minlength=entries)
                for j in range(width):
                    # Exact: a batch's sums are far below 2 ** 53.
                    sums[j, p] += np.bincount(index, weights=x[:, p, j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *[pa.array(s[p, e]) for s in sums]]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "entry", "count", *[f"s{j}" for j in range(width)]]
    schema = "part int, entry int, count bigint" + "".join(f", s{j} bigint" for j in range(width))
    found = _of_length(vectors, books).select("values").mapInArrow(run, schema)
    return found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after `rounds` rounds over all vectors: entries move to the floor of the mean of their parts; unused ones stay."""
    books = start(vectors, parts, entries)
    if not books.books.size:
        return books
    for _ in range(rounds):
        moved = books.books.copy()
        for row in _totals(vectors, books).collect():
            moved[row["part"], row["entry"]] = [s // row["count"] for s in row[3:]]
        books = Codebooks(books.length, moved)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): two hex digits a part, and the squared distances to the entries added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = books.slices()
        for batch in batches:
            x, n = books.cut(batch.column(2)), batch.num_rows
            code, error = np.zeros((n, len(slices)), np.uint8), np.zeros(n, np.int64)
            for p, s in enumerate(slices):
                code[:, p], distance = s.nearest(x[:, p])
                error += distance
            text = code.tobytes().hex()
            size = 2 * len(slices)
            codes = pa.array([text[i : i + size] for i in range(0, n * size, size)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error)], names=["id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return _of_length(vectors, books).select("id", "label", "values").mapInArrow(run, f"id bigint, label {kind}, code string, error bigint")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), a row for each vector that takes part.

    Vectors that are null or hold null or non-finite components take no part, nor do
    vectors of another length than that of the smallest id. A length that `parts` does
    not divide is filled up with zeros, which adds nothing to a distance. With fewer
    vectors than `entries` the codebooks are as small. A null key is coded like any
    other; its vector starts a codebook only if there are too few others. Repeated rows are
    coded each. Components beyond +-BOUND / SCALE count as that. label_error is the sum over all rows of equal
    label, null labels together. An empty table gives no rows. The result's columns
    are fixed; others of the input are not read.
    """
    with scratch(df.sparkSession) as keep:
        vectors = quantised(df, key, vector, label)
        books = fit(vectors, parts, entries, rounds)
        # Written before labels are summed: the codes are computed once.
        coded = written(encode(vectors, books), keep)
        sums = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), keep)
        found = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
        out = found.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
        return cut_lineage(out)


#: Two plain rounds of assignment and floor means, every entry measured.
SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
ranked AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
b0 AS (SELECT p, e, x AS c FROM parts JOIN ranked USING (vec_id))
{{rounds}},
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY p, e, j)) AS s
  FROM (SELECT p, e, unnest(c) AS z, unnest(range(len(c))) AS j FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, digest
"""


def _assign(n: int) -> str:
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f""",
a{n} AS (
  SELECT vec_id, label, p, x, m.e AS i, m.d AS d
  FROM (SELECT vec_id, any_value(label) AS label, t.p AS p, any_value(x) AS x, min(struct_pack(d := CAST({distance} AS BIGINT), e := e)) AS m
        FROM parts t JOIN b{n} b ON t.p = b.p GROUP BY vec_id, t.p) y)"""


def _move(n: int) -> str:
    return f""",
m{n} AS (
  SELECT p, i, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS c
  FROM (SELECT p, i, j, CAST(sum(z) AS DOUBLE) AS s, count(*) AS n
        FROM (SELECT p, i, unnest(x) AS z, unnest(range(len(x))) AS j FROM a{n - 1}) y GROUP BY ALL) w GROUP BY p, i),
b{n} AS (SELECT b.p AS p, b.e AS e, coalesce(m.c, b.c) AS c FROM b{n - 1} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.i)"""


SQL = SQL.replace("{rounds}", _assign(0) + "".join(_move(n) + _assign(n) for n in range(1, ROUNDS + 1)))
