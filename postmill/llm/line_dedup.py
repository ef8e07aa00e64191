"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

Documents are taken in batches, the largest ids first. A batch's lines become one
row for each hash: in how many of its documents the line is, and the largest of
them. That is merge-joined with every run there is. A hash that no run holds is new,
and its largest document is the line's holder, as later batches only have smaller
ids; of a known hash only the count is added. The result is a run of its own, a
table bucketed and sorted by hash. Whenever a level has FANOUT runs, they are merged
into one of the next level, so a new batch never meets more than a few runs.

Runs are bucketed alike, so the merges move the batch's rows only, not the runs'.
At the end the runs hold each line's count and holder; lines found in enough
documents are joined back to the documents that have them, and their texts are cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import cut_lineage, scratch

from . import bytewords as bw
from .columns import released, without, written

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 2

_LINE_FEED = 0x0A


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): line i is data[start[i]:end[i]]; text t has lines first[t]:first[t + 1], one at least."""
    feeds = np.flatnonzero(data == _LINE_FEED)
    ends = np.concatenate([feeds, offsets[1:]])
    starts = np.concatenate([feeds + 1, offsets[:-1]])
    # A text's last line ends where the text does; an empty text at the same place comes after it.
    first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    return np.sort(starts, kind="stable"), np.sort(ends, kind="stable"), first


def _keyed(data: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, from, to) of stripped lines with `least` code points or more."""
    solid = bw.NOT_SPACE[data]
    at = np.flatnonzero(solid)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    x, y = np.searchsorted(at, start), np.searchsorted(at, end)
    line = np.flatnonzero(y > x)
    lo, hi = at[x[line]], at[y[line] - 1] + 1
    enough = chars[hi] - chars[lo] >= least
    return line[enough], lo[enough], hi[enough]


def _hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    low = memoryview(bw.LOWER[data])
    return [xxhash.xxh3_128_digest(low[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]


def line_keys(df: DataFrame, key: str, text: str, least: int = LEAST_CHARS) -> DataFrame:
    """(doc, hash): the distinct long lines of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.texts_of(batch.column(1))
            for a, b in bw.pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                start, end, first = _lines(part, offsets[a : b + 1] - offsets[a])
                line, lo, hi = _keyed(part, start, end, least)
                owner = np.searchsorted(first, line, side="right") - 1
                pairs = list(dict.fromkeys(zip(owner.tolist(), _hashes(part, lo, hi))))
                rows = pa.array([a + t for t, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([h for _, h in pairs], pa.binary())], names=["doc", "hash"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc bigint, hash binary")


class Runs:
    """Levels of runs: tables of (hash, docs, holder), bucketed and sorted by hash, in a folder that the caller deletes."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = 3 * spark.sparkContext.defaultParallelism
        self.levels: list[list[str]] = []

    def __enter__(self) -> "Runs":
        return self

    def __exit__(self, *_) -> None:
        for name in (n for level in self.levels for n in level):
            self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """Rows (doc, hash) of documents none of which has a larger id than those added before."""
        own = batch.distinct().groupBy("hash").agg(F.count("*").alias("docs"), F.max("doc").alias("holder"))
        own = own.repartition(self.buckets, "hash").withColumn("new", F.lit(True))
        for run in self.tables():
            met = run.select("hash", F.lit(True).alias("met"))
            own = own.join(met.hint("merge"), "hash", "left").withColumn("new", F.col("new") & F.col("met").isNull()).drop("met")
        # A holder is told by `new`, as a document without an id may be one, too.
        self._push(own.select("hash", "docs", "holder", "new"), 0)

    def _push(self, rows: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) == self.fanout:
            names = self.levels[level]
            self.levels[level] = []
            self._push(self._merged([self.spark.table(n) for n in names]), level + 1)
            for n in names:
                self._drop(n)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs merged two by two: counts add up, and the one row of a hash that is new has its holder."""
        both = runs[0]
        for r in runs[1:]:
            other = r.select("hash", F.col("docs").alias("docs2"), F.col("holder").alias("holder2"), F.col("new").alias("new2"))
            first = F.coalesce("new", F.lit(False))
            both = both.join(other.hint("merge"), "hash", "full").select(
                "hash", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"),
                F.when(first, F.col("holder")).otherwise(F.col("holder2")).alias("holder"), (first | F.coalesce("new2", F.lit(False))).alias("new"))
        return both

    def shared(self, least: int = LEAST_DOCS) -> DataFrame:
        """(hash, holder) of lines found in `least` documents or more."""
        tables = self.tables()
        return self._merged(tables).filter(F.col("docs") >= least).select("hash", "holder")


def _batches(keys: DataFrame, batches: int) -> list[DataFrame]:
    """Batches of about as many rows, from the largest ids down; rows of one id stay together, null ids come last."""
    cuts = keys.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    doc = F.col("doc")
    if not cuts:
        return [keys]
    middle = [keys.filter((doc <= high) & (doc > low)) for high, low in zip(cuts, cuts[1:])]
    return [keys.filter(doc > cuts[0]), *middle, keys.filter((doc <= cuts[-1]) | doc.isNull())]


def _cut(rows: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Rows with `_gone`, the hashes (16 bytes each, one after the other) of lines that go from their text."""
    own = {"n_lines": "bigint", "n_dropped": "bigint"}
    rest = [c for c in rows.columns if c not in (text, "_gone")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(batch.schema.get_field_index("_gone")).to_pylist()
            data, offsets = bw.texts_of(batch.column(batch.schema.get_field_index(text)))
            n_lines, n_dropped, kept = [], [], []
            for a, b in bw.pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                start, end, first = _lines(part, offsets[a : b + 1] - offsets[a])
                n_lines += np.diff(first).tolist()
                whole = part.tobytes()
                line, lo, hi = _keyed(part, start, end, least)
                at = np.searchsorted(line, first)
                for t in range(a, b):
                    f, g = first[t - a], first[t - a + 1]
                    if not gone[t]:
                        n_dropped.append(0)
                        kept.append(whole[start[f] : end[g - 1]])
                        continue
                    hashes = {gone[t][i : i + 16] for i in range(0, len(gone[t]), 16)}
                    x, y = at[t - a], at[t - a + 1]
                    out = {n for n, h in zip(line[x:y].tolist(), _hashes(part[start[f] : end[g - 1]], lo[x:y] - start[f], hi[x:y] - start[f])) if h in hashes}
                    n_dropped.append(len(out))
                    kept.append(b"\n".join(whole[start[n] : end[n]] for n in range(f, g) if n not in out))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, text, *own])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], f"`{text}` string", *[f"{c} {k}" for c, k in own.items()]])
    return rows.mapInArrow(run, schema)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
           batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows with shared lines cut out of their texts, and n_lines (before) and n_dropped.

    A line's key is the line without spaces, tabs, feeds and returns at both ends, A-Z
    lower-cased. Keys of `least_chars` code points or more found in `least_docs`
    documents or more lose all their lines but those in the largest id that holds them.
    A document is its id: rows of equal ids count once and are judged alike, rows
    without an id are one document below all others. A null text is one empty line
    and comes back empty. Keys are told apart by 128-bit hashes. An empty table
    stays empty. Input columns named like the result's own are replaced; others stay.
    """
    df = without(df, "n_lines", "n_dropped", "_gone", "_doc")
    spark = df.sparkSession
    with scratch(spark) as keep:
        keys = written(line_keys(df, key, text, least_chars), keep)
        with Runs(spark, keep.keywords["folder"], fanout) as runs:
            for batch in _batches(keys, batches):
                runs.add(batch)
            shared = written(runs.shared(least_docs), keep)
        hits = keys.join(shared, "hash").filter(~F.col("doc").eqNullSafe(F.col("holder"))).select("doc", "hash").distinct()
        # Hashes of one document's own lines, joined end to end.
        gone = released(written(hits.groupBy(F.col("doc").alias("_doc")).agg(F.array_join(F.collect_list(F.hex("hash")), "").alias("_hex")), keep))
        rows = df.join(gone, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_doc")), "left").withColumn("_gone", F.unhex("_hex")).drop("_doc", "_hex")
        return cut_lineage(_cut(rows, key, text, least_chars).select(*[f"`{c}`" for c in df.columns], "n_lines", "n_dropped"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, len(string_split(t, chr(10))) AS n, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) x),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
judged AS (SELECT doc_id, n, line, pos, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
