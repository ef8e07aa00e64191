"""Benchmark decontamination by winnowing.

Of every run of `window` words, the least hash of its `gram`-word runs is kept.
Two texts that share a run of `window` words keep the same hash there, so a join
of kept hashes finds every such pair of document and benchmark item. Each pair is
then extended: the item's windows are looked for in the whole document and
compared byte by byte. Items shorter than a window are one run of their own
length; documents keep all runs of such lengths, where there are any.

The join is left to Spark: few benchmark hashes are broadcast behind Spark's own
size check, many are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .columns import without, written

WINDOW = 10
GRAM = 5


def kept_hashes(w: bw.Words, window: int, gram: int, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) pairs kept of each text, distinct within it."""
    h, last, text = w.hashes(), np.repeat(w.first[1:], w.counts), w.text_of()
    n = len(h)
    at = np.arange(n)
    texts, hashes = [], []
    if n >= window:
        grams = bw.range_hash(h, at[: n - gram + 1], at[: n - gram + 1] + gram)
        runs = n - window + 1
        least = grams[:runs].copy()
        for j in range(1, window - gram + 1):
            np.minimum(least, grams[j : j + runs], out=least)
        inside = at[:runs] + window <= last[:runs]
        t, v = text[:runs][inside], least[inside]
        if len(v):
            new = np.ones(len(v), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            texts.append(t[new])
            hashes.append(v[new])
    for m in short:
        inside = np.flatnonzero(at + m <= last)
        if len(inside):
            texts.append(text[inside])
            # The length is part of the key, so a short run is never taken for a gram.
            hashes.append(bw.mix64(bw.range_hash(h, inside, inside + m) + np.uint64(m)))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return bw.distinct_per_text(np.concatenate(texts), np.concatenate(hashes))


def _fingerprints(df: DataFrame, key: str, text: str, window: int, gram: int, short: tuple[int, ...], items: bool) -> DataFrame:
    """(key, hash) rows. Of an item shorter than a window, only its whole run is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, w in bw.words(batch.column(1), bw.ALNUM):
                if not items:
                    t, v = kept_hashes(w, window, gram, short)
                else:
                    t, v = kept_hashes(w, window, gram, ())
                    for m in range(1, window):
                        whole = np.flatnonzero(w.counts == m)
                        a, b = kept_hashes(w, window, gram, (m,))
                        own = np.isin(a, whole)
                        t, v = np.concatenate([t, a[own]]), np.concatenate([v, b[own]])
                if len(t):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(t + lo)), pa.array(v.view(np.int64))], names=["id", "hash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, hash bigint")


def _hit(batches: Iterator[pa.RecordBatch], window: int, at_text: int, at_hits: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = batch.column(at_hits)
        n = batch.num_rows
        n_words, n_hit, n_items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        shas = [hashlib.sha256(b"").hexdigest()] * n
        for lo, _, w in bw.words(batch.column(at_text), bw.ALNUM):
            n_words[lo : lo + len(w.counts)] = w.counts
            some = [i for i in range(len(w.counts)) if hits[lo + i].is_valid]
            if not some:
                continue
            hashes = w.hashes()
            for i in some:
                covered, found = _extend(w, hashes, i, hits[lo + i].as_py(), window)
                n_hit[lo + i], n_items[lo + i] = covered, len(found)
                shas[lo + i] = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        own = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(shas, pa.string()), pa.array(n_hit > 0)]
        names = [batch.schema.names[k] for k in keep] + ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + own, names=names)


def _extend(w: bw.Words, hashes: np.ndarray, i: int, items: list[dict], window: int) -> tuple[int, set[str]]:
    """Words of text i that lie in a window of one of the items, and the ids of the items found."""
    lo, hi = int(w.first[i]), int(w.first[i + 1])
    edges = np.zeros(hi - lo + 1, np.int64)
    found: set[str] = set()
    runs: dict[int, np.ndarray] = {}

    def text_at(x: bw.Words, a: int, m: int) -> list[bytes]:
        return [x.data[s:e].tobytes() for s, e in zip(x.start[a : a + m], x.end[a : a + m])]

    for item in items:
        data, offsets = bw.texts_of(pa.array([item["text"]], pa.large_string()))
        own = bw.split(data, offsets, bw.ALNUM)
        size = min(window, len(own.start))
        if not size or size > hi - lo:
            continue
        if size not in runs:
            at = np.arange(lo, hi - size + 1)
            runs[size] = bw.range_hash(hashes, at, at + size)
        at = np.arange(len(own.start) - size + 1)
        wanted = bw.range_hash(own.hashes(), at, at + size)
        order = np.argsort(wanted)
        near = np.searchsorted(wanted[order], runs[size])
        same = np.flatnonzero(wanted[order][np.minimum(near, len(wanted) - 1)] == runs[size])
        for p in same.tolist():
            q = int(order[near[p]])
            if text_at(w, lo + p, size) == text_at(own, q, size):
                edges[p] += 1
                edges[p + size] -= 1
                found.update(item["ids"])
    return int((np.cumsum(edges[:-1]) > 0).sum()), found


OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """The documents' rows with n_words, n_hit, n_items, items_sha256 and contaminated.

    A document word is hit if it lies in any occurrence of any item window. Null and
    empty texts have no words and hit nothing; items without words match nothing; a
    null item id counts as empty text, and rows repeating an item id are one item.
    Every row is judged by its own text, also where rows share an id or the id is
    null. Empty tables are fine. keep: input columns to return, all by default;
    input columns named like the result's own are replaced.
    """
    docs = without(docs, *OWN)
    back = keep or docs.columns
    # Items of one wording are one row, however often they come.
    wording = items.filter(F.col(f"`{item_text}`").isNotNull()).groupBy(F.col(f"`{item_text}`").alias("text")).agg(
        F.collect_set(F.coalesce(F.col(f"`{item_key}`").cast("string"), F.lit(""))).alias("ids"))
    wording = wording.withColumn("item", F.xxhash64("text", F.lit(1)))
    prints = _fingerprints(wording, "item", "text", window, gram, (), True).withColumnRenamed("id", "item")
    sizes = F.size(F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""))
    # At most window - 1 different lengths.
    short = tuple(sorted(r.n for r in wording.select(sizes.alias("n")).filter((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()))
    pairs = _fingerprints(docs, key, text, window, gram, short, False).join(prints, "hash").select("id", "item").distinct()
    hits = pairs.join(wording, "item").groupBy("id").agg(F.collect_list(F.struct("text", "ids")).alias("_hits"))
    hits = written(hits.withColumnRenamed("id", "_id"))
    joined = docs.join(hits, F.col(f"`{key}`").eqNullSafe(F.col("_id")), "left")
    names = list(dict.fromkeys([*back, text]))
    flat = joined.select(*[f"`{c}`" for c in names], "_hits")
    at_text, at_hits, places = names.index(text), len(names), [names.index(c) for c in back]

    def run(batches):
        return _hit(batches, window, at_text, at_hits, places)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in back)
    return flat.mapInArrow(run, f"{kinds}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
