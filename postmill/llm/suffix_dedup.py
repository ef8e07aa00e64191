"""Removal of repeated byte strings, found with suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed.
A suffix array of the whole corpus would be one task's work, so strings are dealt
out first, by content:

1. Each LENGTH-byte string is assigned to its anchor, the least hash of its GRAM-byte
   substrings (the first, if the least comes twice). Equal strings have equal
   anchors. Neighbouring strings with one anchor form a segment.
2. Segments whose anchor comes once in the corpus hold no repeated string and go.
3. Equal segments form a class. Of a class all but the first place are repeated
   as a whole. If an anchor has one class, that is all there is to it: its strings
   differ from one another.
4. Anchors with several classes meet in tasks, whole anchors together. Around the
   anchor each class is trimmed to what it shares with any other at most, which
   leaves nothing of chance meetings. What remains, many anchors to one string, is
   suffix-sorted; that brings equal strings of different classes together, and all
   but the first place of each are marked.
5. An anchor with more than MOST classes is too much for a task. Its strings are
   dealt out within it by anchors of twice the size, and go through 3 and 4 again;
   an anchor as long as the string has one class.

Joins on anchors and classes deal a key that holds much of all rows out in slices.

The suffix array is built by grouping: suffixes are grouped by their longest Lyndon
prefix; groups are gone through in descending order, and each hands its prefix
to the suffixes that its members' previous-smaller pointers name. Then one pass
in ascending order puts each suffix behind its group's earlier members. No text
is renamed and no recursion is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut_lineage, scratch

from . import bytewords as bw
from .columns import released

LENGTH = 100
GRAM = 16
#: Classes of an anchor that meet in one task.
MOST = 100_000
#: A key with more than this part of a join's rows is dealt out.
SHARE = 1024
#: Bytes sorted at a time; an anchor's classes stay together.
JOINT = 1 << 16


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order."""
    n = len(text)
    if not n:
        return []
    # Suffixes in groups: `order` holds them group by group, `group` tells where a suffix's group begins.
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    begin, at = {}, 0
    for c in sorted(counts):
        begin[c] = at
        at += counts[c]
    group = [begin[c] for c in text]
    fill = dict(begin)
    order, place = [0] * n, [0] * n
    for i, c in enumerate(text):
        p = fill[c]
        order[p], place[i] = i, p
        fill[c] = p + 1
    stop = {begin[c]: fill[c] for c in counts}  # where a group ends
    smaller = list(range(-1, n - 1))
    length = [1] * n

    high = n
    while high:
        low = group[order[high - 1]]
        members = order[low:high]
        high = low
        size = length[members[0]]
        called: dict[int, int] = {}
        for i in members:
            p = smaller[i]
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                called[p] = called.get(p, 0) + 1
        if not called:
            continue
        by_count: dict[int, list[int]] = {}
        for p, k in called.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[k]:
                length[p] += k * size
                g = group[p]
                if g not in moved:
                    moved[g] = stop[g]
                last = stop[g] - 1
                q, here = order[last], place[p]
                order[here], place[q] = q, here
                order[last], place[p] = p, last
                stop[g] = last
            for g, end in moved.items():
                first = stop[g]
                if first == g:
                    stop[g] = end  # the whole group moved: it keeps its place
                    continue
                stop[first] = end
                for x in order[first:end]:
                    group[x] = first

    # Suffix s is its Lyndon prefix and then the smaller suffix behind it; that one's turn comes earlier.
    behind: list[list[int]] = [[] for _ in range(n + 1)]
    for s in range(n):
        behind[s + length[s]].append(s)
    free: dict[int, int] = {}
    out = [-1] * n
    for t in [n]:
        for s in behind[t]:
            g = group[s]
            p = free.get(g, g)
            out[p] = s
            free[g] = p + 1
    for p in range(n):
        for s in behind[out[p]]:
            g = group[s]
            q = free.get(g, g)
            out[q] = s
            free[g] = q + 1
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, at, n, hash): segments of n strings from `start` on (within the text), their anchor's place in them and its hash."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none, none.view(np.uint64)
    n = len(data) - length + 1
    if n <= 0:
        return nothing
    at = np.arange(len(data) - gram + 1)
    h = bw.range_hash(bw.BYTE_VALUE[data], at, at + gram)
    bits = np.uint64(max(20, len(data).bit_length()))
    least = (h >> bits << bits) | at.astype(np.uint64)  # ties go to the first place
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # Strings that lie within one text.
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[1:-1], 1)
    text_of = np.cumsum(edge)[:-1]
    inside = np.flatnonzero(text_of[:n] == text_of[length - 1 : length - 1 + n])
    if not len(inside):
        return nothing
    anchor = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(inside), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    text = text_of[inside[first]].astype(np.int64)
    return text, inside[first] - offsets[text], anchor[first] - inside[first], np.diff(np.append(first, len(inside))), h[anchor[first]]


def _segments(df: DataFrame, length: int, gram: int, places: bool) -> DataFrame:
    """(id, text) -> hash of each segment's anchor; with `places` (hash, seg, id, place).

    seg is the segment's own hash; place holds start, at and n, the latter two below
    length + 1, and so is in the order of starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.texts_of(batch.column(1))
            for lo, hi in bw.pieces(offsets):
                part = data[offsets[lo] : offsets[hi]]
                begin = offsets[lo : hi + 1] - offsets[lo]
                text, start, at, n, h = anchors(part, begin, length, gram)
                if not len(text):
                    continue
                cols, names = [pa.array(h.view(np.int64))], ["hash"]
                if places:
                    s = begin[text] + start
                    seg = bw.range_hash(bw.BYTE_VALUE[part], s, s + n + length - 1).view(np.int64)
                    cols += [pa.array(seg), batch.column(0).take(pa.array(text + lo)), pa.array((start * (length + 1) + at) * (length + 1) + n)]
                    names += ["seg", "id", "place"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, "hash bigint, seg bigint, id bigint, place bigint" if places else "hash bigint")


def _cut_out(df: DataFrame, length: int) -> DataFrame:
    """(id, text, cuts) -> (hash, id, start, at, bytes, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.texts_of(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                text, id_, cuts = data[offsets[i] : offsets[i + 1]].tobytes(), batch.column(0)[i].as_py(), batch.column(2)[i].values
                for h, place, c in zip(*(cuts.field(x).to_pylist() for x in ("hash", "place", "c"))):
                    place, n = divmod(place, length + 1)
                    start, at = divmod(place, length + 1)
                    part = text[start : start + n + length - 1]
                    # Rows that share an id are pooled; a cut that another of them asked for may not fit here.
                    if len(part) == n + length - 1:
                        rows.append((h, id_, start, at, part, c))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["hash", "id", "start", "at", "bytes", "c"])

    return df.mapInArrow(run, "hash bigint, id bigint, start bigint, at bigint, bytes binary, c bigint")


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def _most_shared(sides: list[bytes]) -> list[int]:
    """For each, the longest beginning that another has too."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for x, y in zip(order, order[1:]):
        n = _agree(sides[x], sides[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def trimmed(parts: list[tuple[int, int, int, bytes]], length: int) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """Of one anchor's (id, start, at, bytes): distinct (id, start, bytes) that may hold shared strings, and (id, start, n) of what equals an earlier one."""
    right = _most_shared([b[at:] for _, _, at, b in parts])
    left = _most_shared([b[:at][::-1] for _, _, at, b in parts])
    first: dict[bytes, tuple[int, int]] = {}
    copies = []
    for (i, s, at, b), r, l in sorted(zip(parts, right, left), key=lambda x: (x[0][0], x[0][1] + x[0][2] - x[2])):
        if r + l >= length:
            b, s = b[at - l : at + r], s + at - l
            if b in first:
                if first[b] != (i, s):
                    copies.append((i, s, len(b) - length + 1))
            else:
                first[b] = (i, s)
    return [(i, s, b) for b, (i, s) in first.items()], copies


def repeated_in(parts: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(id, start, n) runs of strings of the parts (id, start, bytes) that are also in another part at an earlier place."""
    joined, owner, begin = [], [], []
    for k, (_, _, b) in enumerate(parts):
        begin.append(len(joined))
        joined.extend(x + 1 for x in b)
        joined.append(0)
    text = np.array(joined, np.int16)
    lengths = np.array([len(b) for _, _, b in parts])
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    inner = np.arange(len(text)) - np.array(begin)[owner]
    order = np.array(suffix_array(joined))
    order = order[inner[order] + length <= lengths[owner[order]]]
    if len(order) < 2:
        return []
    window = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.concatenate([(window[order[x + 1 : x + 4097]] == window[order[x : x + 4096][: len(order) - 1 - x]]).all(axis=1) for x in range(0, len(order) - 1, 4096)])
    run = np.concatenate([[0], np.cumsum(~same)])
    ids, starts = np.array([p[0] for p in parts])[owner[order]], np.array([p[1] for p in parts])[owner[order]] + inner[order]
    ranked = np.lexsort((starts, ids, run))
    # Equal places are one string seen in two parts; only later places count.
    first = np.ones(len(ranked), bool)
    first[1:] = run[ranked][1:] != run[ranked][:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    i, s = ids[ranked], starts[ranked]
    later = (i != i[lead]) | (s != s[lead])
    marked = sorted(set(zip(i[later].tolist(), s[later].tolist())))
    out: list[list[int]] = []
    for a, b in marked:
        if out and out[-1][0] == a and out[-1][1] + out[-1][2] == b:
            out[-1][2] += 1
        else:
            out.append([a, b, 1])
    return [tuple(x) for x in out]


def _sorted_classes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash; what is left of whole hashes is put together to strings of about JOINT bytes."""
    held: list[tuple[int, int, bytes]] = []
    own: list[tuple[int, int, int, bytes]] = []
    done: list[tuple[int, int, int]] = []
    last = None

    def close() -> None:
        rest, copies = trimmed(own, length)
        own.clear()
        done.extend(copies)
        if len(rest) > 1:  # the strings of one segment differ from one another
            held.extend(rest)

    def emit() -> Iterator[pa.RecordBatch]:
        rows = done + (repeated_in(held, length) if held else [])
        held.clear()
        done.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["id", "start", "n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if row[0] != last:
                close()
                if sum(len(b) for _, _, b in held) > JOINT or len(done) > 10_000:
                    yield from emit()
                last = row[0]
            own.append(row[1:])
    close()
    yield from emit()


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, runs): per key the runs (start, n) of strings that also start at an earlier place.

    The result is a written table; the tables of the steps before it are deleted.
    """
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    with scratch(docs.sparkSession) as keep:
        runs = cut_lineage(_repeats(own, length, gram, keep).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    return released(runs)


def _split_join(left: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of (.., id, place) with `counted`, whose c is the number of left's rows of each key.

    A key that holds more than a SHARE-th of the rows (so there are fewer than SHARE
    of them, and they may be broadcast) is dealt out in slices of about that size.
    """
    rows = counted.agg(F.sum("c")).first()[0] or 0
    of = F.ceil(F.col("c") * SHARE / F.lit(max(rows, 1))).cast("int")
    hot = counted.select(*keys, of.alias("_of")).filter("_of > 1")
    slice_ = F.when(F.col("_of").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "place"), F.col("_of")).cast("int"))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_slice", slice_).drop("_of")
    right = counted.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.greatest(of, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_slice"]).drop("_slice")


def _classes(met: DataFrame, length: int, keep) -> tuple[DataFrame, DataFrame]:
    """Of segments (hash, seg, id, place, ..): (id, start, n) of those that equal an earlier one, and
    (hash, id, place, .., c) of each class's first place where an anchor has several classes, c of them."""
    base = length + 1
    here = F.struct("id", "place", *[c for c in met.columns if c == "bytes"])
    classes = keep(met.groupBy("hash", "seg").agg(F.min(here).alias("first"), F.count("*").alias("c")))
    released(classes)
    copies = _split_join(met, classes.filter("c > 1"), ["hash", "seg"])
    copies = copies.filter((F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")))
    copies = keep(copies.select("id", F.floor(F.col("place") / (base * base)).alias("start"), (F.col("place") % base).alias("n")))
    released(copies)
    several = keep(classes.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1"))
    return copies, _split_join(classes.select("hash", "first.*"), several, ["hash"])


def _dealt_again(cut: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, id, start, bytes) -> segments by wider anchors, within the anchor they had: (hash, seg, id, place, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.texts_of(batch.column(3).cast(pa.large_binary()))
            for lo, hi in bw.pieces(offsets):
                part = data[offsets[lo] : offsets[hi]]
                begin = offsets[lo : hi + 1] - offsets[lo]
                text, start, at, n, h = anchors(part, begin, length, gram)
                if not len(text):
                    continue
                before, ids, starts = (batch.column(c).to_numpy()[lo:hi][text] for c in range(3))
                s = begin[text] + start
                e = s + n + length - 1
                seg = bw.range_hash(bw.BYTE_VALUE[part], s, e).view(np.int64)
                # A key says only who meets whom; strings that met by chance are told apart by their bytes.
                key = bw.mix64(before.view(np.uint64) + h).view(np.int64)
                place = ((starts + start) * (length + 1) + at) * (length + 1) + n
                own = [part[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, seg, ids, place)), pa.array(own, pa.binary())], names=["hash", "seg", "id", "place", "bytes"])

    return cut.select("hash", "id", "start", "bytes").mapInArrow(run, "hash bigint, seg bigint, id bigint, place bigint, bytes binary")


def _repeats(own: DataFrame, length: int, gram: int, keep) -> DataFrame:
    """(id, start, n): the strings that start at start, .., start + n - 1 also start at an earlier place."""
    base = length + 1

    # Segments whose anchor comes more than once, and their classes.
    often = keep(_segments(own, length, gram, False).groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1"))
    released(often)
    met = keep(_split_join(_segments(own, length, gram, True), often, ["hash"]).drop("c"))
    released(met)
    found, firsts = _classes(met, length, keep)

    # Strings that classes of one anchor share.
    cuts = firsts.groupBy("id").agg(F.collect_list(F.struct("hash", "place", "c")).alias("cuts"))
    cut = keep(_cut_out(own.join(cuts, "id"), length))
    released(cut)
    while True:
        few = cut if gram >= length else cut.filter(F.col("c") <= MOST)
        few = few.select("hash", "id", "start", "at", "bytes")
        found = found.union(few.repartition("hash").sortWithinPartitions("hash").mapInArrow(lambda b: _sorted_classes(b, length), "id bigint, start bigint, n bigint"))
        many = cut.filter(F.col("c") > MOST)
        if gram >= length or many.isEmpty():
            return found
        gram = min(2 * gram, length)
        copies, firsts = _classes(keep(_dealt_again(many, length, gram)), length, keep)
        found = found.union(copies)
        at = F.floor(F.col("place") / base)
        cut = keep(firsts.select("hash", "id", F.floor(at / base).alias("start"), (at % base).alias("at"), "bytes", "c"))


def _keep(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bw.texts_of(batch.column(1))
        rows = []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            n = len(own)
            runs = batch.column(2)[i]
            if not runs.is_valid:
                rows.append((n, 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                continue
            runs = runs.values
            start, count = runs.field("start").to_numpy(), runs.field("n").to_numpy()
            fits = start < n
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start[fits], 1)
            np.add.at(edge, np.minimum(start + count + length - 1, n)[fits], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            rows.append((n, int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: (key, n_bytes, n_removed, n_spans, kept_sha256).

    Earlier means a smaller key, or the same key and an earlier start. A null text is
    empty. A row without a key repeats nothing and is kept whole. Rows that repeat a
    key are read as one document: what is repeated in one of them is removed, as far
    as it reaches, from all. Texts shorter than `length` bytes are kept. An empty table
    stays empty. Keys are whole numbers.
    """
    runs = repeats(docs, key, text, length, gram)
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = own.join(runs.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "text", "runs")
    return joined.mapInArrow(lambda b: _keep(b, length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", key)


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(h, 2 * p + 1, 2 * p + 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 99))) AS p FROM d)),
dup AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
cut AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM dup),
isle AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cut),
span AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM isle GROUP BY ALL),
piece AS (
  SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS x, a AS y FROM span s
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), len(any_value(h)) // 2 FROM d LEFT JOIN span s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
