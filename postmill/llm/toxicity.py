"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct words (runs of letters, lower-cased) and the
beginnings of longer words, hashed to 2 ** BITS places. The score is the logistic of a bias, a weight per feature and
the inner products of the features' vectors, so words that are harmful only
together are learnt as pairs.

The machine is fitted on a bounded sample of labelled rows (SAMPLE, the first by
hash of their id), by full-batch Adam on the places that tell the classes apart,
alone (`telling`) or as two words in one text (`together`), however little either
word tells by itself: at most FEATURES of each kind, counted by Spark; only these of
each row reach the driver. All words' pairs are counted, in blocks of columns of the
words' co-occurrence matrix. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .columns import crc_of_id, key_hash, without

BITS = 20
FACTORS = 8
#: At most 32767, as words are numbered in 16 bits.
FEATURES = 8192
SAMPLE = 20_000
THRESHOLD = 0.3
#: Standard units from chance from which a place counts, and (by likelihood ratio) from the likelier of its two words from which a pair does.
ALONE, PAIR = 2.5, 6.0
#: Texts, and toxic ones, that must hold a word or pair to be counted as a pair.
TOGETHER = 8
#: Blocks of the co-occurrence matrix, a task each.
GROUPS = 16
#: Texts that are multiplied at a time.
_CHUNK = 128
#: Lengths in bytes of the beginnings that count beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)


def word_places(w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all words, not yet distinct."""
    return w.text_of(), (bw.mix64(bw.range_hash(bw.BYTE_VALUE[w.data], w.start, w.end)) >> np.uint64(64 - BITS)).astype(np.int64)


def places(w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all words and of their beginnings, not yet distinct."""
    size, text = w.end - w.start, w.text_of()
    longer = [np.flatnonzero(size > k) for k in BEGINNINGS]
    start = np.concatenate([w.start, *[w.start[x] for x in longer]])
    end = np.concatenate([w.end, *[w.start[x] + k for x, k in zip(longer, BEGINNINGS)]])
    salt = np.repeat(np.arange(len(BEGINNINGS) + 1, dtype=np.uint64), [len(size), *map(len, longer)])
    h = bw.mix64(bw.range_hash(bw.BYTE_VALUE[w.data], start, end) ^ salt)
    return np.concatenate([text, *[text[x] for x in longer]]), (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    """index: place -> feature or -1."""

    index: np.ndarray
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def scores(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their distinct (text, feature) pairs."""
        z = np.full(n, self.bias)
        if len(text):
            z += np.bincount(text, self.weight[feature], n)
            for f in range(self.vectors.shape[1]):
                v = self.vectors[feature, f]
                z += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(index: np.ndarray, w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    text, place = places(w)
    found = index[place]
    known = np.flatnonzero(found >= 0)
    return bw.distinct_per_text(text[known], found[known])


def telling(both: np.ndarray, in1: np.ndarray, n: float, n1: float, features: int) -> np.ndarray:
    """The places, ascending, whose share of toxic texts (in1 of both) is furthest from chance; rare ones are left out."""
    expected = both * n1 / n
    contrast = np.where(both >= 3, np.abs(in1 - expected) / np.sqrt(expected * (1 - n1 / n) + 0.5), 0)
    first = np.lexsort((np.arange(len(both)), -contrast))[:features]
    return np.sort(first[contrast[first] > ALONE])


def pairable(both: np.ndarray, in1: np.ndarray, features: int) -> np.ndarray:
    """The places, ascending, in texts enough to stand in a pair; of more than `features` those in most toxic texts."""
    found = np.flatnonzero((both >= TOGETHER) & (in1 >= TOGETHER))
    return np.sort(found[np.lexsort((found, -in1[found]))[:features]])


def surprise(n: np.ndarray, n1: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Root of the likelihood ratio statistic of n1 of n where `chance` of n is expected; 0 where there are no more than that."""
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = np.where(n1 > 0, n1 * np.log(n1 / (n * chance)), 0)
        rest = np.where(n > n1, (n - n1) * np.log((n - n1) / (n * (1 - chance))), 0)
    return np.where(n1 > n * chance, np.sqrt(2 * np.maximum(0, np.nan_to_num(hits + rest, posinf=0))), 0)


def together(first: np.ndarray, word: np.ndarray, label: np.ndarray, low: int, high: int, both: np.ndarray, in1: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(word, contrast): words numbered from 0 that tell as a pair with one of [low, high) that comes before it, and that one.

    Text t has the words word[first[t]:first[t + 1]]. A pair's toxic texts are compared
    with what the likelier of its two words, or chance (`share`), lets expect; the
    contrast counts where above PAIR.
    """
    size, wide = high - low, len(both)
    n, n1 = np.zeros((size, wide), np.float32), np.zeros((size, wide), np.float32)
    for t in range(0, len(label), _CHUNK):
        ends = first[t : t + _CHUNK + 1]
        x = np.zeros((len(ends) - 1, wide), np.float32)
        x[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), word[ends[0] : ends[-1]]] = 1
        toxic = label[t : t + _CHUNK] > 0
        n += x[:, low:high].T @ x
        n1 += x[toxic, low:high].T @ x[toxic]
    rate = np.maximum(in1 / np.maximum(both, 1), share)
    found, contrasts = [], []
    for k in range(size):
        chance = np.maximum(rate[low + k], rate)
        contrast = surprise(n[k].astype(float), n1[k].astype(float), chance)
        hit = np.flatnonzero((n[k] >= TOGETHER) & (contrast > PAIR) & (np.arange(wide) > low + k))
        if len(hit):
            found += [hit, [low + k]]
            contrasts += [contrast[hit], [contrast[hit].max()]]
    return (np.concatenate(found), np.concatenate(contrasts)) if found else (np.zeros(0, np.int64), np.zeros(0))


def partners(word: np.ndarray, contrast: np.ndarray, features: int) -> np.ndarray:
    """The distinct words, ascending; of more than `features` those of the highest contrasts."""
    best: dict[int, float] = {}
    for w, c in zip(word.tolist(), contrast.tolist()):
        best[w] = max(c, best.get(w, 0.0))
    return np.array(sorted(sorted(best, key=lambda w: (-best[w], w))[:features]), np.int64)


def _numbers(places: np.ndarray) -> np.ndarray:
    index = np.full(1 << BITS, -1, np.int32)
    index[places] = np.arange(len(places))
    return index


def fit(text: np.ndarray, place: np.ndarray, label: np.ndarray, factors: int = FACTORS, features: int = FEATURES, chosen: np.ndarray | None = None,
        steps: int = 120, rate: float = 0.05, weight_decay: float = 5e-5, vector_decay: float = 2e-4, seed: int = 1) -> Machine:
    """From distinct (text, place) pairs, ascending by text, and the texts' labels (0 or 1).

    Only `chosen` places count: by default the telling ones and those of telling pairs. A pair
    in a share s of the texts gets a weight only if s times what is left of its texts'
    error (up to 1) is above `vector_decay`.
    """
    n, n1 = len(label), float(label.sum())
    index = np.full(1 << BITS, -1, np.int32)
    if not n or n1 in (0.0, float(n)):
        return Machine(index, -30.0 if not n1 else 30.0, np.zeros(1), np.zeros((1, factors)))
    if chosen is None:
        both, in1 = np.bincount(place, minlength=1 << BITS), np.bincount(place, label[text], 1 << BITS)
        chosen = telling(both, in1, n, n1, features)
        able = pairable(both, in1, features)
        number = _numbers(able)[place]
        starts = np.searchsorted(text[number >= 0], np.arange(n + 1))
        chosen = np.union1d(chosen, able[partners(*together(starts, number[number >= 0], label, 0, len(able), both[able], in1[able], n1 / n), features)])
    index[chosen] = np.arange(len(chosen))
    feature = index[place]
    text, feature = text[feature >= 0], feature[feature >= 0]
    m = max(1, len(chosen))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.01, (m, factors)), float(np.log(n1 / (n - n1)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, np.zeros(1))]
    for step in range(1, steps + 1):
        sums = np.stack([np.bincount(text, v[feature, f], n) for f in range(factors)], axis=1) if len(text) else np.zeros((n, factors))
        squares = np.bincount(text, (v * v).sum(axis=1)[feature], n) if len(text) else np.zeros(n)
        z = b + np.bincount(text, w[feature], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        gw = np.bincount(feature, g[text], m) + weight_decay * w
        own = np.bincount(feature, g[text], m)
        gv = np.stack([np.bincount(feature, g[text] * sums[text, f], m) for f in range(factors)], axis=1) - own[:, None] * v + vector_decay * v
        for x, gx, s in ((w, gw, state[0]), (v, gv, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * gx
            s[1] = 0.999 * s[1] + 0.001 * gx * gx
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        b -= 0.5 * float(g.sum())
    return Machine(index, b, w, v)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, hold_out: bool = True) -> Machine:
    """Fit on at most `sample` labelled rows; with `hold_out`, none whose crc32(id) mod 4 is 2.

    Rows without id, text or label are left out of the fit; an id labelled twice is
    toxic if one of its labels is. Without examples of both classes every score is
    the bias.
    """
    known = labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    if hold_out:
        known = known.filter(crc_of_id(key) % 4 != 2)
    known = known.groupBy(F.col(f"`{key}`").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("label"))
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    # Ids only are ordered; the texts of the sample come by a join with at most `sample` ids.
    first = known.join(own.select("id").distinct(), "id", "left_semi").orderBy(key_hash(F.col("id")), "id").limit(sample)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each place: texts that have it, toxic ones among them, and whether it is a whole word's."""
        for batch in batches:
            label_of = batch.column(1).to_numpy()
            for lo, hi, w in bw.words(batch.column(2), bw.ALPHA, bw.lower_latin):
                t, p = bw.distinct_per_text(*places(w))
                found, code = np.unique(p, return_inverse=True)
                whole = np.isin(found, word_places(w)[1])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(code)), pa.array(np.bincount(code, label_of[lo:hi][t]).astype(np.int64)), pa.array(whole)], names=["place", "n", "n1", "word"])

    chosen_rows = own.join(F.broadcast(first), "id").select("id", "label", "text")
    counted = chosen_rows.mapInArrow(counts, "place bigint, n bigint, n1 bigint, word boolean").groupBy("place")
    stats = counted.agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.max("word").alias("word")).filter("n >= 3").toArrow()
    # Rows, as the counts are of rows: an id may come more than once.
    totals = chosen_rows.select("label").agg(F.count("*"), F.sum("label")).first()
    both, in1, is_word = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    at = stats.column("place").to_numpy()
    both[at], in1[at], is_word[at] = stats.column("n").to_numpy(), stats.column("n1").to_numpy(), stats.column("word").to_numpy(zero_copy_only=False).astype(bool)
    chosen = telling(both, in1, totals[0], totals[1], FEATURES) if totals[0] else np.zeros(0, np.int64)
    able = pairable(np.where(is_word, both, 0), in1, FEATURES)
    if len(able) > 1:
        dealt = chosen_rows.mapInArrow(_dealer(_numbers(able)), "part int, label int, words array<smallint>")
        far = dealt.groupBy("part").applyInArrow(_judge(both[able], in1[able], totals[1] / totals[0]), "word bigint, contrast double").toArrow()
        chosen = np.union1d(chosen, able[partners(far.column("word").to_numpy(), far.column("contrast").to_numpy(), FEATURES)])
    index = _numbers(chosen)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in bw.words(batch.column(2), bw.ALPHA, bw.lower_latin):
                t, f = _features(index, w)
                ends = np.searchsorted(t, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(f.astype(np.int32)))], names=["id", "label", "features"])

    kind = docs.schema[key].dataType.simpleString()
    got = chosen_rows.mapInArrow(gather, f"id {kind}, label int, features array<int>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    lists, label_of = got.column("features").combine_chunks(), got.column("label").to_numpy().astype(float)
    if not len(label_of):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), label_of)
    return fit(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), chosen[lists.flatten().to_numpy()], label_of, chosen=chosen)


def _dealer(number: np.ndarray):
    """(id, label, text) rows -> each text's words by number, once for each block of the matrix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in bw.words(batch.column(2), bw.ALPHA, bw.lower_latin):
                t, p = word_places(w)
                known = number[p] >= 0
                t, f = bw.distinct_per_text(t[known], number[p[known]].astype(np.int16))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(t, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(f))
                for part in range(GROUPS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), batch.column(1).slice(lo, hi - lo), lists], names=["part", "label", "words"])

    return deal


def _judge(both: np.ndarray, in1: np.ndarray, share: float):
    """One block's rows of `_dealer` -> its words in telling pairs."""

    def judge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        cuts = np.linspace(0, len(both), GROUPS + 1).astype(int)
        lists = table.column("words").combine_chunks()
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        word, contrast = together(first, lists.flatten().to_numpy(), table.column("label").to_numpy(), cuts[part], cuts[part + 1], both, in1, share)
        return pa.table({"word": pa.array(word, pa.int64()), "contrast": pa.array(contrast, pa.float64())})

    return judge


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The rows with held_out, score (0 to 1) and predicted (1 from the threshold on).

    Null and empty texts get the bias' score. Every row is scored by its own text;
    repeated rows alike. An empty table stays empty; columns named like the result's
    own are replaced. The machine's size is set by BITS, FEATURES and FACTORS.
    """
    base = without(docs, "held_out", "score", "predicted")
    back = keep or base.columns
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for lo, hi, w in bw.words(batch.column(len(back) + 1), bw.ALPHA, bw.lower_latin):
                p[lo:hi] = m.scores(*_features(m.index, w), hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(back) + 1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names[: len(back) + 1], "score", "predicted"])

    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in back)
    held = (crc_of_id(key) % 4 == 2).alias("held_out")
    return base.select(*[f"`{c}`" for c in back], held, F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")
