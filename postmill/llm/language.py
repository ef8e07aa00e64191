"""Language identification of mixed-language text.

1. Script ranges: the scripts of a word's letters narrow the languages it can be
   in to those that were seen with one of these scripts in training.
2. Per-word scores: a naive Bayes score over the word's byte trigrams (its borders
   included), hashed to 2 ** BITS places.
3. Viterbi over a text's words: a change of language costs PENALTY, so a stray word
   does not break a span and a real change does. The spans are the result; a text's
   language is the one with the most letters in its spans.

The Viterbi runs over many texts at once, one word of each per step. The model has
2 ** BITS numbers per language and is fitted on at most SAMPLE texts per language,
the first by hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .columns import crc_of_id, key_hash, without

BITS = 16
SAMPLE = 2_000
PENALTY = 6.0
SMOOTHING = 0.5
#: Of a language's letters, the share that a script must have to count as one of its scripts.
SCRIPT_SHARE = 0.001

#: First code points of script ranges: others, Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, other abjads, Indic, Thai and neighbours,
#: Georgian, Hangul, other alphabets, Latin additions, Greek additions, symbols, kana, Han, others, Hangul, others. Beyond U+FFFF: other
#: alphabets, Indic, other alphabets, kana, other alphabets, symbols, Latin letters for mathematics, signs, Latin, other alphabets, Adlam,
#: other alphabets, numbers, Arabic letters for mathematics, pictures, Han, others.
_RANGES = ((0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xC0, 1), (0x250, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 7), (0x900, 8),
           (0xE00, 9), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13), (0x3100, 14), (0x3130, 11), (0x3190, 14), (0xA000, 12), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x10000, 12), (0x11000, 8),
           (0x12000, 12), (0x1AFF0, 13), (0x1B170, 12), (0x1BCA0, 0), (0x1D400, 1), (0x1D800, 0), (0x1DF00, 1), (0x1E000, 12), (0x1E900, 15), (0x1E960, 12), (0x1EC70, 0),
           (0x1EE00, 6), (0x1EF00, 0), (0x20000, 14), (0x40000, 0))
SCRIPTS = 16
_STARTS = np.array([s for s, _ in _RANGES])
_SCRIPT = np.array([k for _, k in _RANGES])


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of the character that starts at each byte; 0 for bytes within a character and for no letter."""
    n = len(data)
    d = data.astype(np.int32)
    pad = np.concatenate([d, np.zeros(3, np.int32)])
    point = d.copy()
    two, three, four = (d >= 0xC0) & (d < 0xE0), (d >= 0xE0) & (d < 0xF0), d >= 0xF0
    point[two] = ((d & 0x1F) << 6 | (pad[1 : n + 1] & 0x3F))[two]
    point[three] = ((d & 0x0F) << 12 | (pad[1 : n + 1] & 0x3F) << 6 | (pad[2 : n + 2] & 0x3F))[three]
    point[four] = ((d & 0x07) << 18 | (pad[1 : n + 1] & 0x3F) << 12 | (pad[2 : n + 2] & 0x3F) << 6 | (pad[3 : n + 3] & 0x3F))[four]
    point[(d >= 0x80) & (d < 0xC0)] = 0
    return _SCRIPT[np.searchsorted(_STARTS, point, side="right") - 1]


def trigrams(w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, place): for each byte of a word the hashed trigram around it."""
    size = w.end - w.start
    word = np.repeat(np.arange(len(size)), size)
    at = np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(word)) if len(size) else np.zeros(0, np.int64)
    here = w.data[at].astype(np.uint64)
    left = np.where(at == w.start[word], 0x20, w.data[np.maximum(at - 1, 0)]).astype(np.uint64)
    right = np.where(at + 1 == w.end[word], 0x20, w.data[np.minimum(at + 1, len(w.data) - 1)]).astype(np.uint64)
    return word, (bw.mix64(left << np.uint64(16) | here << np.uint64(8) | right) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # place x language
    allowed: np.ndarray  # script x language


def word_scores(model: Model, w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word x language scores, letters of each word). A word without a letter scores nothing for any language."""
    n, k = len(w.start), len(model.languages)
    if not n:
        return np.zeros((0, k)), np.zeros(0, np.int64)
    word, place = trigrams(w)
    first = np.concatenate([[0], np.cumsum(w.end - w.start)[:-1]])
    out = np.stack([np.add.reduceat(model.scores[place, j], first) for j in range(k)], axis=1).astype(np.float64)
    script = scripts_of(w.data)
    letters = np.concatenate([[0], np.cumsum(script > 0)])
    letters = letters[w.end] - letters[w.start]
    fits = np.zeros((n, k), bool)
    for s in np.unique(script):
        if s:
            has = np.concatenate([[0], np.cumsum(script == s)])
            fits |= (has[w.end] > has[w.start])[:, None] & model.allowed[s][None, :]
    some = fits.any(axis=1)
    out[some & (letters > 0)] = np.where(fits[some & (letters > 0)], out[some & (letters > 0)], -1e4)
    out[letters == 0] = 0.0
    return out, letters


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; texts are score[first[t]:first[t + 1]]. Ties stay, and go to the first language."""
    n, k = len(first) - 1, score.shape[1]
    label = np.zeros(len(score), np.int16)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    best = np.zeros((n, k))
    came = np.zeros(len(score), np.int16)  # the language to switch from
    switched = np.zeros((len(score), k), bool)
    alive = n
    for t in range(int(size[0]) if n else 0):
        while alive and size[alive - 1] <= t:
            alive -= 1
        at = start[:alive] + t
        now = best[:alive]
        if t:
            top = now.argmax(axis=1)
            other = now[np.arange(alive), top] - penalty
            change = other[:, None] > now
            came[at], switched[at] = top, change
            now[change] = np.broadcast_to(other[:, None], now.shape)[change]
        now += score[at]
    state = best.argmax(axis=1)
    alive = 0
    for t in range(int(size[0]) - 1 if n else -1, -1, -1):
        while alive < n and size[alive] > t:
            alive += 1
        at = start[:alive] + t
        s = state[:alive]
        label[at] = s
        state[:alive] = np.where(switched[at, s], came[at], s)
    return label


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, hold_out: bool = True) -> Model:
    """Fit on at most `sample` texts per language; with `hold_out`, none whose crc32(id) mod 5 is 0.

    Rows without text or language are left out. Counts are summed by Spark; the
    result has at most 2 ** BITS rows per language.
    """
    known = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    if hold_out:
        known = known.filter(crc_of_id(key) % 5 != 0)
    own = known.select(F.col(f"`{key}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # By count (one row per language, as the model has one column for each), a hash limit that about a fifth more
    # than the sample stays below; the sample is cut from these few.
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    below = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, float(1 << 60) * (1.2 * sample + 50) / n)]) if sizes else F.create_map().cast("map<string,double>")
    near = own.select("id", "lang").filter(key_hash(F.col("id")) < below[F.col("lang")])
    ids = near.select("id", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(key_hash(F.col("id")), "id"))).filter(F.col("n") <= sample).select("id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, w in bw.words(batch.column(1), bw.ALPHA, bw.lower_latin):
                word, place = trigrams(w)
                text_of = w.text_of()
                script = scripts_of(w.data)
                inside = np.searchsorted(w.text_start, np.arange(len(script)), side="right") - 1
                for g in sorted(set(langs[lo:hi])):
                    mine = langs[lo:hi] == g
                    c = np.bincount(place[mine[text_of[word]]], minlength=1 << BITS)
                    s = np.bincount(script[mine[inside]], minlength=SCRIPTS)
                    p, q = np.flatnonzero(c), np.flatnonzero(s)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * (len(p) + len(q)), pa.string()), pa.array(np.concatenate([p, -1 - q])), pa.array(np.concatenate([c[p], s[q]]))], names=["lang", "place", "n"])

    chosen = own.join(F.broadcast(ids), ["id", "lang"], "left_semi").select("lang", "text")
    counts = chosen.mapInArrow(run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    langs, place, n = (counts.column(c).to_numpy() for c in ("lang", "place", "n"))
    names = sorted(set(langs.tolist()))
    scores, allowed = np.zeros((1 << BITS, len(names)), np.float32), np.zeros((SCRIPTS, len(names)), bool)
    for j, g in enumerate(names):
        mine = langs == g
        c = np.zeros(1 << BITS)
        grams = mine & (place >= 0)
        c[place[grams]] = n[grams]
        scores[:, j] = np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * (1 << BITS)))
        s = np.zeros(SCRIPTS)
        s[-1 - place[mine & (place < 0)]] = n[mine & (place < 0)]
        s[0] = 0
        allowed[:, j] = s > SCRIPT_SHARE * s.sum()
    return Model(names, scores, allowed)


def _spans(w: bw.Words, label: np.ndarray, letters: np.ndarray, t: int, names: list[str]) -> list[dict]:
    lo, hi = int(w.first[t]), int(w.first[t + 1])
    told = np.flatnonzero(letters[lo:hi] > 0) + lo
    if not len(told):
        return []
    cut = np.flatnonzero(np.diff(label[told])) + 1
    base = int(w.text_start[t])
    return [{"from_byte": int(w.start[g[0]]) - base, "to_byte": int(w.end[g[-1]]) - base, "lang": names[label[g[0]]]} for g in np.split(told, cut)]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """The rows with held_out, lang_pred and score; with `spans`, also the spans (from_byte, to_byte, lang) of the text.

    score is the share of the text's letters in spans of lang_pred. A null text, one
    without any letter, and any text where nothing was learnt get `und` and 0. Ties of
    letters go to the first language by name. Every row is judged by its own text. An
    empty table stays empty; columns named like the result's own are replaced.
    """
    base = without(docs, "held_out", "lang_pred", "score", "spans")
    back = keep or base.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.languages)
        for batch in batches:
            texts = batch.column(len(back) + 1)
            said, sure, parts = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, hi, w in bw.words(texts, bw.ALPHA, bw.lower_latin) if k else ():
                score, letters = word_scores(m, w)
                label = viterbi(score, w.first, penalty)
                text_of = w.text_of()
                mass = np.bincount(text_of * k + label, letters, (hi - lo) * k).reshape(-1, k)
                top, total = mass.argmax(axis=1), mass.sum(axis=1)
                plain = np.concatenate([[0], np.cumsum(bw.byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)[w.data] & (w.data < 0x80))])
                ends = np.append(w.text_start[1:], len(w.data))
                for i in range(hi - lo):
                    if plain[ends[i]] == plain[w.text_start[i]] and not any(c.isalpha() for c in texts[lo + i].as_py() or ""):
                        continue
                    if total[i]:
                        said[lo + i], sure[lo + i] = m.languages[top[i]], mass[i, top[i]] / total[i]
                    else:
                        said[lo + i], sure[lo + i] = m.languages[0], 1.0 / k
                    if spans:
                        parts[lo + i] = _spans(w, label, letters, i, m.languages)
            new = [pa.array(said, pa.string()), pa.array(sure)] + ([pa.array(parts, span)] if spans else [])
            names = [*batch.schema.names[: len(back) + 1], "lang_pred", "score"] + ["spans"] * spans
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(back) + 1], *new], names=names)

    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in back)
    kinds += ", held_out boolean, lang_pred string, score double" + (", spans array<struct<from_byte:bigint,to_byte:bigint,lang:string>>" if spans else "")
    held = (crc_of_id(key) % 5 == 0).alias("held_out")
    return base.select(*[f"`{c}`" for c in back], held, F.col(f"`{text}`").alias("_text")).mapInArrow(run, kinds)
