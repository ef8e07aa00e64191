"""Token counts of a unigram vocabulary: Viterbi that carries scores and counts only.

An Aho-Corasick automaton lists every piece that ends at a place, longest first.
For each place the best score of a segmentation up to it and its number of pieces
are kept; no pieces are stored. The rules are those of unigram tokenizers: a piece
replaces an equally good one only if strictly better, and longer pieces are tried
first; a character that is no piece by itself scores 10 below the lowest piece.
Such characters count as one token for a run of them, or, with byte fallback, as
one for each of their UTF-8 bytes.

No piece of the vocabulary crosses the places where a text is cut (before a run of
spaces, around control characters; this is checked when a vocabulary is read), so
words are counted one at a time and counts of short words are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import without

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by one Python worker; when they are this many, they are forgotten.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 48


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score of a SentencePiece file, ordinary pieces only. It is read on the driver and sent to the tasks."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


class Counter(dict):
    """Remembers words' counts."""

    def __init__(self, vocabulary: dict[str, float], byte_fallback: bool):
        import ahocorasick

        super().__init__()
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary):
            raise ValueError("a piece has a space after a letter, so texts can't be cut at spaces")
        controls = [c for c in "\t\n\r\x0b\x0c" if not any(c in p for p in vocabulary)]
        own = "".join(map(re.escape, controls))
        self.cut = re.compile(f" *[^ {own}]+| +" + (f"|[{own}]" if own else "")).findall
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def word(self, word: str) -> int:
        word = word.replace(" ", SPACE)
        n = len(word)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, alone, found = 0, False, False

        def close(end: int) -> None:
            """The last candidate for a place is its character alone, unknown if it is no piece."""
            if alone:
                return
            score = best[end - 1] + self.unknown
            if not found or score > best[end]:
                best[end] = score
                more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_run[end - 1])
                count[end], open_run[end] = count[end - 1] + more, True

        for last, (size, score) in self.automaton.iter(word) if len(self.automaton) else ():
            end = last + 1
            if end != done:
                if done:
                    close(done)
                while done + 1 < end:
                    done, alone, found = done + 1, False, False
                    close(done)
                done, alone, found = end, False, False
            score += best[end - size]
            if not found or score > best[end]:
                best[end], count[end], open_run[end] = score, count[end - size] + 1, False
            found, alone = True, alone or size == 1
        if done:
            close(done)
        while done < n:
            done, alone, found = done + 1, False, False
            close(done)
        return count[n]

    def __missing__(self, word: str) -> int:
        n = self.word(word)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, self.cut(" " + text)))


_counters: dict[tuple, Counter] = {}


def count(df: DataFrame, text: str = "text", vocabulary: dict[str, float] | None = None, byte_fallback: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The rows with n_tokens (long). Null and empty texts have none; every row counts by itself, repeated or not.

    A text starts with one added space, as the vocabulary's pieces expect. An empty
    table stays empty; a column named n_tokens is replaced. The vocabulary is a
    parameter of bounded size (here 32,000 pieces) and is broadcast.
    """
    base = without(df, "n_tokens")
    back = keep or base.columns
    pieces = read_vocabulary() if vocabulary is None else vocabulary
    sent = df.sparkSession.sparkContext.broadcast(pieces)
    name = (sent._jbroadcast.id() if hasattr(sent, "_jbroadcast") else id(sent), byte_fallback)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(sent.value, byte_fallback)
        counter = _counters[name]
        for batch in batches:
            n = pa.array((counter.text(t.as_py()) for t in batch.column(len(back))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(back)], n], names=[*batch.schema.names[: len(back)], "n_tokens"])

    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in back)
    return base.select(*[f"`{c}`" for c in back], F.col(f"`{text}`").alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
