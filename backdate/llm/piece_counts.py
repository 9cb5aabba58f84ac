"""Token counts by a Viterbi pass that carries only the best score and its number of pieces.

The vocabulary's scores are taken as if they were unigram log probabilities: a
word's pieces are the split with the highest sum. The file is a BPE file, whose
scores are merge ranks (-2, -3 ... -31740) and no probabilities. The sum then
favours several early merges over one late whole word, so the counts are those
of a unigram reading of the file, higher than those of its own tokenizer, which
applies merges. An Aho-Corasick automaton finds all pieces
that end at each character; the pass keeps, per character, the best sum and how
many pieces make it, never the pieces. Ties are settled as the public tokenizer
library does: of splits with equal sums the one whose last piece is longest.
A character that no piece covers costs ten below the lowest score and counts one
piece per UTF-8 byte.

A word is a run of characters other than space and 9 to 13, with the mark for a
word's beginning put before it; no piece reaches across words, so a worker
remembers the counts of words.

Defined results: a NULL or empty text has no pieces; rows are counted one by
one, whatever their ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from backdate.llm.fingerprints import utf8

TOKENIZER = "piece_bpe_32k.model"
MARK = "▁"
MARKED = re.compile(f"{MARK}[^{MARK}]*")
UNKNOWN_PENALTY = 10.0
MOST_WORDS = 400_000  # words whose counts a worker remembers


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[bytes, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one marked word."""
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends settled so far

        def unknowns(upto: int) -> None:
            nonlocal done
            while done < upto:
                best[done + 1] = best[done] + self.unknown
                pieces[done + 1] = pieces[done] + len(word[done].encode())
                done += 1

        # Matches come by ascending end, and at one end the longest first.
        at, single, top, made = 0, False, None, 0
        for end, (size, score) in self.find.iter(word):
            if end + 1 != at:
                if at:
                    self._settle(word, best, pieces, at, top, made, single)
                    done = at
                unknowns(end)
                at, top, made, single = end + 1, None, 0, False
            start = at - size
            total = best[start] + score
            if top is None or total > top:
                top, made = total, pieces[start] + 1
            single = single or size == 1
        if at:
            self._settle(word, best, pieces, at, top, made, single)
            done = at
        unknowns(n)
        return pieces[n]

    def _settle(self, word, best, pieces, end, top, made, single) -> None:
        if not single:
            # No piece is this character alone, so leaving it unknown is a choice too.
            total = best[end - 1] + self.unknown
            if total > top:
                top, made = total, pieces[end - 1] + len(word[end - 1].encode())
        best[end], pieces[end] = top, made

    def word(self, word: str) -> int:
        # A mark within a word begins another.
        return sum(map(self.count, MARKED.findall(word if word.startswith(MARK) else MARK + word)))

    def __call__(self, text: bytes) -> int:
        words, known = text.split(), self.known
        counts = [known.get(w) for w in words]
        if None in counts:
            for i, w in enumerate(words):
                if counts[i] is None:
                    counts[i] = known.get(w)
                    if counts[i] is None:
                        if len(known) >= MOST_WORDS:
                            known.clear()
                        counts[i] = known[w] = self.word(w.decode())
        return sum(counts)


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(vocabulary(path))


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_words, n_pieces`` of every row of ``docs (doc_id, text)``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            raw, places = utf8(batch.column("text"))
            texts = [raw[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()),
                 pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_words", "n_pieces"]
            )

    return docs.select("doc_id", "text").mapInArrow(counts, "doc_id long, n_words long, n_pieces long")
