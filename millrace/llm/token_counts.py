"""Token counts of unigram tokenizers without building the tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

#: A public vocabulary; any SentencePiece file will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an unknown character scores below the least piece.
PENALTY = 10.0
#: Words whose counts a worker remembers, and their greatest length: longer ones, which may be whole texts without a
#: blank, are counted each time.
REMEMBERED, LONGEST = 1 << 19, 48


class Vocabulary(NamedTuple):
    """Pieces with their scores. Characters that no piece covers cost a piece for each of their bytes."""

    pieces: list[tuple[str, float]]

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.pieces) - PENALTY


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The pieces of a SentencePiece file and, as such tokenizers have them, its byte pieces by name; control pieces and
    the unknown piece have no text and are left out."""
    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i))])


class Counter(dict):
    """Number of pieces by segment: the best path of a unigram lattice, of which only score and length are carried.

    The automaton gives the pieces that end at each place, longest first, and a path replaces another only if it
    scores higher: so of equal paths the one with the longest last piece wins, as in the tokenizers' own search from
    left to right. An unknown character is a candidate behind all pieces with the same end.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.singles = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.unknown_score
        #: No piece reaches over the end of a word, or over a line break: the lattice falls apart there.
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary.pieces)
        self.by_lines = not any("\n" in p and len(p) > 1 for p, _ in vocabulary.pieces)

    def __missing__(self, segment: str) -> int:
        if len(segment) > LONGEST:
            return self.best(segment)
        if len(self) >= REMEMBERED:
            self.clear()
        self[segment] = n = self.best(segment)
        return n

    def best(self, segment: str) -> int:
        singles, unknown = self.singles, self.unknown
        score: list = [0.0] + [None] * len(segment)
        count = [0] * (len(segment) + 1)
        done = 0

        def settle(to: int) -> None:
            for p in range(done, to):
                char = segment[p]
                if char not in singles:
                    own = score[p] + unknown
                    if score[p + 1] is None or own > score[p + 1]:
                        score[p + 1], count[p + 1] = own, count[p] + len(char.encode())

        for last, (length, value) in self.matches.iter(segment):
            if last > done:
                settle(last)
                done = last
            start = last + 1 - length
            own = score[start] + value
            if score[last + 1] is None or own > score[last + 1]:
                score[last + 1], count[last + 1] = own, count[start] + 1
        settle(len(segment))
        return count[-1]

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        if not (self.by_words and self.by_lines):
            return self.best(MARK + text.replace(" ", MARK))
        get, total = self.__getitem__, 0
        lines = text.split("\n")
        if len(lines) > 1:
            total = get("\n") * (len(lines) - 1)
        for k, line in enumerate(lines):
            marked = (MARK if not k else "") + line.replace(" ", MARK)
            if MARK + MARK in marked or marked.endswith(MARK):
                total += sum(map(get, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)))
            elif marked:
                first, *rest = marked.split(MARK)
                total += (get(first) if first else 0) + sum(map(get, [MARK + w for w in rest]))
        return total


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_tokens)` of every row: a mark goes before the text and in place of each space, then the best path of
    pieces is counted. Null and empty texts have none. The driver reads the vocabulary, whose size is that of one file;
    each task builds the automaton once and remembers a bounded number of words of bounded length."""
    vocabulary = read_vocabulary(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary).of_text
        for batch in batches:
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")
