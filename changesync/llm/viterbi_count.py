"""Token counts under a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at a position; dynamic
programming carries the best score and the number of pieces up to each position. Rules of the
unigram tokenizer, which the counts equal exactly:

* scores add up from the left in double precision;
* of equally good segmentations of a prefix the one whose last piece is longest stands;
* a character that is no piece of its own may be an unknown one, whose score is the smallest of
  the vocabulary minus 10; neighbouring unknown characters are one piece;
* a word is its characters behind the mark U+2581, and is segmented on its own.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from changesync.llm import words as W

MARK, UNKNOWN_PENALTY = "▁", 10.0  # fixed values of the tokenizer
REMEMBERED = 1_000_000  # words a worker keeps; beyond it the memory starts afresh

_workers: dict = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores by Zipf's law over their rank: the
    public files hold merge ranks, not probabilities. Control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (rank + 1) for rank in range(len(ids)))
    return [(model.id_to_piece(i), float(-np.log((rank + 1) * total))) for rank, i in enumerate(ids)]


class Counter:
    """Best score and piece count of words."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[float, int]] = {}

    def segment(self, word: str) -> tuple[float, int]:
        ends: list[list] = [[] for _ in range(len(word) + 1)]
        for last, piece in self.automaton.iter(word):
            ends[last + 1].append(piece)
        best, count, open_ = [0.0], [0], [False]  # up to a position; whether it ends in an unknown piece
        for end in range(1, len(word) + 1):
            top, pieces, unknown, single = None, 0, False, False
            for length, score in sorted(ends[end], reverse=True):
                single = single or length == 1
                total = best[end - length] + score
                if top is None or total > top:
                    top, pieces = total, count[end - length] + 1
            if not single:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, pieces, unknown = total, count[end - 1] + (not open_[end - 1]), True
            best.append(top)
            count.append(pieces)
            open_.append(unknown)
        return best[-1], count[-1]

    def words(self, words: list[str]) -> list[tuple[float, int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = self.segment(MARK + w)
        return [self.known[w] for w in words]


def counter(path: str) -> Counter:
    if path not in _workers:
        _workers[path] = Counter(vocabulary(path))
    return _workers[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_words, best_score) of every whole text of `docs` (doc_id, text).

    Null and empty texts have no tokens and score 0. Every row is counted, repeated ones too;
    other columns are ignored. `path` is the vocabulary file, the same on every machine.
    """

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                split = W.split(part.column("text"), lower=False)
                found = counter(path).words(W.values(split.dictionary))
                n = np.array([c for _, c in found] + [0], np.int64)
                score = np.array([s for s, _ in found] + [0.0])
                ends = split.offsets
                pieces = np.concatenate([[0], np.cumsum(n[split.codes])])
                rows = split.rows()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(pieces[ends[1:]] - pieces[ends[:-1]]), pa.array(np.diff(ends)),
                     pa.array(np.bincount(rows, weights=score[split.codes], minlength=part.num_rows).astype(float))],
                    ["doc_id", "n_tokens", "n_words", "best_score"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id LONG, n_tokens LONG, n_words LONG, best_score DOUBLE")
