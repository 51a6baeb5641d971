"""Token ids of whole texts with a public tokenizer file, each distinct word encoded once.

The tokenizers used here split at white space before anything else and never join pieces of
two words, so the ids of a text are the ids of its words in order. Words repeat: a worker
remembers the ids of those it has met, which saves most of the encoding.
"""

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from changesync.llm import words as W

REMEMBERED = 300_000  # words that a worker keeps from before; as many again are gathered before the older ones go
ENCODED = 5_000  # words handed to the tokenizer at once: what it returns is large

MARKS = ".,;:!?"

_workers: dict = {}


class Encoder:
    """Encodes words; one per Python worker and tokenizer file (see `encoder`)."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Words that are met again pass from the older ones to the newer, the rest are dropped in time: most
        words are met once."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = ids
        # A run of these marks after a letter is always a piece of its own.
        stems = [w.rstrip(MARKS) for w in fresh]
        cut = [(w, s, w[len(s):]) for w, s in zip(fresh, stems) if len(s) < len(w) and s and s[-1].isalpha()]
        joined = {w for w, _, _ in cut}
        single = dict.fromkeys(w for w in fresh if w not in joined)
        single.update(dict.fromkeys(part for _, *parts in cut for part in parts if part not in known))
        single = list(single)
        for at in range(0, len(single), ENCODED):
            part = single[at : at + ENCODED]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        for w, stem, marks in cut:
            known[w] = known[stem] + known[marks]
        return [known[w] for w in words]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit, offsets) of the texts; null counts as empty."""
        texts = pc.fill_null(texts, "")
        # The tokenizer lowers case itself, so fewer distinct words may be made first; but only
        # after it has looked for its special tokens, which are written "<|...|>".
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        split = W.split(texts, lower=not special)
        pieces = self._of_words(W.values(split.dictionary))
        taken = pa.array(pieces, pa.large_binary()).take(split.codes)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4 if len(taken) else np.zeros(1, np.int64)
        raw = taken.buffers()[2]
        ids = np.frombuffer(raw, "<u4", ends[-1]) if raw is not None else np.empty(0, "<u4")
        return ids, ends[split.offsets]


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    rows = len(offsets) - 1
    out = np.insert(ids, offsets[1:], np.uint32(end)).astype("<u4", copy=False)
    return out, offsets + np.arange(rows + 1)


def crc(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """CRC-32 of each stretch of ids as little-endian 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]


def public_path(name: str) -> str:
    """Where the installed package of public tokenizer files has `name`."""
    import public_tokenizers

    return public_tokenizers.path(name)
