"""Words of Arrow text columns, without a Python object per word.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). Columns are cut into
slices of bounded size, so that a batch of long texts never has to be split at once.
"""

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Workers live on from task to task. The system's allocator gives freed buffers back to the
# machine; Arrow's own pool keeps them, and a few idle workers then hold most of an executor.
pa.set_memory_pool(pa.system_memory_pool())

def give_back() -> None:
    """Freed memory goes back to the machine, as far as the C library can (glibc)."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run):
    """The task `run`, which gives back what it has freed when it ends: freed pages between others that
    are in use stay with a worker otherwise, while it waits for its next task."""

    @wraps(run)
    def task(batches):
        yield from run(batches)
        give_back()

    return task


SLICE_BYTES = 8 << 20  # text held in split form at a time, unless one text alone is longer

_MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """`codes` index `dictionary`; row i has codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array

    def rows(self) -> np.ndarray:
        """The row number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def plain(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, null as empty, in buffers of their own that start at 0.
    `lower` maps A-Z only. Arrow's own kernel for that is not used: it reads the wrong bytes
    of sliced arrays."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    return raw, offsets - offsets[0]


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The text column that `plain` gives the bytes of."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))
    )


def split(texts: pa.Array, lower: bool = True) -> Words:
    """The words of each text; a null text counts as empty. `lower` maps A-Z only."""
    parts = pc.ascii_split_whitespace(strings(*plain(texts, lower)))
    lists = parts.offsets.to_numpy().astype(np.int64)
    found = parts.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    # Text edges that are white space give empty words: leave those out.
    blank = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    lists = lists - lists[0]
    if blank >= 0 and len(codes):
        real = codes != blank
        before = np.concatenate([[0], np.cumsum(real)])
        codes, lists = codes[real], before[lists]
    return Words(codes, lists, found.dictionary)


def values(array: pa.Array) -> list:
    """The Python values of a string or binary array, much sooner than `to_pylist` has them."""
    return array.to_numpy(zero_copy_only=False).tolist()


def hash_words(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each dictionary entry."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in values(dictionary.cast(pa.large_binary()))), np.uint64, len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finish of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `width` words, repeats included. A row with fewer words,
    but at least one, has its whole sequence as one shingle; a row without words has none."""
    hashes = hash_words(words.dictionary, seed)[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    lengths = np.diff(words.offsets)
    row = words.rows()
    left = words.offsets[1:][row] - np.arange(len(row))  # words from here to the end of the row
    total = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        part = np.zeros(len(hashes), np.uint64)
        if k < len(hashes):
            part[: len(hashes) - k] = hashes[k:]
        total = mix(total + _MIX) ^ np.where(left > k, part, np.uint64(k + 1))
    total = mix(total)
    starts = (left >= width) | ((lengths[row] < width) & (left == lengths[row]))
    return row[starts], total[starts]


def distinct_per_row(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row: (values, offsets). `row` must not fall."""
    ends = np.cumsum(np.bincount(row, minlength=rows)).tolist() if rows else []
    value, start = value.copy(), 0
    for end in ends:
        value[start:end].sort()
        start = end
    if len(row):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
        row, value = row[new], value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of several runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def binary_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per row: the raw bytes of its stretch of `values`."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(data)],
    ).cast(pa.binary())
