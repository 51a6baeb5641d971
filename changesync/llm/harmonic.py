"""Harmonic packing: every piece belongs to the class of a reciprocal of the capacity.

A class k holds pieces of capacity / k tokens, rounded down, and each of its sequences takes
exactly k of them. Only classes that fill a sequence but for `slack` tokens are used, and a
document is cut into the fewest lengths of such classes. So any worker fills its sequences alone:
the place of a piece follows from its number in the worker's class. What is left over, fewer than
k pieces a worker and class, is numbered along the workers and filled alike; then less than one
sequence a class remains. Those pieces are cut again into powers of two and share sequences
whose length is one, which need no padding.
"""

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from changesync.llm import tokens as T, words as W
from changesync.storage import Scratch


@dataclass(frozen=True)
class Harmonic:
    """`tokens`: the capacity, a power of two. `slack`: the most tokens that a full sequence may
    be padded by; 0 leaves the powers of two as the only classes."""

    tokens: int = 4096
    slack: int = 4

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("the capacity must be a power of two")

    def classes(self) -> dict[int, int]:
        """Length of the pieces of each class, by pieces a sequence."""
        lengths = {k: self.tokens // k for k in range(1, self.tokens + 1)}
        return {k: n for k, n in lengths.items() if self.tokens // n == k and self.tokens - k * n <= self.slack}


@cache
def cuts(how: Harmonic) -> list[np.ndarray]:
    """For each length up to the capacity the fewest lengths of classes that make it up, longest first."""
    lengths = np.array(sorted(how.classes().values()), np.int64)
    pieces, last = np.zeros(how.tokens + 1, np.int64), np.zeros(how.tokens + 1, np.int64)
    for n in range(1, how.tokens + 1):
        fit = lengths[lengths <= n]
        best = pieces[n - fit]
        at = len(fit) - 1 - int(np.argmin(best[::-1]))  # the longest of equally good ones
        pieces[n], last[n] = best[at] + 1, fit[at]
    out = [np.empty(0, np.int64)]
    for n in range(1, how.tokens + 1):
        out.append(np.sort(np.concatenate([[last[n]], out[n - last[n]]]))[::-1])
    return out


PIECE = "part INT, row LONG, doc_id LONG, doc_tokens LONG, start LONG, length LONG, ids_crc32 LONG, k INT, rank LONG, ids ARRAY<INT>"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _lengths(sizes: np.ndarray, how: Harmonic) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents of `sizes` tokens, in their order."""
    parts = cuts(how)
    whole, rest = np.divmod(sizes, how.tokens)
    tails = np.array([len(p) for p in parts])[rest]
    of = np.repeat(np.arange(len(sizes)), whole + tails)
    length = np.full(len(of), how.tokens, np.int64)
    if len(of):
        length[W.spread(np.cumsum(whole + tails) - tails, tails)] = np.concatenate([parts[r] for r in rest.tolist()])
    return of, length


def _columns(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(CRC-32, ids) of each stretch; the stretches follow one another."""
    ends = np.concatenate([first, first[-1:] + length[-1:]]).astype(np.int32) if len(first) else np.zeros(1, np.int32)
    return pa.array(T.crc(ids, first, first + length), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, how: Harmonic = Harmonic()) -> DataFrame:
    """The pieces of every whole text of `docs` (doc_id, text) with its end id, and their ids.

    A null or empty text is its end id alone. `row` numbers the rows, so repeated rows and null or
    equal doc_ids stay apart; `rank` numbers the pieces of class `k` in their part.
    """
    class_of = np.zeros(how.tokens + 1, np.int64)
    for k, n in how.classes().items():
        class_of[n] = k

    def run(batches):
        part = TaskContext.get().partitionId()
        row, seen = part << 33, np.zeros(how.tokens + 1, np.int64)
        for batch in batches:
            for cut in W.slices(batch):
                ids, offsets = T.with_end(*T.encoder(tokenizer).ids(cut.column("text")), end_id)
                sizes = np.diff(offsets)
                of, length = _lengths(sizes, how)
                first = np.cumsum(length) - length
                k = class_of[length]
                order = np.argsort(k, kind="stable")
                _, begin, held = np.unique(k[order], return_index=True, return_counts=True)
                rank = np.empty(len(k), np.int64)
                rank[order] = np.arange(len(k)) - np.repeat(begin, held)
                rank += seen[k]
                seen += np.bincount(k, minlength=len(seen))
                crc, lists = _columns(ids, first, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(of), part, np.int32)), pa.array(row + of), cut.column("doc_id").take(pa.array(of)),
                    pa.array(sizes[of]), pa.array(first - offsets[of]), pa.array(length), crc, pa.array(k.astype(np.int32)), pa.array(rank), lists,
                ], _NAMES)
                row += len(sizes)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECE)


def _powers(cut: DataFrame) -> DataFrame:
    """The pieces cut again into powers of two; `k` and `rank` are still those of the whole piece."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).view(np.uint32))[ends[0] : ends[-1]]
            length = np.diff(ends)
            bits = [[1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1] for n in length.tolist()]
            of = np.repeat(np.arange(len(length)), [len(b) for b in bits])
            small = np.array([n for b in bits for n in b], np.int64)
            first = np.cumsum(small) - small
            start = batch.column("start").to_numpy()[of] + first - (ends[:-1] - ends[0])[of]
            crc, made = _columns(ids, first, small)
            taken = batch.take(pa.array(of))
            new = {"start": pa.array(start), "length": pa.array(small), "ids_crc32": crc, "ids": made}
            yield pa.RecordBatch.from_arrays([new.get(c, taken.column(c)) for c in _NAMES], _NAMES)

    return cut.mapInArrow(run, PIECE)


PLACED = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SHARED, AGAIN, OWN = 0, 1, 2  # who filled a sequence: all workers' spares, the second cut, or worker number - OWN
WORKER_BITS = 24


def _sequence(k: Column, worker: Column, sequence: Column, how: Harmonic) -> Column:
    """One number for a class, a worker and the sequence of these two."""
    classes = sorted(how.classes())
    bits = 63 - len(classes).bit_length() - WORKER_BITS
    number = F.array_position(F.lit(classes), k.cast("int")).cast("long")
    return F.shiftleft(F.shiftleft(number, WORKER_BITS) + worker.cast("long"), bits) + sequence.cast("long")


def _placed(rows: DataFrame, worker: Column, sequence: Column, place: Column, how: Harmonic) -> DataFrame:
    rows = rows.withColumns({"sequence_id": _sequence(F.col("k"), worker, sequence, how), "offset": (place * F.col("length")).cast("long")})
    return rows.select(*PLACED)


def _last_groups(rows: DataFrame, how: Harmonic) -> DataFrame:
    """Pieces that are powers of two, in full sequences; what is left of a class goes into one
    sequence for each power of two in its number."""
    of_class = Window.partitionBy("k")
    rows = rows.withColumns({
        "k": (F.lit(how.tokens) / F.col("length")).cast("int"),
    }).withColumns({
        "place": F.row_number().over(of_class.orderBy("row", "start")) - 1, "all": F.count("*").over(of_class).cast("int"),
    })
    full = F.floor(F.col("all") / F.col("k"))
    over = F.col("place") - full * F.col("k")
    left = F.col("all") - full * F.col("k")
    sequence, place, before = F.floor(F.col("place") / F.col("k")), F.col("place") % F.col("k"), F.lit(0)
    for b in range(how.tokens.bit_length(), -1, -1):
        size = F.when((F.floor(left / (1 << b)) % 2) == 1, F.lit(1 << b)).otherwise(F.lit(0))
        here = (over >= before) & (over < before + size)
        sequence, place = F.when(here, full + b).otherwise(sequence), F.when(here, over - before).otherwise(place)
        before = before + size
    return _placed(rows, F.lit(AGAIN), sequence, place, how)


def pack(cut: DataFrame, how: Harmonic, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """`cut`, a written table of pieces, to (the place of each piece, the pieces that were cut again).

    A piece that was cut again has the places of its parts instead of its own; their ids are in the
    second table, those of all others in `cut`.
    """
    k = F.col("k").cast("long")
    spare = F.col("held") % k
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("part", "k").agg(F.count("*").alias("held")).select(
        "part", "k", (F.col("held") - spare).alias("alone"), F.coalesce(F.sum(spare).over(before), F.lit(0)).alias("spares"),
        F.sum(spare).over(Window.partitionBy("k")).alias("shared"),
    )
    alone = F.col("rank") < F.col("alone")
    narrow = cut.drop("ids")
    ranked = scratch.keep(narrow.join(sums, ["part", "k"]).select(
        *narrow.columns, F.when(alone, F.col("part") + OWN).otherwise(F.lit(SHARED)).alias("worker"), (F.col("shared") - F.col("shared") % k).alias("full"),
        F.when(alone, F.col("rank")).otherwise(F.col("spares") + F.col("rank") - F.col("alone")).alias("place"),
    ), "ranked")
    filled = (F.col("worker") != SHARED) | (F.col("place") < F.col("full"))
    places = _placed(ranked.filter(filled), F.col("worker"), F.floor(F.col("place") / k), F.col("place") % k, how)
    # Less than one sequence a class is left: how much that is depends on the classes alone.
    rest = F.broadcast(ranked.filter(~filled).select("row", "start"))
    again = scratch.keep(_powers(cut.join(rest, ["row", "start"])), "again")
    return places.unionByName(_last_groups(again.drop("ids"), how)), again


def packed(docs: DataFrame, tokenizer: str, end_id: int, how: Harmonic = Harmonic()) -> DataFrame:
    """Every piece of `docs` (doc_id, text) with its place: row, doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. An empty table packs to an empty one; other columns are ignored.

    The pieces and their ids are written once, as packing them twice must see the same numbers.
    """
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.keep(pieces(docs, tokenizer, end_id, how), "pieces"), how, scratch)[0]


def sequences(places: DataFrame, cut: DataFrame, again: DataFrame) -> DataFrame:
    """The token sequences themselves, without padding: (sequence_id, ids). A sequence is bounded, so its
    pieces may be gathered."""
    key = ["row", "start", "length"]
    again = again.select(*key, "ids")
    ids = cut.select(*key, "ids").join(F.broadcast(again.select(*key)), key, "left_anti").unionByName(again)
    whole = places.select("sequence_id", "offset", *key).join(ids, key)
    lists = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return lists.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
