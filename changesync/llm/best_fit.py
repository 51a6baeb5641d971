"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces, longest first, go where they fit under all three: to the open sequence
with the largest weighted dot product of demand and rest ("dot"), or with the smallest weighted
norm of what would be left ("norm", the vector form of best fit).

Pieces are dealt at random to shards of bounded size, each packed by one task: a shard of
thousands of sequences loses a fraction of one sequence against packing all at once.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from changesync.llm import tokens as T, words as W
from changesync.storage import Scratch


@dataclass(frozen=True)
class Packing:
    """Capacities of a sequence and how to choose one. The default document and attention
    capacities are those that `tokens` implies, so that only tokens bind."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"
    shard_pieces: int = 8192

    def capacities(self) -> np.ndarray:
        most = (self.tokens, self.documents or self.tokens, self.attention or self.tokens**2)
        if most[2] < self.tokens**2:
            raise ValueError("the attention capacity must admit one piece of full length")
        return np.array(most, np.int64)


SLICE_BYTES = 4 << 20  # text split and encoded at a time: a worker holds its words several times over

PIECE = "row LONG, doc_id LONG, piece INT, start LONG, length LONG, ids_crc32 LONG"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: its ids and the end id, cut after each `longest` ids.

    A null or empty text is its end id alone. `row` numbers the rows of `docs`, so repeated rows and
    null or repeated doc_ids stay apart. `with_ids` adds the ids themselves.
    """

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch, most=SLICE_BYTES):
                ids, offsets = T.with_end(*T.encoder(tokenizer).ids(part.column("text")), end_id)
                sizes = np.diff(offsets)
                count = -(-sizes // longest)
                of = np.repeat(np.arange(len(sizes)), count)
                number = W.spread(np.zeros(len(sizes), np.int64), count)
                start = number * longest
                length = np.minimum(sizes[of] - start, longest)
                first = offsets[of] + start
                columns = [
                    pa.array(row + of), part.column("doc_id").take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(T.crc(ids, first, first + length), pa.int64()),
                ]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cuts = np.concatenate([first, offsets[-1:]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                row += len(sizes)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(W.trimmed(run), PIECE + (", ids ARRAY<INT>" if with_ids else ""))


def fit(lengths: np.ndarray, how: Packing) -> np.ndarray:
    """The sequence number of each piece; `lengths` must not rise."""
    cap = how.capacities()
    scale = np.array(how.weights) / cap.astype(float) ** 2
    rest = np.empty((len(lengths), 3), np.int64)
    open_, used = np.empty(len(lengths), np.int64), 0  # the open sequences, and how many
    least = int(lengths[-1]) if len(lengths) else 0
    made, out = 0, np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        demand = np.array((length, 1, length * length), np.int64)
        at = -1
        if used:
            left = rest[:used] - demand
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                if how.rule == "dot":
                    score = -(rest[fits] * (demand * scale)).sum(axis=1)
                else:
                    score = (np.square(left[fits].astype(float)) * scale).sum(axis=1)
                at = int(fits[np.argmin(score)])
        if at < 0:
            at, used = used, used + 1
            rest[at], open_[at] = cap, made
            made += 1
        rest[at] -= demand
        out[i] = open_[at]
        if (rest[at] < (least, 1, least * least)).any():  # nothing fits any more
            used -= 1
            rest[at], open_[at] = rest[used], open_[used]
    return out


def pack(cut: DataFrame, how: Packing, pieces_total: int) -> DataFrame:
    """`cut` with `sequence_id` and `offset`. Equal lengths go in the order of (row, piece);
    an empty table packs to an empty one."""
    shards = max(1, -(-pieces_total // how.shard_pieces))

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        sequence = fit(lengths, how)
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        new = np.concatenate([[True], np.diff(sequence[order]) != 0])
        offset = np.empty(len(lengths), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(new, begins, 0))
        shard = key[0].as_py()
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PIECE + ", sequence_id LONG, offset LONG")


def packed(docs: DataFrame, tokenizer: str, end_id: int, how: Packing = Packing()) -> DataFrame:
    """Every piece of `docs` with its place. The pieces are written once: their number decides
    the shards, and row numbers must not change between the two."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, tokenizer, end_id, how.tokens), "pieces")
    return pack(cut, how, cut.count())


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The token sequences themselves: (sequence_id, ids). `with_ids` has the ids of each
    (row, piece); a sequence is bounded, so its pieces may be gathered."""
    whole = placed.select("sequence_id", "offset", "row", "piece").join(with_ids.select("row", "piece", "ids"), ["row", "piece"])
    lists = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return lists.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
