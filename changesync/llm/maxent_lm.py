"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class).

* Classes: words by their last letters (short words whole), hashed to a fixed number; the end
  of a text is a class of its own.
* P(class | history) is a softmax over hashed features of the history: the previous word, the
  one before it (a skip), and the pair. Weights live in a table of fixed size. They start at smoothed log-odds of counts over
  all training texts, and are trained by distributed gradient updates: every task sums its share of
  the gradient under common weights, the sums are added along a tree of tasks, and one step is made with the
  whole. So the model is a function of the texts, not of how they are dealt to tasks, but for rounding.
* P(word | class) has unigram features only, whose maximum-entropy solution is the smoothed
  relative frequency: (c + 1) / (N_class + V_class + 1), one unit being for all unknown words.

Word counts cover the whole vocabulary and are exact, words being known by their class and 59 bits of a hash. Texts are
coded in blocks of bounded size (word codes, and the hashes of the block's words), so a word is
counted once per block and not once per occurrence; its total is sent back to a block only if
the block does not know it by itself.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from changesync.llm import words as W
from changesync.llm.counters import tree_sum
from changesync.storage import Scratch


KIND_MASK = 31  # of the class in a word's number


@dataclass(frozen=True)
class Settings:
    classes: int = 32  # the last is the end of a text; at most 32, see KIND_MASK
    features_log2: int = 16  # at most 16: features are numbered in two bytes
    batch: int = 32_768  # tokens scored at a time
    block_bytes: int = 8 << 20  # text of a block, unless one text alone is longer
    updates: int = 3  # gradient steps over all training texts
    smooth: float = 32.0  # uses of a feature at which its counts weigh as much as the class's share
    start: float = 0.6  # share of the log-odds in the first weights: the three features of a token overlap
    decay: float = 10.0  # of the weights, in uses
    rate: float = 0.8

    def __post_init__(self) -> None:
        if not 2 <= self.classes <= KIND_MASK + 1:
            raise ValueError(f"classes must be 2 to {KIND_MASK + 1}, not {self.classes}")
        if not 1 <= self.features_log2 <= 16:
            raise ValueError(f"features_log2 must be 1 to 16, not {self.features_log2}")

    @property
    def cells(self) -> int:
        return 1 << self.features_log2


BLOCK = (
    "block LONG, doc_ids ARRAY<LONG>, held_out ARRAY<BOOLEAN>, offsets ARRAY<LONG>, codes BINARY, kinds BINARY, hashes BINARY, seen BINARY"
)


PLACE_BITS = 26  # of the position in a block


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _kind(word: bytes, classes: int) -> int:
    """The class of a word: by its last letters, without marks at its end."""
    core = word.rstrip(b".,;:!?\"')") or word
    tail = core if len(core) <= 3 else core[-3:]
    return xxhash.xxh3_64_intdigest(tail) % (classes - 1)


def coded(docs: DataFrame, how: Settings) -> DataFrame:
    """Blocks of texts: word codes, the block's words with class and hash, and how often the
    training texts of the block use each."""

    def run(batches):
        block = TaskContext.get().partitionId() << 16
        for batch in batches:
            for part in W.slices(batch, most=how.block_bytes):
                split = W.split(part.column("text"))
                spelled = W.values(split.dictionary.cast(pa.large_binary()))
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                kinds = np.fromiter((_kind(w, how.classes) for w in spelled), np.uint8, len(spelled))
                train = ~held[split.rows()]
                seen = np.bincount(split.codes[train], minlength=len(spelled)).astype(np.int32)

                def one(array):
                    return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one(part.column("doc_id")), one(part.column("held_out")), one(pa.array(split.offsets)),
                     pa.array([zstandard.compress(split.codes.astype("<u4").tobytes())], pa.binary()), pa.array([kinds.tobytes()], pa.binary()),
                     pa.array([W.hash_words(split.dictionary).astype("<u8").tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())],
                    [f.split()[0] for f in BLOCK.split(", ")],
                )
                block += 1

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out")
    )
    return source.mapInArrow(W.trimmed(run), BLOCK)


def _uses(blocks: DataFrame) -> DataFrame:
    """(word, place, seen): the words of each block. `word` is a hash whose last five bits are the
    class, `place` is the block and the position in it; narrow rows, for there are many."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                kinds, seen = np.frombuffer(batch.column("kinds")[i].as_py(), np.uint8), np.frombuffer(batch.column("seen")[i].as_py(), "<i4")
                words = np.frombuffer(batch.column("hashes")[i].as_py(), "<i8") & ~KIND_MASK | kinds
                block = batch.column("block")[i].as_py()
                for at in range(0, len(words), 65_536):
                    here = slice(at, at + 65_536)
                    n = len(words[here])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[here]), pa.array((block << PLACE_BITS) + np.arange(at, at + n)), pa.array(seen[here].astype(np.int64))],
                        ["word", "place", "seen"],
                    )

    return blocks.select("block", "hashes", "kinds", "seen").mapInArrow(W.trimmed(run), "word LONG, place LONG, seen LONG")


FEATURES = 3  # that a token has


class _Tokens:
    """The tokens of one block in order, each text's end included: classes and features."""

    def __init__(self, row: dict, how: Settings) -> None:
        self.offsets = np.asarray(row["offsets"], np.int64)
        codes = np.frombuffer(zstandard.decompress(row["codes"]), "<u4")
        self.words = len(row["kinds"])  # the code of the end
        texts = len(self.offsets) - 1
        self.codes = np.insert(codes, self.offsets[1:], self.words)
        self.starts = self.offsets + np.arange(texts + 1)
        kinds = np.append(np.frombuffer(row["kinds"], np.uint8), np.uint8(how.classes - 1))
        self.kinds = kinds[self.codes]
        short = np.append(np.frombuffer(row["hashes"], "<u8") >> np.uint64(32), np.uint64(1)).astype(np.uint32)[self.codes]
        one, two = np.roll(short, 1), np.roll(short, 2)
        first = self.starts[:-1]
        one[first], two[first] = 2, 3  # before the beginning of a text
        second = first + 1
        two[second[second < self.starts[1:]]] = 3
        down = np.uint32(32 - how.features_log2)
        pair = ((one * np.uint32(0xC2B2AE3D)) ^ (two * np.uint32(0x27D4EB2F)) ^ (one >> np.uint32(15))) * np.uint32(0x165667B1)
        self.features = [
            (x >> down).astype(np.uint16) for x in (one * np.uint32(0x9E3779B1), two * np.uint32(0x85EBCA77) + np.uint32(0x51ED270B), pair)
        ]
        self.held = np.repeat(np.asarray(row["held_out"], bool), np.diff(self.starts))


LARGE = 60.0  # single precision holds exp of this and of its negative, and sums of them


def _logits(features: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Up to a constant of each row, which is taken off where exp could leave its range."""
    z = np.take(weights, features[0], axis=0)
    for f in features[1:]:
        z += np.take(weights, f, axis=0)
    z += bias
    if len(z) and (z.max() > LARGE or z.min() < -LARGE):
        z -= z.max(axis=1, keepdims=True)
    return z


def _row_sums(p: np.ndarray) -> np.ndarray:
    return p @ np.ones(p.shape[1], p.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z)
    p *= (1 / _row_sums(p))[:, None]
    return p


def _log_chosen(z: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at one class of each row."""
    return z[np.arange(len(z)), kinds] - np.log(_row_sums(np.exp(z)))


def _counts(blocks, how: Settings) -> np.ndarray:
    """How often the training tokens of some blocks have each feature and class; `cells` by `classes`."""
    out = np.zeros((how.classes, how.cells), np.int64)
    for row in blocks:
        t = _Tokens(row, how)
        kinds = np.where(t.held, how.classes, t.kinds)
        for kind in range(how.classes):
            mine = np.flatnonzero(kinds == kind)
            for f in t.features:
                out[kind] += np.bincount(f[mine], minlength=how.cells)
    return out.T


def _expected(blocks, weights: np.ndarray, bias: np.ndarray, how: Settings) -> np.ndarray:
    """The same numbers as the model expects them: sums of its class probabilities."""
    out = np.zeros((how.classes, how.cells))
    for row in blocks:
        t = _Tokens(row, how)
        train = np.flatnonzero(~t.held)
        for at in range(0, len(train), how.batch):
            take = train[at : at + how.batch]
            features = [x[take].astype(np.int64) for x in t.features]
            p = np.ascontiguousarray(_softmax(_logits(features, weights, bias)).T)
            for kind in range(how.classes):
                for f in features:
                    out[kind] += np.bincount(f, weights=p[kind], minlength=how.cells)
    return out.T


def first_weights(seen: np.ndarray, how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) from counts of features and classes; all zero but for a common bias without any."""
    tokens = seen.sum(axis=0) / FEATURES
    share = (tokens + 1) / (tokens.sum() + how.classes)
    odds = (seen + how.smooth * share) / (seen.sum(axis=1, keepdims=True) + how.smooth) / share
    return (how.start * np.log(odds)).astype(np.float32), np.log(share).astype(np.float32)


def updated(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, expected: np.ndarray, how: Settings) -> tuple[np.ndarray, np.ndarray]:
    """One step along the gradient of the training texts' log probability, scaled per feature and class by what both
    sides have of it."""
    step = (seen - expected - how.decay * weights) / ((seen + expected) / 2 + how.smooth)
    tokens, modelled = seen.sum(axis=0) / FEATURES, expected.sum(axis=0) / FEATURES
    shift = (tokens - modelled) / ((tokens + modelled) / 2 + 1)
    return (weights + how.rate * step).astype(np.float32), (bias + how.rate * shift).astype(np.float32)


TASK_BLOCKS = 8  # that a task of a pass reads at least


def train(blocks: DataFrame, how: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias) of the class model, and the training tokens of each class."""
    spark = blocks.sparkSession
    # A task gives one array of fixed size however many blocks it reads, one after another, so their
    # number follows the cluster and not the input. Each pass leaves these arrays on disk: none for a few blocks.
    tasks = max(1, min(spark.sparkContext.defaultParallelism, blocks.count() // TASK_BLOCKS))
    read = blocks.select("doc_ids", "held_out", "offsets", "codes", "kinds", "hashes").coalesce(tasks)

    def total(part, dtype: str) -> np.ndarray:
        def run(batches):
            rows = (_row(batch, i) for batch in batches for i in range(batch.num_rows))
            out = np.ascontiguousarray(part(rows), dtype)
            if out.any():
                ends = pa.py_buffer(np.array([0, out.nbytes], np.int32))
                yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(out)])], ["sums"])

        found = tree_sum(read.mapInArrow(W.trimmed(run), "sums BINARY"), dtype)
        shape = how.cells, how.classes
        return np.zeros(shape) if found is None else found.reshape(shape)

    seen = total(lambda rows: _counts(rows, how), "<i8")
    weights, bias = first_weights(seen, how)
    for _ in range(how.updates if seen.any() else 0):
        shared = spark.sparkContext.broadcast((weights, bias))  # of fixed size
        expected = total(lambda rows: _expected(rows, *shared.value, how), "<f4")  # noqa: B023
        weights, bias = updated(weights, bias, seen, expected, how)
    return weights, bias, seen.sum(axis=0) // FEATURES


def _row(batch: pa.RecordBatch, i: int) -> dict:
    def flat(name):
        return batch.column(name).slice(i, 1).flatten().to_numpy(zero_copy_only=False)

    return {n: flat(n) for n in ("held_out", "offsets")} | {n: batch.column(n)[i].as_py() for n in ("codes", "kinds", "hashes")} | {
        "doc_ids": batch.column("doc_ids").slice(i, 1).flatten()
    }


RESULT = "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, score DOUBLE"


def score(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): `RESULT`.

    A null text counts as empty: its end is its only token. Rows with a null doc_id are learned
    from. Repeated rows count as often as they occur. Without training texts all counts are zero
    and the model's classes are equally likely. Other columns are ignored; an empty table gives
    an empty one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    blocks = scratch.keep(coded(docs, how), "blocks")
    # A word has one narrow row per block at most, so that no word is a large group.
    word = Window.partitionBy("word")
    told = _uses(blocks).select(
        F.col("word").bitwiseAND(KIND_MASK).cast("tinyint").alias("kind"), "place", F.sum("seen").over(word).alias("c"),
        (F.min("place").over(word) == F.col("place")).alias("first"), "seen",
    )
    elsewhere = F.col("c") != F.col("seen")
    totals = scratch.keep(
        told.filter((F.col("c") > 0) & (elsewhere | F.col("first"))).select(
            "kind", "first", F.when(elsewhere, F.col("place")).alias("place"), F.when(elsewhere, F.col("c")).alias("c")
        ),
        "totals",
    )
    weights, bias, size = train(blocks, how)
    size, variety = size.astype(np.int64), np.zeros(how.classes, np.int64)
    for r in totals.filter("first").groupBy("kind").count().collect():  # a row per class
        variety[r["kind"]] = r["count"]
    texts = int(size[-1])
    variety[-1] = texts > 0
    tokens, distinct = int(size.sum()), int(variety.sum())
    shared = spark.sparkContext.broadcast((weights, bias, size, variety))  # of fixed size
    back = totals.filter("place IS NOT NULL").select(
        F.shiftright("place", PLACE_BITS).alias("block"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("at"), "c"
    )

    def run(_, left: pa.Table, right: pa.Table):
        weights, bias, class_size, class_variety = shared.value
        row = _row(left.combine_chunks().to_batches()[0], 0)
        t = _Tokens(row, how)
        count = np.append(np.frombuffer(left.column("seen")[0].as_py(), "<i4"), 0).astype(np.float64)
        count[right.column("at").to_numpy()] = right.column("c").to_numpy()
        count[-1] = texts
        kinds = np.append(np.frombuffer(row["kinds"], np.uint8), np.uint8(how.classes - 1))
        base = np.log10((count + 1) / (tokens + distinct + 1))
        inside = np.log10((count + 1) / (class_size + class_variety + 1)[kinds])
        model = inside[t.codes]
        for at in range(0, len(t.codes), how.batch):
            here = slice(at, at + how.batch)
            z = _logits([x[here] for x in t.features], weights, bias)
            model[here] += _log_chosen(z, t.kinds[here]) / np.log(10)
        text = t.starts[:-1]
        known = (count > 0).astype(np.int64)
        out = [
            row["doc_ids"], pa.array(np.asarray(row["held_out"], bool)), pa.array(np.diff(t.starts)), pa.array(np.add.reduceat(known[t.codes], text)),
            pa.array(np.full(len(text), tokens)), pa.array(np.add.reduceat(base[t.codes], text)), pa.array(np.add.reduceat(model, text)),
        ]
        return pa.table(out, [f.split()[0] for f in RESULT.split(", ")])

    coded_blocks = blocks.select("block", "doc_ids", "held_out", "offsets", "codes", "kinds", "hashes", "seen")
    return coded_blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, RESULT)
