"""Fill-in-the-middle: a text is cut at two seeded places, and its middle moves to the end.

A batch goes through one chain of Arrow kernels. The texts are split into units (code points,
words or lines) as a list array over the text bytes; the flattened units carry the index of
their parent and their ordinal in it; each unit gets its role (prefix, middle, suffix) from the
two cuts of its parent, the units of a role are filtered out, rebuilt into lists and joined,
and the pieces and marks of a row are joined into its output. `restore` undoes it from the output
and the form alone. No rows meet, so a job of any size is a scan.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from changesync.llm import words as W

PLAIN, PSM, SPM = "plain", "psm", "spm"
SPACES = pa.array([0x20, *range(0x09, 0x0E)], pa.uint8())

# A unit costs a few dozen bytes while a slice is worked on, so slices are small.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Middle:
    """`unit`: "char" (a code point), "word" (a run of non-space with the white space before it)
    or "line" (up to and with its line feed). `plain_percent` of the texts stay as they are;
    of the others, `spm_percent` put the suffix first. `marks` open prefix, suffix and middle."""

    unit: str = "char"
    plain_percent: int = 10
    spm_percent: int = 20
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    seed: str = "1"

    def __post_init__(self) -> None:
        if self.unit not in ("char", "word", "line"):
            raise ValueError(f"no unit called {self.unit}")
        starts = [m[:1] for m in self.marks]
        if "" in starts or any(s in m[1:] for s in starts for m in self.marks) or len(set(self.marks)) < 3:
            # Then no mark can begin inside another one, and an output reads back in one way only.
            raise ValueError("marks must differ, and the first character of one may occur in none but as its first")


def draws(doc_id: Column | str, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the seed and the decimal doc_id (null: nothing)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def split(texts: pa.Array, unit: str) -> pa.ListArray:
    """The units of each text, as lists over the bytes of the texts. A null text has none."""
    raw, offsets = W.plain(texts)
    data = pa.array(raw, pa.uint8())
    if unit == "char":  # every byte but the later ones of a code point
        starts = pc.not_equal(pc.bit_wise_and(data, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    else:
        ends = pc.equal(data, pa.scalar(0x0A, pa.uint8())) if unit == "line" else pc.is_in(data, value_set=SPACES)
        ends = ends.to_numpy(zero_copy_only=False)
        before = np.concatenate([[True], ends[:-1]])[: len(ends)]
        # A word begins where white space does, or with the text; a line after a line feed.
        starts = before if unit == "line" else ends & ~before
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = pa.array(starts)
    at = np.concatenate([pc.indices_nonzero(starts).to_numpy().astype(np.int64), [len(raw)]])
    units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[:-1], offsets).astype(np.int32)), units)


def _joined(units: pa.Array, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of units, each joined to one string."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units), "")


def parts(lists: pa.ListArray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each row, cut after `first` and `second` units."""
    sizes = lists.value_lengths().to_numpy()
    parent = pc.list_parent_indices(lists)
    units = pc.list_flatten(lists)
    begin = pa.array(np.concatenate([[0], np.cumsum(sizes)[:-1]])[: len(sizes)].astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), pc.take(begin, parent))
    head = pc.less(ordinal, pc.take(pa.array(first), parent))
    tail = pc.greater_equal(ordinal, pc.take(pa.array(second), parent))
    inner = pc.invert(pc.or_(head, tail))
    counts = (first, second - first, sizes - second)
    return [_joined(pc.filter(units, role), n) for role, n in zip((head, inner, tail), counts)]


def _mixed(batch: pa.RecordBatch, how: Middle) -> list[pa.Array]:
    texts = pc.fill_null(batch.column("text"), "")
    lists = split(texts, how.unit)
    n = lists.value_lengths().to_numpy().astype(np.int64)
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    marked = pc.or_(pc.or_(*[pc.match_substring(texts, m) for m in how.marks[:2]]), pc.match_substring(texts, how.marks[2]))
    kept = pc.or_(marked, pa.array((n == 0) | (h3 % 100 >= 100 - how.plain_percent)))
    spm = pa.array(h4 % 100 < how.spm_percent)
    form = pc.if_else(kept, PLAIN, pc.if_else(spm, SPM, PSM))
    prefix, middle, suffix = parts(lists, first, second)
    p, s, m = how.marks
    output = pc.if_else(
        kept, texts,
        pc.if_else(
            spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, ""),
        ),
    )
    missing = pa.scalar(None, pa.int64())
    return [
        batch.column("doc_id"), pa.array(n), form, pc.if_else(kept, missing, pa.array(first)),
        pc.if_else(kept, missing, pa.array(second - first)), output,
    ]


MIXED = "doc_id LONG, n LONG, form STRING, prefix_units LONG, middle_units LONG, output STRING"


def transform(docs: DataFrame, how: Middle = Middle()) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row of `docs` (doc_id, text).

    n counts the whole text's units. A null or empty text, one that contains a mark and the share
    `plain_percent` are `plain`: the output is the text and the counts are null. A null doc_id is seeded
    by the bare seed; equal doc_ids draw alike. Repeated rows stay, other columns are ignored, an
    empty table gives an empty one.
    """
    names = [c.split()[0] for c in MIXED.split(", ")]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(_mixed(part, how), names)

    drawn = [c.alias(f"h{i + 1}") for i, c in enumerate(draws(F.col("doc_id").cast("long"), how.seed))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn).mapInArrow(run, MIXED)


def _between(texts: pa.Array, opening: str, second: str, third: str) -> list[pa.Array]:
    """What lies after each of three marks, in their order."""
    rest = pc.utf8_slice_codeunits(texts, len(opening))
    one = pc.split_pattern(rest, second, max_splits=1)
    two = pc.split_pattern(pc.list_element(one, 1), third, max_splits=1)
    return [pc.list_element(one, 0), pc.list_element(two, 0), pc.list_element(two, 1)]


def _restored(output: pa.Array, form: pa.Array, how: Middle) -> pa.Array:
    p, s, m = how.marks
    done = [output]
    for name in (PSM, SPM):
        ours = pc.fill_null(pc.equal(form, name), False)
        texts = pc.filter(output, ours)
        if name == PSM:
            prefix, suffix, middle = _between(texts, p, s, m)
        else:
            suffix, prefix, middle = _between(texts, s, p, m)
        done.append(pc.replace_with_mask(done[-1], ours, pc.binary_join_element_wise(prefix, middle, suffix, "")))
    return done[-1]


def restore(mixed: DataFrame, how: Middle = Middle(), restored_as: str = "restored") -> DataFrame:
    """`mixed` and the whole text that each output was made of, from `output` and `form` alone."""
    schema = StructType([*mixed.schema.fields, StructField(restored_as, StringType())])

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "output"):
                text = _restored(part.column("output"), part.column("form"), how)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, restored_as])

    return mixed.mapInArrow(run, schema)
