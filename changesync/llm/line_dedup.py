"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are copies when they have the same words (A-Z without case, white space aside), or
when both have at least `min_words` words and one word changed, added or removed turns one
into the other. A line is dropped when a copy of it comes earlier, by doc_id and line number;
lines without words always stay.

1. Equal lines are found by hash and aggregation. What follows works on distinct lines.
2. A filter that loses nothing: of two lines one edit apart, the first or the second half is
   the same. Lines none of whose halves occurs in another line are done.
3. The rest emit the hashes of all variants with one word left out, and of the whole line. Equal
   variants with the same place left out are a changed word; a variant equal to a whole line is
   an added or removed word. Per hash the earliest line is found by aggregation: a variant that
   very many lines share costs one row per line, never a pair of lines.
4. The found earlier line is verified by edit distance on the words themselves.

Hashes of all halves and variants come from prefix sums of a polynomial hash, so a line of n words
costs O(n).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from changesync.llm import words as W
from changesync.storage import Scratch

MIN_WORDS = 5

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2^64


@dataclass
class _Lines:
    """Lines of some texts: text row, number in the text, words, and their hash sums."""

    row: np.ndarray
    number: np.ndarray
    words: W.Words

    def __post_init__(self) -> None:
        n = len(self.words.codes) + 1
        self.a, self.b = self.words.offsets[:-1], self.words.offsets[1:]
        self.sums, self.inverse, self.inverse_of = [], [], []
        for seed, base in enumerate(_BASES):
            h = W.hash_words(self.words.dictionary, seed)[self.words.codes] if n > 1 else np.empty(0, np.uint64)
            back = pow(base, -1, 1 << 64)
            up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(back))
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1], dtype=np.uint64)]))
            self.inverse.append(down)
            self.inverse_of.append(np.uint64(back))

    def span(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words a to b (not included)."""
        return (self.sums[which][b] - self.sums[which][a]) * self.inverse[which][a]

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the words of each line."""
        size = (self.b - self.a).astype(np.uint64)
        return W.mix(self.span(self.a, self.b) + size), W.mix(self.span(self.a, self.b, 1) ^ size)

    def halves(self) -> np.ndarray:
        """Four keys per line; lines one edit apart share one at least."""
        out = []
        for less in (0, 1):  # the line as the shorter, or as the longer one
            m = np.maximum(self.b - self.a - less, 0)
            half = m // 2
            salt = m.astype(np.uint64) * np.uint64(4)
            out.append(W.mix(self.span(self.a, self.a + half) + salt))
            out.append(W.mix(self.span(self.b - (m - half), self.b) + salt + np.uint64(1)))
        return np.stack(out, axis=1)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place left out or -1 for none, key) of every line's neighbourhood."""
        n = self.b - self.a
        line = np.repeat(np.arange(len(n)), n)
        i = W.spread(self.a, n)
        a, b = self.a[line], self.b[line]
        s = self.sums[0]
        less = ((s[i] - s[a]) + (s[b] - s[i + 1]) * self.inverse_of[0]) * self.inverse[0][a]
        keys = np.concatenate([self.span(self.a, self.b) + n.astype(np.uint64), less + (n[line] - 1).astype(np.uint64)])
        return np.concatenate([np.arange(len(n)), line]), np.concatenate([np.full(len(n), -1), i - a]), W.mix(keys)


def _lines(texts: pa.Array) -> tuple[_Lines, pa.Array]:
    parts = pc.split_pattern(W.strings(*W.plain(texts)), "\n")
    ends = parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    flat = parts.flatten()
    return _Lines(row, np.arange(len(flat)) - ends[:-1][row], W.split(flat)), flat


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


OCCURRENCE = "row LONG, doc_id LONG, line INT, words INT, h LONG, g LONG, halves ARRAY<LONG>"


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per line of every whole text, without the text."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                lines, _ = _lines(part.column("text"))
                h, g = lines.identity()
                halves = lines.halves()
                cuts = pa.array(np.arange(0, 4 * len(h) + 1, 4, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + lines.row), part.column("doc_id").take(pa.array(lines.row)), pa.array(lines.number.astype(np.int32)),
                     pa.array((lines.b - lines.a).astype(np.int32)), _longs(h), _longs(g), pa.ListArray.from_arrays(cuts, _longs(halves.ravel()))],
                    ["row", "doc_id", "line", "words", "h", "g", "halves"],
                )
                first += part.num_rows

    return _source(docs).mapInArrow(run, OCCURRENCE)


def _place() -> Column:
    """Orders lines: by doc_id, nulls last, line number, and row among equal doc_ids."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "row")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (h, g, first) with the line's words, found again in the documents of first occurrence."""
    ids = wanted.select(F.col("first.doc_id").alias("_want")).distinct()
    source = _source(docs)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                lines, flat = _lines(part.column("text"))
                h, g = lines.identity()
                yield pa.RecordBatch.from_arrays([_longs(h), _longs(g), flat.cast(pa.string())], ["h", "g", "text"])

    found = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi").select("text").mapInArrow(run, "h LONG, g LONG, text STRING")
    return wanted.join(found, ["h", "g"]).dropDuplicates(["h", "g"])


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """(key, place, h, g, first) of every variant."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=W.SLICE_BYTES // 4):
                lines, _ = _lines(part.column("text"))
                line, place, key = lines.variants()
                at = pa.array(line)
                yield pa.RecordBatch.from_arrays(
                    [_longs(key), pa.array(place.astype(np.int32)), part.column("h").take(at), part.column("g").take(at)], ["key", "place", "h", "g"]
                )

    return texts.select("h", "g", "text").mapInArrow(run, "key LONG, place INT, h LONG, g LONG")


def one_edit(a: list, b: list) -> bool:
    """Whether at most one item changed, added or removed turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if len(a) == len(b):
        return a[same + 1 :] == b[same + 1 :]
    return a[same + (len(a) > len(b)) :] == b[same + (len(b) > len(a)) :]


def near_lines(docs: DataFrame, every: DataFrame, lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(h, g, earlier): distinct lines with the place of the earliest line that is one edit away,
    where that comes before the line's own first place."""
    halves = every.filter(F.col("words") >= min_words).select("h", "g", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi")).filter("_lo <> _hi").select("half")
    close = halves.join(shared, "half", "left_semi").select("h", "g").distinct()
    texts = scratch.keep(_texts(docs, lines.join(close, ["h", "g"])), "texts")

    every = _neighbourhoods(texts)
    met = every.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    live = scratch.keep(every.join(met, "key", "left_semi").join(texts.select("h", "g", "first"), ["h", "g"]), "variants")
    best = F.min(F.struct("first", "h", "g")).alias("best")
    by_place = live.groupBy("key", "place").agg(best)
    whole = by_place.filter("place = -1").select("key", "best")
    less = by_place.filter("place >= 0").groupBy("key").agg(F.min("best").alias("best"))
    changed = live.filter("place >= 0").join(by_place.filter("place >= 0"), ["key", "place"])
    added = live.filter("place >= 0").join(whole, "key")
    removed = live.filter("place = -1").join(less, "key")
    columns = ["h", "g", "first", "best"]
    found = changed.select(*columns).unionByName(added.select(*columns)).unionByName(removed.select(*columns))
    found = found.filter(F.col("best.first") < F.col("first")).groupBy("h", "g").agg(F.min("best").alias("best"))
    pairs = found.select("h", "g", F.col("best.h").alias("h2"), F.col("best.g").alias("g2"), F.col("best.first").alias("earlier"))
    pairs = pairs.join(texts.select("h", "g", "text"), ["h", "g"])
    pairs = pairs.join(texts.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("text").alias("text2")), ["h2", "g2"])

    def verify(batches):
        for batch in batches:
            a, b = ([t.encode().lower().split() for t in W.values(batch.column(c))] for c in ("text", "text2"))
            yield batch.drop_columns(["text", "text2"]).filter(pa.array([one_edit(x, y) for x, y in zip(a, b)], pa.bool_()))

    earlier = "STRUCT<last: BOOLEAN, doc_id: LONG, line: INT, row: LONG>"
    return pairs.select("h", "g", "earlier", "text", "text2").mapInArrow(verify, f"h LONG, g LONG, earlier {earlier}")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line of `docs` (doc_id, text): row, doc_id, line (from 0), kept, keep_doc_id, keep_line.

    Texts are cut at newlines; a null or empty text is one empty line. keep_... is the earliest
    copy, the line itself if it stays. Null doc_ids come last; of lines that tie (equal doc_id
    and number) one stays. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    every = scratch.keep(occurrences(docs).withColumn("place", _place()), "occurrences")
    filled = every.filter("words > 0")
    lines = filled.groupBy("h", "g").agg(F.min("place").alias("first"))
    lines = scratch.keep(lines, "lines")
    near = near_lines(docs, filled, lines, min_words, scratch)
    best = lines.select("h", "g", "first").join(near, ["h", "g"], "left").select("h", "g", F.coalesce("earlier", "first").alias("best"))
    # A frequent line is a hot key of a join with a unique right side, which adaptive execution splits.
    out = filled.select("place", "h", "g").join(best, ["h", "g"]).select("place", "best")
    out = out.unionByName(every.filter("words = 0").select("place", F.col("place").alias("best")))
    return out.select(
        "place.row", "place.doc_id", "place.line", (F.col("place") == F.col("best")).alias("kept"),
        F.col("best.doc_id").alias("keep_doc_id"), F.col("best.line").alias("keep_line"),
    )


def cleaned(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, text) with the dropped lines left out; for tables whose doc_ids are distinct. A
    document all of whose lines are dropped has an empty text."""
    kept = decisions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("line")))).alias("_kept"))  # within one text
    lines = F.split("text", "\n", -1)
    text = F.array_join(F.transform(F.col("_kept"), lambda i: F.get(lines, i)), "\n")
    return _source(docs).join(kept, "doc_id").select("doc_id", text.alias("text"))
