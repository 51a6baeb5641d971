"""Exact deduplication by Grace hashing with complete comparison of contents.

Equal texts are those identical after every run of ASCII white space became one blank.

1. Each batch of rows is combined where it lies: of equal texts one row keeps the content.
2. Contents are dealt to buckets by digits of their hash (the spill files are Spark's shuffle
   files). A task reads its bucket through an open-addressing table that compares complete
   contents. When the table is full, contents it does not hold pass on to the next level, which
   deals them by other digits to new buckets, until nothing is left. Whatever the size of the
   data, a table holds a bounded number of bytes.
3. A text's class (smallest doc_id, size) goes back to its rows by the content's SHA-256.

A text that a third of all rows share reaches its bucket once per batch, not once per row.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from changesync.llm import words as W
from changesync.storage import Scratch

BUCKET_BYTES = 32 << 20  # contents an open-addressing table may hold


ROW = "row LONG, doc_id LONG, sha BINARY, bytes LONG, content BINARY, rows LONG"
CLASS = "sha BINARY, keep_id LONG, keep_row LONG, group_size LONG"
LEFT = "row LONG, doc_id LONG, sha BINARY, content BINARY, rows LONG"


def normal(text: bytes) -> bytes:
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    if text[:1].isspace():
        out = b" " + out
    return out + b" " if text[-1:].isspace() else out


class Table:
    """Open addressing with linear probing: slots hold entry numbers; equal hashes are told
    apart by the complete contents."""

    def __init__(self, most_bytes: int) -> None:
        self.most, self.held, self.mask = most_bytes, 0, (1 << 10) - 1
        self.slots = [-1] * (self.mask + 1)
        self.keys: list[tuple[int, bytes, bytes]] = []  # hash, sha, content
        self.best: list[tuple] = []  # (doc_id is null, doc_id, row)
        self.size: list[int] = []

    def add(self, sha: bytes, content: bytes, rank: tuple, rows: int) -> bool:
        """False when the content is new and the table is full."""
        h = int.from_bytes(sha[-8:], "little")
        at = h & self.mask
        while (entry := self.slots[at]) >= 0:
            key = self.keys[entry]
            if key[0] == h and key[2] == content:
                self.best[entry] = min(self.best[entry], rank)
                self.size[entry] += rows
                return True
            at = (at + 1) & self.mask
        if self.held and self.held + len(content) > self.most:
            return False
        self.slots[at] = len(self.keys)
        self.keys.append((h, sha, content))
        self.best.append(rank)
        self.size.append(rows)
        self.held += len(content) + 200
        if 2 * len(self.keys) > self.mask:
            self._grow()
        return True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for entry, (h, _, _) in enumerate(self.keys):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = entry


def _rank(doc_id: int | None, row: int) -> tuple:
    return doc_id is None, doc_id or 0, row


def prepare(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One narrow row per document, and the content with one row of each text of a batch."""

    def run(batches):
        first_row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch):
                rows = part.column("row") if row else pa.array(np.arange(first_row, first_row + part.num_rows))
                numbers = rows.to_pylist()
                raw, ends = W.plain(part.column("text"))
                raw, ids = raw.tobytes(), part.column("doc_id").to_pylist()
                shas, contents, sizes, best, count = [], [], [], {}, {}
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    content = normal(raw[a:b])
                    sha = hashlib.sha256(content).digest()
                    rank = _rank(ids[i], numbers[i])
                    if sha not in best or rank < best[sha][0]:
                        best[sha] = (rank, i)
                    count[sha] = count.get(sha, 0) + 1
                    shas.append(sha)
                    contents.append(content)
                    sizes.append(len(content))
                first = [best[s][1] == i for i, s in enumerate(shas)]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array([c if f else None for c, f in zip(contents, first)], pa.binary()),
                     pa.array([count[s] if f else None for s, f in zip(shas, first)], pa.int64())],
                    ["row", "doc_id", "sha", "bytes", "content", "rows"],
                )
                first_row += part.num_rows

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.col(row).alias("row")] if row else [])
    )
    return source.mapInArrow(W.trimmed(run), ROW)


def level(records: DataFrame, depth: int, buckets: int, most: int) -> DataFrame:
    """One level: classes of the contents that its tables held, and the records passed on
    (those with content)."""

    def run(batches):
        table = Table(most)
        for batch in batches:
            keep = []
            rows = zip(batch.column("sha").to_pylist(), batch.column("content").to_pylist(), batch.column("doc_id").to_pylist(),
                       batch.column("row").to_pylist(), batch.column("rows").to_pylist())
            for i, (sha, content, doc_id, row, n) in enumerate(rows):
                if not table.add(sha, content, _rank(doc_id, row), n):
                    keep.append(i)
            if keep:
                left = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [left.column(n) for n in ("row", "doc_id", "sha", "content", "rows")] + [pa.nulls(len(keep), pa.int64())] * 3,
                    ["row", "doc_id", "sha", "content", "rows", "keep_id", "keep_row", "group_size"],
                )
        for at in range(0, len(table.keys), 10_000):
            part, best = table.keys[at : at + 10_000], table.best[at : at + 10_000]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.array([sha for _, sha, _ in part], pa.binary()), pa.nulls(len(part), pa.binary()), none,
                 pa.array([None if null else doc_id for null, doc_id, _ in best], pa.int64()),
                 pa.array([row for _, _, row in best], pa.int64()), pa.array(table.size[at : at + 10_000], pa.int64())],
                ["row", "doc_id", "sha", "content", "rows", "keep_id", "keep_row", "group_size"],
            )

    digits = F.xxhash64("sha", F.lit(depth))
    return records.repartition(buckets, digits).mapInArrow(W.trimmed(run), LEFT + ", keep_id LONG, keep_row LONG, group_size LONG")


def classes(records: DataFrame, scratch: Scratch, most: int = BUCKET_BYTES) -> DataFrame:
    """(sha, keep_id, keep_row, group_size) of every distinct content of `records`."""
    out, depth = None, 0
    while True:
        total, count = records.agg(F.sum(F.octet_length("content") + 200), F.count("*")).first()
        if not count:
            return out if out is not None else records.sparkSession.createDataFrame([], CLASS)
        # Half full on average: a level seldom passes anything on.
        least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) if depth == 0 else 1
        buckets = max(least, min(count, -(-2 * total // most)))
        done = scratch.keep(level(records, depth, buckets, most), f"level-{depth}")
        found = done.filter(F.col("content").isNull()).select("sha", "keep_id", "keep_row", "group_size")
        out = found if out is None else out.unionByName(found)
        records = done.filter(F.col("content").isNotNull()).select("row", "doc_id", "sha", "content", "rows")
        depth += 1


def dedup(docs: DataFrame, most: int = BUCKET_BYTES, row: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    `row` names a column of distinct longs that stands for the row in the result; without it rows
    are numbered as they are read.
    A null text counts as empty, so all null and empty texts are one group. Of equal texts the
    row with the smallest doc_id stays, a null doc_id being larger than any; of repeated rows
    with that doc_id exactly one is kept. Other columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(prepare(docs, row), "rows")
    records = rows.filter(F.col("content").isNotNull()).select("row", "doc_id", "sha", "content", "rows")
    groups = classes(records, scratch, most)
    # A group can be a third of all rows: the join is by a unique right side, which adaptive
    # execution may split on the left.
    joined = rows.select("row", "doc_id", "sha").join(groups, "sha")
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row"
    )
