"""Token-id files: Parquet list columns with controlled row groups, pages and encodings.

One row is one document: `doc_id`, `file` (number of the file), `start` (ids of the documents
before it in the same file), `n_tokens`, `ids`. Rows ascend by doc_id within a file and from
file to file. Ids are dictionary-encoded (a tokenizer has few thousand distinct ids per page),
the other columns are delta-encoded; small pages with column and offset indexes let a reader
skip to a few documents, and the metadata columns are read without any ids.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from changesync.llm import tokens as T, words as W

LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",  # delta encodings where no dictionary pays
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}

SCHEMA = "doc_id LONG, file INT, start LONG, n_tokens LONG, ids ARRAY<INT>"


def encode(docs: DataFrame, tokenizer: str, end_id: int, *order: str | Column) -> DataFrame:
    """Rows of a token file; `docs` must already lie in file order."""

    def run(batches):
        file, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in W.slices(batch):
                ids, offsets = T.with_end(*T.encoder(tokenizer).ids(part.column("text")), end_id)
                sizes = np.diff(offsets)
                starts = start + offsets[:-1]
                start += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(sizes), file, np.int32)), pa.array(starts), pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    ["doc_id", "file", "start", "n_tokens", "ids"],
                )

    return docs.mapInArrow(W.trimmed(run), SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, layout: dict[str, str] = LAYOUT) -> None:
    """Write the ids of every whole text of `docs` (doc_id, text), the end id after each.

    A null or empty text is its end id alone. Null doc_ids come first, equal doc_ids in the
    order of their texts; repeated rows are all written. Other columns are not looked at. An
    empty table gives an empty folder of the same schema.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encode(ranged, tokenizer, end_id).write.options(**layout).mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files. Select `doc_id`, `n_tokens` alone to read no ids, or filter on
    doc_id to read the pages of a few documents."""
    return spark.read.schema(SCHEMA).parquet(path)


def global_starts(rows: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """`rows` with `start` counted from the first id of the first file. One row per file is
    summed along the files; that needs the metadata columns only, and reads no ids if `read` has
    the rows as they lie in the files (`read_tokens`), where `rows` are made from ids."""
    files = (rows if read is None else read).groupBy("file").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    joined = rows.join(first, "file")
    return joined.withColumn("start", F.col("start") + F.col("_first")).drop("_first")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, file, start, n_tokens, ids_crc32) from the ids of the files."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).view(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)),
                 pa.array(T.crc(ids, ends[:-1], ends[1:]), pa.int64())],
                ["doc_id", "file", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id LONG, file INT, start LONG, n_tokens LONG, ids_crc32 LONG")
