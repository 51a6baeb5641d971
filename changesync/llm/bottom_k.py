"""Document fingerprints: the k smallest hashes of a text's distinct word shingles.

A fingerprint is a base64 string of ascending big-endian 64-bit hashes, so equal texts have
equal fingerprints. Fingerprints of parts merge into that of the whole (a union cut to k); a
pair gives estimates of resemblance and containment, one gives the number of distinct
shingles. Fewer than k hashes are the whole set, and then the estimates are exact.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from changesync.llm import words as W

K = 128
WIDTH = 5
_SPAN = 2.0**64


def sketches(texts: pa.Array, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text: at most k distinct hashes, ascending. Words are compared
    without the case of A-Z. A text of fewer than `width` words has one shingle, its whole
    sequence; a null text or one without words has none."""
    row, value = W.shingles(W.split(texts), width)
    found, offsets = W.distinct_per_row(row, value, len(texts))
    return [found[a : min(a + k, b)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) * _SPAN / float(sketch[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: of the k smallest hashes of the union, the share in both.
    Two empty sets are alike."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    if not same.any():
        return 0.0
    distinct = both[np.concatenate([[True], ~same])]
    last = distinct[min(k, len(distinct)) - 1]
    return float((both[1:][same] <= last).sum()) / min(k, len(distinct))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, j * union / distinct_count(a, k))


def fingerprint(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) of every row of `docs` (doc_id, text): null texts are
    empty and have the empty fingerprint, other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                found = sketches(part.column("text"), k, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([pack(s) for s in found], pa.string()), pa.array([distinct_count(s, k) for s in found])],
                    ["doc_id", "fingerprint", "n_shingles"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id LONG, fingerprint STRING, n_shingles DOUBLE")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint per `key` from those of its parts (key, fingerprint). The hashes are
    combined by built-in aggregation in two steps, a salt keeping a hot key from one task."""
    hashes = parts.select(key, "fingerprint", F.pmod(F.xxhash64("fingerprint"), F.lit(64)).alias("_salt"))

    def union(table: pa.Table) -> np.ndarray:
        out = np.empty(0, np.uint64)
        for f in table.column("fingerprint").to_pylist():
            out = merge(out, unpack(f or ""), k)
        return out

    def run(group, table):
        return pa.table({key: pa.array([group[0].as_py()], table.column(key).type), "fingerprint": [pack(union(table))]})

    schema = f"{key} {dict(parts.dtypes)[key]}, fingerprint STRING"
    return hashes.groupBy(key, "_salt").applyInArrow(run, schema).groupBy(key).applyInArrow(run, schema)


def _chain(docs: DataFrame, partitions: int) -> DataFrame:
    """Every row in the range of its doc_id, plus one guest row per range: the row that follows
    its last one. `bucket` numbers the ranges, `guest` marks the copies."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / partitions for i in range(1, partitions)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if partitions > 1 else []
    # Ranges descend with the doc_id: bucket 0 has the largest.
    def bucket(column):
        below = F.lit(0)
        if cuts:
            below = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c >= column))
        return below.cast("int")

    ranged = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("bucket", bucket(F.col("_id")))
    heads = {r["bucket"]: r["top"] for r in ranged.groupBy("bucket").agg(F.max("_id").alias("top")).collect()}  # one row per range
    full = sorted(heads)
    into = spark.createDataFrame(
        [(heads[b], full[i - 1]) for i, b in enumerate(full)], "_id LONG, target INT"
    )  # the head of each range also ends the one before, that of the first the last
    guests = ranged.join(F.broadcast(into), "_id").select("doc_id", "text", "_id", F.col("target").alias("bucket"), F.lit(True).alias("guest"))
    return ranged.select("doc_id", "text", "_id", "bucket", F.lit(False).alias("guest")).unionByName(guests)


def against_next(docs: DataFrame, k: int = K, width: int = WIDTH, partitions: int | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text, and the likeness of the two and of the
    next document in descending doc_id (after the last: the first).

    The edited text has the last third of the code points (rounded down) replaced by as many
    first ones, or all, of the next document. Rows with equal doc_ids follow in the order of
    their texts; null doc_ids come last; a single row is its own next. Null texts are empty.
    Texts move once, dealt by ranges of doc_id; each range also gets the row that follows it.
    """
    spark: SparkSession = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if source.isEmpty():
        return spark.createDataFrame([], FINGERPRINT)
    dealt = _chain(source, n).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("_id"), "text")

    def run(batches):
        held = None  # the last row, whose next is not known yet
        closed = None  # the range whose guest was seen
        for batch in batches:
            for part in W.slices(batch):
                rows = part.to_pylist()
                own = sketches(part.column("text"), k, width)
                pairs = []
                for row, sketch in zip(rows, own):
                    if closed == row["bucket"]:
                        continue  # further guests: rows with the same doc_id
                    if held is not None:
                        pairs.append((held, (row, sketch)))
                    held = (row, sketch)
                    if row["guest"]:
                        held, closed = None, row["bucket"]
                if pairs:
                    yield _compare(pairs, k, width)

    return dealt.mapInArrow(run, FINGERPRINT)


FINGERPRINT = (
    "doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


def _compare(pairs: list, k: int, width: int) -> pa.RecordBatch:
    edited = []
    for (row, _), (following, _) in pairs:
        third = len(row["text"]) // 3
        edited.append(row["text"][: len(row["text"]) - third] + following["text"][:third])
    marks = sketches(pa.array(edited, pa.large_string()), k, width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["doc_id"] for (row, _), _ in pairs], pa.int64()),
            pa.array([len(row["text"]) for (row, _), _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([pack(own) for (_, own), _ in pairs], pa.string()),
            pa.array([pack(m) for m in marks], pa.string()),
            pa.array([resemblance(own, m, k) for ((_, own), _), m in zip(pairs, marks)]),
            pa.array([resemblance(own, other, k) for (_, own), (_, other) in pairs]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
