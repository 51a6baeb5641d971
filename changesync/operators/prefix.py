"""Running aggregates over the arrival order of a key, without one task per key.

A plain window puts all rows of a key into one task, which a key holding a third of the
data would sink. Here the arrival sequence is cut at quantiles of the data into buckets of
about equally many rows, so a (key, bucket) chunk is bounded whatever the skew: windows run
inside chunks, one summary row per chunk is combined along the key, and the carried value is
joined back per chunk. A table of no more rows than a bucket holds is not cut at all.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of a bucket, which bounds the rows of one chunk; buckets beyond MAX_BUCKETS get larger.
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 1024

# Rows of a slice: what a join of wide rows shuffles at a time.
SLICE_ROWS = 3_000_000

BEFORE = (Window.unboundedPreceding, -1)


def borders(df: DataFrame, seq: str = "arrival_seq", rows: int = BUCKET_ROWS) -> list[int]:
    """First sequence numbers of the second and later buckets of about `rows` rows each."""
    buckets = min(MAX_BUCKETS, -(-df.count() // rows))
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.agg(F.percentile_approx(seq, at, 4 * buckets)).first()[0]))


def _bucket_of(seq: Column, cuts: list[int], first: int = 0) -> Column:
    """Number of cuts up to `seq`, by halving, so that a row compares a few times only."""
    if not cuts:
        return F.lit(first).cast("bigint")
    half = len(cuts) // 2
    return F.when(seq < cuts[half], _bucket_of(seq, cuts[:half], first)).otherwise(_bucket_of(seq, cuts[half + 1 :], first + half + 1))


def with_bucket(df: DataFrame, seq: str = "arrival_seq", rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `bucket`, monotone in `seq`. Reads the sequence numbers of `df` to find the borders."""
    return df.withColumn("bucket", _bucket_of(F.col(seq), borders(df, seq, rows)))


def slices(df: DataFrame, seq: str, rows: int = SLICE_ROWS) -> list[Column]:
    """Conditions that cut `seq`, which has no nulls, into stretches of about `rows` rows. A join on `seq` that is written stretch by
    stretch needs the disk for one of them; along a table that was written in this order each reads its own files only."""
    cuts = borders(df, seq, rows)
    after = [F.lit(True), *[F.col(seq) >= c for c in cuts]]
    before = [*[F.col(seq) < c for c in cuts], F.lit(True)]
    return [a & b for a, b in zip(after, before)]


def running_before(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add, per measure, its aggregate over all strictly earlier rows of the key.

    `measures` maps a new column to (`max` | `sum`, expression). Needs `bucket`, monotone in
    the first order column. A max is null, and a sum zero, where nothing came before.
    """
    fns = {"max": F.max, "sum": F.sum}
    chunk = [*keys, "bucket"]
    inside = Window.partitionBy(*chunk).orderBy(*order).rowsBetween(*BEFORE)
    along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(*BEFORE)

    totals = df.groupBy(*chunk).agg(*[fns[kind](e).alias(f"_t_{n}") for n, (kind, e) in measures.items()])
    carry = totals.select(*chunk, *[fns[kind](f"_t_{n}").over(along).alias(f"_c_{n}") for n, (kind, _) in measures.items()])
    local = df.withColumns({f"_l_{n}": fns[kind](e).over(inside) for n, (kind, e) in measures.items()})

    joined = local.join(carry, chunk, "inner")
    out = [
        (F.greatest(f"_c_{n}", f"_l_{n}") if kind == "max"
         else F.coalesce(f"_c_{n}", F.lit(0)) + F.coalesce(f"_l_{n}", F.lit(0))).alias(n)
        for n, (kind, _) in measures.items()
    ]
    return joined.select(*[joined[c] for c in df.columns], *out)


def position(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based place of each row in the arrival order of its key."""
    return running_before(df, keys, order, {"_before": ("sum", F.lit(1).cast("bigint"))}).withColumn(
        name, F.col("_before") + 1
    ).drop("_before")


def with_parts(df: DataFrame) -> DataFrame:
    """Add `_part` and `_at`, the task and the place of each row as it is written; see `numbered`."""
    return df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})


def numbered(written: DataFrame, name: str, first: int = 0) -> DataFrame:
    """`name`: first, first + 1, ... along a table that was written `with_parts`, in the order in which its
    rows lie. One row per task is summed up."""
    parts = written.groupBy("_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    shifts = parts.select("_part", (before - F.col("_low") + first).alias("_shift"))
    return written.join(shifts, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
