"""Sums of fixed-size arrays that every task fills, along a tree of tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES, BRANCHES = 32, 16


def tree_sum(parts: DataFrame, dtype: str, combine=np.add) -> np.ndarray | None:
    """The sum (or what `combine` makes) of the one binary column of `parts`, each an array of
    `dtype` of one size. None if there are no rows.

    Arrays are cut into pieces, and those of one place are combined, first along branches: a task holds a piece
    or two at a time, and the driver gets one array, whatever the number of tasks."""
    step = F.ceil(F.octet_length("array") / (8 * PIECES)).cast("int") * 8  # whole elements
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("array"), i * step + 1, step))
    found = parts.toDF("array").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(BRANCHES)))
    found = found.select("branch", F.posexplode(cut).alias("place", "piece")).filter(F.octet_length("piece") > 0)

    def both(key, table):
        total = None
        for value in table.column("piece"):
            piece = np.frombuffer(value.as_buffer(), dtype)
            total = piece if total is None else combine(total, piece)
        return pa.table({"place": pa.array([key[-1].as_py()], pa.int32()), "piece": pa.array([total.tobytes()], pa.binary())})

    for keys in (["branch", "place"], ["place"]):
        found = found.groupBy(*keys).applyInArrow(both, "place INT, piece BINARY")
    pieces = sorted((r["place"], bytes(r["piece"])) for r in found.collect())
    return np.frombuffer(b"".join(p for _, p in pieces), dtype) if pieces else None
