"""Operating figures from the history and the event flow."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from changesync.schema import DISCARDED, ECHO, FAILED
from changesync.storage import KeyedTable, Scratch

# What a source system may publish.
EVENTS_PER_5_MINUTES = 5_000
EVENTS_PER_HOUR = 50_000


def rates(history: DataFrame) -> DataFrame:
    """Per map: attempts and how many were echoes, lost conflicts and failures."""
    def count(outcome):
        return F.count_if(F.col("outcome") == outcome)

    return history.groupBy("map_name").agg(
        F.count("*").alias("attempts"), count(ECHO).alias("echoes"), count(DISCARDED).alias("conflicts"),
        count(FAILED).alias("failures"),
    ).withColumns({
        "echo_rate": F.round(F.col("echoes") / F.col("attempts"), 6),
        "conflict_rate": F.round(F.col("conflicts") / F.col("attempts"), 6),
    })


def latency(history: DataFrame) -> DataFrame:
    """Per map and outcome: milliseconds from the change to its processing."""
    spent = F.unix_millis("processed_at") - F.unix_millis("occurred_at")
    return history.withColumn("_ms", spent).groupBy("map_name", "outcome").agg(
        F.count("*").alias("entries"), F.min("_ms").alias("min_ms"), F.max("_ms").alias("max_ms"), F.sum("_ms").alias("sum_ms"),
    )


def dead_letters(dead: DataFrame) -> DataFrame:
    """Depth of the dead letters per map and source: letters, distinct records, the oldest change."""
    return dead.groupBy("map_name", "source_system").agg(
        F.count("*").alias("letters"), F.count_distinct("entity_name", "source_record_id").alias("records"), F.min("occurred_at").alias("oldest"),
    )


# At this size the rank error of a quantile is about 0.13 percent of the entries (2.296 / k^0.9021).
SKETCH_K = 4_000

LATENCY_SKETCH = "map_name STRING, day DATE, entries BIGINT, sketch BINARY"


def latency_sketches(history: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Per map and day of processing: entries with a latency, and a mergeable sketch of their milliseconds
    from the change to its processing. Built by partial sketches, so no group is gathered."""
    spent = F.unix_millis("processed_at") - F.unix_millis("occurred_at")
    timed = history.select("map_name", F.to_date("processed_at").alias("day"), spent.alias("_ms")).filter("_ms IS NOT NULL")
    return timed.groupBy("map_name", "day").agg(F.count("*").alias("entries"), F.kll_sketch_agg_bigint("_ms", k).alias("sketch"))


def merge_latency(sketches: DataFrame, *by: str, k: int = SKETCH_K) -> DataFrame:
    """Sketches of the same `by` columns as one."""
    return sketches.groupBy(*by).agg(F.sum("entries").alias("entries"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def latency_quantiles(sketches: DataFrame, ranks: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per map: entries, days and the latency at each of `ranks` within the sketch's error, from stored
    sketches; the history is not read."""
    merged = merge_latency(sketches, "map_name").join(sketches.groupBy("map_name").agg(F.count_distinct("day").alias("days")), "map_name")
    named = {f"p{100 * r:g}_ms".replace(".", "_"): F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r))) for r in ranks}
    return merged.withColumns(named).drop("sketch")


def store_latency(table: KeyedTable, history: DataFrame, batch_id: int) -> None:
    """Add a batch's history to the stored sketches (a table of LATENCY_SKETCH by map and day). Only the buckets of
    its maps and days are written; a repeated batch starts from the state before it and writes the same again."""
    scratch = Scratch(table.spark)
    try:
        new = scratch.keep(latency_sketches(history), "latency")
        table.update(new, batch_id, lambda old: merge_latency(old.unionByName(new), "map_name", "day"))
    finally:
        scratch.delete()


def throughput(events: DataFrame, width: str, limit: int, ts: str = "enqueued_at") -> DataFrame:
    """Events per system and tumbling window against the publishing limit."""
    counted = events.groupBy("source_system", F.window(ts, width).alias("w")).agg(F.count("*").alias("events"))
    return counted.select(
        "source_system", F.col("w.start").alias("window_start"), "events", (F.col("events") > limit).alias("over_limit")
    )
