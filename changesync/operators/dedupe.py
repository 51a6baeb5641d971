"""Publishing and duplicate detection."""

from pyspark.sql import DataFrame, functions as F

from changesync.functions.keys import message_id, session_id

# The bus remembers message ids for this long.
DUPLICATE_WINDOW = "10 minutes"


def envelope(events: DataFrame) -> DataFrame:
    """Add `session_id` (order per record) and `message_id` (same event, same id)."""
    return events.withColumns({"session_id": session_id(), "message_id": message_id()})


def first_of_duplicates(messages: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """First arrival of each message id. One row per id and task is shuffled, so an id that
    repeats endlessly costs no single task."""
    row = F.struct(*messages.columns)
    return messages.groupBy(F.col("message_id").alias("_id")).agg(F.min_by(row, order).alias("m")).select("m.*")


def drop_stream_duplicates(messages: DataFrame, window: str = DUPLICATE_WINDOW) -> DataFrame:
    """Streaming form: ids are remembered for the window, by arrival time at the bus and not
    by change time, so a late change is never lost here."""
    return messages.withWatermark("enqueued_at", window).dropDuplicatesWithinWatermark(["message_id"])
