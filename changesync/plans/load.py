"""Initial load and cutover: capture events, copy in bulk, then drain what was captured.
Records older than the copy lose by last-writer-wins, so the order of the two is safe."""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.values import payload_hash
from changesync.operators.xref import mirrors


def loaded_links(
    copied: DataFrame, pair_key: Column, system_a: str, system_b: str, loaded_at: Column
) -> DataFrame:
    """Link rows for bulk-copied records (`record_id_a`, `record_id_b`, `fields`, `changed_at`),
    dated by the copied record's own change time."""
    state = F.struct(
        F.lit(system_b).alias("written_to_system"),
        F.array_sort(F.map_keys("fields")).alias("written_fields"),
        payload_hash("fields").alias("written_payload_hash"),
        F.lit(system_a).alias("last_writer_system"),
        F.coalesce("changed_at", loaded_at).alias("last_writer_at"),
    )
    links = copied.select(
        pair_key.alias("pair_key"), F.lit(system_a).alias("system_a"), "record_id_a", F.lit(system_b).alias("system_b"),
        "record_id_b", state.alias("state"), F.lit(1).cast("bigint").alias("version"),
    )
    return mirrors(links)
