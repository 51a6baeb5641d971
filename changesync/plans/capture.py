"""Change capture by comparing snapshots: creates, updates and deletes of a source without a change log.

A snapshot holds one narrow row per record, the hash of its body, so a pull is compared with the one
before without keeping old bodies, and records that did not change make no event.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.values import payload_hash
from changesync.sources import pull
from changesync.storage import Scratch

# `record_key` is the id in lower case.
SNAPSHOT = "record_key STRING, source_record_id STRING, record_hash STRING, company STRING"


@dataclass
class Capture:
    events: DataFrame
    snapshot: DataFrame
    scratch: Scratch

    def publish(self, publish: Callable[[DataFrame], None], save: Callable[[DataFrame], None]) -> None:
        """Hand the events on, and only then the new snapshot: a failure in between captures the
        same changes again and never skips one."""
        try:
            publish(self.events)
            save(self.snapshot)
        finally:
            self.close()

    def close(self) -> None:
        self.scratch.delete()


def capture(table: DataFrame, entity: pull.Entity, previous: DataFrame, pulled_at: Column) -> Capture:
    """Changes of the whole `table` since `previous` (a SNAPSHOT, empty at first), and the new snapshot.

    A record that the snapshot before does not have is a Create, one with another hash an Update, one that is
    gone a Delete at `pulled_at` with an empty body and the company it was last seen with. Ids are compared
    without regard to case. A table that names a record more than once gives its newest row, of equally new
    ones the one with the greatest hash. The table is pulled once and kept: events and snapshot come from
    the same rows. Only hashes are shuffled to compare; bodies are joined back for changed records.
    """
    scratch = Scratch(table.sparkSession)
    rows = pull.pull_changes(table, entity, pulled_at).withColumns(
        {"record_key": F.lower("source_record_id"), "record_hash": payload_hash("data")}
    )
    pulled = scratch.keep(rows, "pulled")
    newest = F.struct("occurred_at", "record_hash", "source_record_id", "company")
    now = scratch.keep(
        pulled.groupBy("record_key").agg(F.max(newest).alias("n")).select("record_key", "n.source_record_id", "n.record_hash", "n.company", F.col("n.occurred_at").alias("_at")),
        "snapshot",
    )
    old = previous.select("record_key", F.col("source_record_id").alias("old_id"), F.col("record_hash").alias("old_hash"), F.col("company").alias("old_company"))
    compared = now.join(old, "record_key", "full_outer").filter(~F.col("record_hash").eqNullSafe(F.col("old_hash")))
    changed = scratch.keep(compared.drop("company"), "changed")

    body = ["record_key", "record_hash", "source_record_id", "occurred_at"]
    alive = changed.filter("record_hash IS NOT NULL").select(
        "record_key", "record_hash", "source_record_id", F.col("_at").alias("occurred_at"), F.col("old_hash").isNull().alias("_new")
    )
    # Rows that agree in all of these columns and the body are repetitions of one another.
    bodies = pulled.join(alive, body).dropDuplicates(["record_key"])
    events = bodies.withColumn("operation", F.when(F.col("_new"), F.lit("Create")).otherwise(F.lit("Update")))
    gone = changed.filter("record_hash IS NULL").select(
        F.lit(entity.system).alias("source_system"), F.lit(entity.name).alias("entity_name"), F.col("old_id").alias("source_record_id"),
        F.lit("Delete").alias("operation"), pulled_at.alias("occurred_at"), F.col("old_company").alias("company"),
        F.expr("CAST(map() AS MAP<STRING,STRING>)").alias("data"), F.lit(None).cast("string").alias("originating_user_id"),
        F.md5(F.concat_ws("|", F.lit(entity.name), "old_id", pulled_at.cast("string"))).alias("correlation_id"),
    )
    return Capture(events.select(*gone.columns).unionByName(gone), now.drop("_at"), scratch)
