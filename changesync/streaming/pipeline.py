"""The live flow: payload stream → change log and quarantine; change log → batches into the target.

The two queries share nothing but the log, so each restarts where its own checkpoint stands.
"""

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from changesync.operators import dedupe, history as log, metrics, prefix, route, targets, xref as links
from changesync.plans.sync import CODEC, SyncConfig, sync_batch
from changesync.sources import ingest
from changesync.schema import BUS_COLUMNS, CHANGE_EVENT, EVENT_COLUMNS, TARGET_ROW, XREF_ROW
from changesync.storage import KeyedTable, Published, Scratch, append_partitioned, freeing_shuffles


@dataclass
class SyncTables:
    """Where a running sync keeps its state. All paths are on shared storage."""

    xref: str
    target: str
    history: str
    dead_letters: str
    buckets: int = 64  # of the link, target and index tables, when they are first written
    key_index: str | None = None  # where the integration-key index of the target is kept up; without it, it is built in each batch
    latency: str | None = None  # where latency sketches per map and day are kept up

    def links(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.xref, XREF_ROW, ["lookup_key"], self.buckets)

    def records(self, spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, self.target, TARGET_ROW, ["system", "entity_name", "record_id"], self.buckets)

    def entries(self, spark: SparkSession, keys: str) -> KeyedTable | None:
        return KeyedTable(spark, f"{self.key_index}/{keys}", targets.KEY_ENTRY, ["probe_key"], self.buckets) if self.key_index else None

    def latencies(self, spark: SparkSession) -> KeyedTable | None:
        return KeyedTable(spark, self.latency, metrics.LATENCY_SKETCH, ["map_name", "day"], self.buckets) if self.latency else None


def key_definitions(active: DataFrame, config: SyncConfig) -> str:
    """A name for what the entries of a target depend on: the integration keys of the active maps, and the upsert modes."""
    wanted = ("map_name", "target_system", "target_entity", "integration_key")
    maps = sorted(json.dumps([r[c] for c in wanted]) for r in active.select(*wanted).collect())  # a bounded read of configuration
    return hashlib.sha256(json.dumps([maps, sorted(config.systems.items())]).encode()).hexdigest()[:16]


# Sequence numbers that a batch of payloads may use.
BATCH_BITS = 40

CHANGE_LOG = f"{CHANGE_EVENT}, {BUS_COLUMNS}, session_id STRING, message_id STRING"


def publish_changes(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Parsed payloads → enveloped change events; `keep` names the bus columns."""
    return dedupe.envelope(ingest.accepted(parsed, *keep))


def ingest_stream(
    raw: DataFrame, parsers: Sequence[ingest.PayloadParser], change_log: str, quarantine: str, checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Start the ingestion of `raw` (see `ingest.read_raw`): what a parser reads goes to the change log,
    the rest to the quarantine, each payload to exactly one of them.

    Events are numbered in the order of batch, file and line. A batch that was published whole is
    not published again; one that was cut off replaces what it had written. A change log belongs to its
    checkpoint: with another one the query fails rather than publish payloads twice or skip some.
    """
    spark, bus = raw.sparkSession, ["arrival_seq", "enqueued_at", "delivery_count"]

    def run(batch: DataFrame, batch_id: int) -> None:
        done = Published(spark, change_log, checkpoint)
        if done.has(batch_id):
            return
        scratch = Scratch(spark)
        try:
            stamped = batch.withColumns({"enqueued_at": F.current_timestamp(), "delivery_count": F.lit(1)})
            parsed = scratch.keep(prefix.with_parts(ingest.parse_events(stamped, parsers)), "parsed")
            parsed = prefix.numbered(parsed, "arrival_seq", batch_id << BATCH_BITS)
            append_partitioned(ingest.quarantine(parsed, *bus), quarantine, batch_id)
            append_partitioned(publish_changes(parsed, bus), change_log, batch_id)
            done.add(batch_id)
        finally:
            scratch.delete()

    writer = raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_changes(spark: SparkSession, change_log: str) -> DataFrame:
    """The change log as a stream, for `sync_stream`."""
    return spark.readStream.schema(CHANGE_LOG).option("ignoreMissingFiles", "true").parquet(change_log)


def sync_stream(
    changes: DataFrame, maps: Callable[[], DataFrame], users: DataFrame, tables: SyncTables, config: SyncConfig,
    checkpoint: str, available_now: bool = False,
) -> StreamingQuery:
    """Start the sync. Maps are read anew for every batch, so an edit takes effect on the next.

    One writer per batch; batch `n` reads the state left by the newest batch before it and
    writes version `n`, so a batch that runs again writes the same. It rewrites the buckets of the
    links and records it changes; the others pass into the new version as they lie. A batch without events, as
    a stream makes to let its duplicate window run out, writes nothing.

    A batch is written before anything is done with it. A stateful query plans its batches without
    adaptive execution; what follows reads the written events in the caller's session, where partitions
    are sized by what is in them. Message ids end with duplicate detection, and every table and shuffle of a batch is
    deleted when it was read for the last time.

    With `tables.key_index` the index entries of the records a batch writes are brought up to date, and no batch scans the
    target. They are built from the target when there are none yet for the maps as they are now, or
    when batches ran without them.
    """
    spark = changes.sparkSession
    xref, target, latencies = tables.links(spark), tables.records(spark), tables.latencies(spark)
    key = ("target_system", "target_entity", "record_id")

    def stored_entries(active: DataFrame, batch_id: int) -> KeyedTable | None:
        stored = tables.entries(spark, key_definitions(active, config))
        start = target.older(batch_id)
        if stored and start is not None and stored.older(batch_id) != start:
            stored.write(targets.key_entries(target.before(batch_id), active, config.systems), start)
        return stored

    def run(batch: DataFrame, batch_id: int) -> None:
        with Scratch(spark, CODEC) as landing, freeing_shuffles(spark):
            events = landing.keep(batch.select(*EVENT_COLUMNS), "events")
            if events.limit(1).count():
                apply(events, batch_id, landing)

    def apply(batch: DataFrame, batch_id: int, landing: Scratch) -> None:
        old_links, old_target, documents = xref.before(batch_id + 1), target.before(batch_id + 1), maps()
        active = route.active_maps(documents)
        index = stored_entries(active, batch_id + 1)
        entries = index.before(batch_id + 1) if index else None
        result = sync_batch(batch, documents, old_links, old_target, users, config, entries=entries, keep_rows=True, landing=landing)
        try:
            append_partitioned(log.to_append(result.history), tables.history, batch_id, "map_partition")
            append_partitioned(result.dead_letters(), tables.dead_letters, batch_id)
            if latencies:
                metrics.store_latency(latencies, result.history, batch_id + 1)
            writes = result.scratch.keep(targets.net_writes(result.writes), "writes")
            if index:
                touched = target.before_of(writes, batch_id + 1, key)
                moved = result.scratch.keep(targets.entry_changes(touched, writes, active, config.systems), "entries")
                index.update(moved, batch_id + 1, lambda old: targets.apply_entries(old, moved))
            target.update(writes, batch_id + 1, lambda old: targets.apply_writes(old, writes), key)
            saves = result.scratch.keep(result.link_updates, "saves")
            xref.update(links.mirrors(saves), batch_id + 1, lambda old: links.save(old, saves, "save_order"))
        finally:
            result.close()

    messages = dedupe.drop_stream_duplicates(changes.select(*EVENT_COLUMNS, "message_id"))
    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
