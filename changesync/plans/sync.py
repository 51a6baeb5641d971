"""A batch of change events through every map to target writes, link state and history.

    route → company filter → link → identity echo → field mapping → target resolution
    → one key per link → verdicts → outcomes → history, writes, links, failures

The same function serves a batch job and `foreachBatch`.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from changesync.functions.keys import idempotency_key
from changesync.functions.transforms import Transforms
from changesync.functions.values import payload_hash
from changesync.operators import echo, mapping, ownership, prefix, resolve, route, targets, xref as links
from changesync.schema import CREATED, DELETED, EVENT_COLUMNS, FAILED, UPDATED
from changesync.storage import Scratch, freeing_shuffles


@dataclass
class SyncConfig:
    """`systems`: registered systems by name, each with its upsert mode."""

    systems: dict[str, str]
    transforms: Transforms = field(default_factory=Transforms)
    bucket_rows: int = prefix.BUCKET_ROWS
    fold_rows: int = resolve.FOLD_ROWS
    slice_rows: int = prefix.SLICE_ROWS
    content_echo: bool = True


@dataclass
class SyncResult:
    rows: DataFrame
    history: DataFrame
    writes: DataFrame
    link_updates: DataFrame
    failures: DataFrame
    scratch: Scratch

    def persist(self) -> "SyncResult":
        """Keep the outcome rows on disk while several results are read; call `close` after."""
        self.rows.persist(StorageLevel.DISK_ONLY)
        return self

    def dead_letters(self) -> DataFrame:
        """Failed attempts: the whole event as it came, the map it failed in and the whole reason."""
        return self.failures.select(*EVENT_COLUMNS, "map_name", "error")

    def close(self) -> None:
        """Free what the batch left behind. Its results cannot be read any more."""
        self.rows.unpersist()
        self.scratch.delete()


def route_and_map(
    events: DataFrame, maps: DataFrame, users: DataFrame, config: SyncConfig,
    compiled: mapping.CompiledMaps | None = None,
) -> DataFrame:
    """One row per event and admitted map, with its mapped body."""
    routed = route.company_filter(route.route_events(events, maps))
    if compiled is not None:
        routed = routed.drop("fields")
    flagged = echo.flag_identity_echo(routed, users)
    mapped = mapping.map_fields(flagged, transforms=config.transforms) if compiled is None else compiled.map_fields(flagged)
    known = F.lower("target_system").isin([s.lower() for s in config.systems])
    unknown = F.when(~known, F.concat(F.lit("no system registered as '"), F.col("target_system"), F.lit("'")))
    return mapped.withColumn("system_error", unknown).drop("companies", "fields")


# Several wide tables of a batch lie side by side until it is done.
CODEC = "zstd"

# What decides about a row, apart from its body and the wide rest of it.
OWN = [
    "_at", *resolve.ORDER, "pair_key", "source_system", "source_record_id", "target_system", "target_entity", "operation", "occurred_at",
    "identity_echo", "system_error", "map_error", "key_error", "upsert_mode",
]
FACTS = ["_row", *OWN, "link", "link_target_id", "resolved_id", "target_exists"]
DECIDED = ["_at", "link_key", "counterpart", "link", "target_exists", "verdict", "has_link", "error", "outcome"]
# What `outcomes` needs besides, and what the results of a batch read.
SETTLED = [*DECIDED[:-1], *resolve.ORDER, "bucket", "target_system", "target_entity", "upsert_mode"]
KEPT = [
    *EVENT_COLUMNS, "map_name", "target_system", "target_entity", "pair_key", "integration_key", "upsert_mode", "mapped",
    "link_key", "counterpart", "link", "has_link", "error", "outcome",
]


def resolved_rows(
    events, maps, xref, target, users, config: SyncConfig, scratch: Scratch, entries: DataFrame | None = None, landing: Scratch | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per event and admitted map; its FACTS, up to the record it resolves to; the target index).
    The rows are wide and written once, with a number `_at`, before anything is looked up; all that follows works on a few columns.
    Several facts may share a wide row, where its key has several links: each has a `_row` of its own."""
    active = route.active_maps(maps)
    compiled = mapping.CompiledMaps.load(active, config.transforms)
    mapped = route_and_map(events, maps, users, config, compiled)
    keyed = targets.with_key_segment(targets.with_mode(mapped, config.systems), compiled)
    index = targets.index_of(targets.key_entries(target, active, config.systems) if entries is None else entries)
    wide = scratch.keep(keyed.withColumn("_at", F.monotonically_increasing_id()), "routed")
    if landing:
        landing.delete()
    linked = scratch.keep(links.lookup(wide.select(*OWN, "key_segment"), xref), "linked")
    resolved = targets.resolve_targets(linked, index).withColumn("_row", F.monotonically_increasing_id())
    resolved = scratch.keep(resolved.select(*FACTS), "resolved")
    scratch.free(linked)
    return wide, resolved, index


def decide(wide: DataFrame, resolved: DataFrame, index: DataFrame, config: SyncConfig, scratch: Scratch) -> DataFrame:
    """The DECIDED columns of every resolved row, written. `resolved` and what lies between goes as soon as the next table is there."""
    def verdicts(rows, scratch):
        return resolve.verdicts(rows, scratch, config.fold_rows, config.content_echo, wide, config.slice_rows)

    spark = resolved.sparkSession
    facts = prefix.with_bucket(resolved, rows=config.bucket_rows)
    with Scratch(spark, CODEC) as step:
        owned = scratch.keep(ownership.with_links(facts, index, verdicts, step), "owned")
    scratch.free(resolved)
    sides = F.struct("link.system_a", "link.record_id_a", "link.system_b", "link.record_id_b")  # its state has done its part
    with Scratch(spark, CODEC) as step:
        settled = owned.withColumn("link", F.when(F.col("link").isNotNull(), sides)).join(verdicts(owned, step), "_row")
        settled = scratch.keep(settled.select(*SETTLED), "settled")
    scratch.free(owned)
    decided = scratch.keep(resolve.outcomes(settled).select(*DECIDED), "decided")
    scratch.free(settled)
    return decided


def kept_rows(wide: DataFrame, decided: DataFrame, config: SyncConfig, scratch: Scratch) -> DataFrame:
    """The outcome rows, written a slice at a time, as far as the results of a batch read them."""
    bodies = {
        "data": F.when(F.col("outcome") == FAILED, F.col("data")),
        "mapped": F.when(F.col("outcome").isin(CREATED, UPDATED, DELETED), F.col("mapped")),
    }
    parts = [
        scratch.keep(wide.filter(s).drop("key_error").join(decided.filter(s), "_at").withColumns(bodies).select(*KEPT), "rows")
        for s in prefix.slices(wide, "_at", config.slice_rows)
    ]
    return reduce(DataFrame.unionByName, parts)


def history_rows(rows: DataFrame, processed_at) -> DataFrame:
    """One history row per attempt and map."""
    known = F.when(F.col("outcome").isin(CREATED, UPDATED), F.col("counterpart")).when(
        F.col("has_link") & (F.col("outcome") != FAILED), F.col("counterpart")
    )
    return rows.select(
        "map_name", processed_at.alias("processed_at"), "outcome", "operation", "source_system", "source_record_id",
        "target_system", known.alias("target_record_id"), "company", "occurred_at",
        "error", "delivery_count", "correlation_id",
    )


def write_plan(rows: DataFrame) -> DataFrame:
    """The write commands, one per accepted row, in write order. Where the key addresses the
    record, an update leaves the key fields alone and a create names the company."""
    by_key = F.col("upsert_mode") == targets.BY_KEY
    body = F.when(by_key & (F.col("outcome") == UPDATED), targets.update_body()).when(
        by_key & (F.col("outcome") == CREATED), targets.create_body()
    ).otherwise(F.col("mapped"))
    return rows.filter(F.col("outcome").isin(CREATED, UPDATED, DELETED)).select(
        "target_system", "target_entity",
        F.col("counterpart").alias("record_id"),
        "operation", body.alias("fields"), "integration_key", "company",
        idempotency_key().alias("idempotency_key"), "correlation_id", "outcome",
        F.struct(*resolve.ORDER).alias("write_order"),
    )


def state_after_write():
    """Link state after a row: the hash of what was written, or a tombstone."""
    gone = F.col("outcome") == DELETED
    return F.struct(
        F.col("target_system").alias("written_to_system"),
        F.when(gone, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array_sort(F.map_keys("mapped"))).alias("written_fields"),
        F.when(gone, F.lit("")).otherwise(payload_hash("mapped")).alias("written_payload_hash"),
        F.col("source_system").alias("last_writer_system"),
        F.col("occurred_at").alias("last_writer_at"),
    )


def link_updates(rows: DataFrame) -> DataFrame:
    """The links a batch changed, one row each with its last state. A delete without a link
    leaves none."""
    wrote = rows.filter(F.col("outcome").isin(CREATED, UPDATED) | ((F.col("outcome") == DELETED) & F.col("has_link")))
    order = F.struct(*resolve.ORDER)
    sides = F.struct("link.system_a", "link.record_id_a", "link.system_b", "link.record_id_b")
    born = F.struct(
        F.col("source_system").alias("system_a"), F.col("source_record_id").alias("record_id_a"),
        F.col("target_system").alias("system_b"), F.col("counterpart").alias("record_id_b"),
    )
    per_link = wrote.groupBy("link_key").agg(
        F.min_by(F.struct("pair_key", F.when(F.col("link").isNotNull(), sides).otherwise(born).alias("s")), order).alias("first"),
        F.max_by(state_after_write(), order).alias("state"),
        F.max(order).alias("save_order"),
    )
    return per_link.select("first.pair_key", "first.s.*", "state", "save_order")


def sync_batch(
    events, maps, xref, target, users, config: SyncConfig, processed_at=None, entries: DataFrame | None = None, keep_rows: bool = False,
    landing: Scratch | None = None,
) -> SyncResult:
    """Run one batch. `events` carry CHANGE_EVENT and bus columns; `xref`, `target`, `users`
    are the tables laid out in `schema`. With `entries`, the stored index entries of the target
    (`targets.key_entries`), the target itself is not read. Only intermediate tables are written; the result holds what to
    write, and `close` removes them. `keep_rows` makes the outcome rows one of them, for callers that read several results: what these
    read, with the event's body where it failed and the mapped one where it is written. Tables and shuffles go when their last reader
    is written, and so does `landing`, a scratch that nothing but `events` needs."""
    scratch = Scratch(events.sparkSession, CODEC)
    with freeing_shuffles(events.sparkSession):
        wide, resolved, index = resolved_rows(events, maps, xref, target, users, config, scratch, entries, landing)
        decided = decide(wide, resolved, index, config, scratch)
        rows = wide.drop("key_error").join(decided, "_at").drop("_at")
        if keep_rows:
            rows = kept_rows(wide, decided, config, scratch)
            scratch.free(wide, decided)
    stamp = F.current_timestamp() if processed_at is None else processed_at
    failures = rows.filter(F.col("outcome") == FAILED).drop("link", "mapped")
    return SyncResult(rows, history_rows(rows, stamp), write_plan(rows), link_updates(rows), failures, scratch)


def apply_result(result: SyncResult, xref: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link table, target) after a batch."""
    new_target = targets.apply_writes(target, targets.net_writes(result.writes))
    return links.save(xref, result.link_updates, "save_order"), new_target.drop("created", "written")
