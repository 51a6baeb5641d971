"""A scheduled run of one map: pull the source, publish changes and deletes by absence,
move the watermark. The run never writes the target; its events go the normal way."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from changesync.functions.keys import pair_key
from changesync.operators import xref as links
from changesync.sources import pull, watermarks
from changesync.storage import Scratch

INCREMENTAL, FULL_EXPORT = "incremental", "fullExport"


@dataclass
class ScheduledRun:
    changes: DataFrame
    deletes: DataFrame | None
    watermark: DataFrame | None
    scratch: Scratch

    @property
    def events(self) -> DataFrame:
        return self.changes if self.deletes is None else self.changes.unionByName(self.deletes)

    def summary(self) -> DataFrame:
        """Published changes and deletes of the run, by map."""
        deleted = F.col("operation") == "Delete"
        return self.events.agg(F.count_if(~deleted).alias("published"), F.count_if(deleted).alias("deletes"))

    def publish(self, publish: Callable[[DataFrame], None], save: Callable[[DataFrame], None]) -> None:
        """Hand the events on, and only then the moved watermark: a failure in between pulls
        changes again and never skips one. Afterwards the run's tables are gone."""
        try:
            publish(self.events)
            if self.watermark is not None:
                save(self.watermark)
        finally:
            self.close()

    def close(self) -> None:
        """Free the pulled rows. The run's tables cannot be read any more."""
        self.scratch.delete()


def pair_of(entity_map: Row) -> Column:
    """Key of the pair of entities a map moves between."""
    return pair_key(*[F.lit(entity_map[c]) for c in ("source_system", "source_entity", "target_system", "target_entity")])


def deletes_by_absence(
    link_rows: DataFrame, live: DataFrame, pair: Column, system: str, entity: str, scheduled_for: Column
) -> DataFrame:
    """Delete events for linked records of the source that are no longer alive. Only links of
    `pair` count: the same record may be linked in other pairs, whose entities `live` does not
    know. `live` has lower-case `record_id`. Tombstones are done already; the company of a
    vanished record is unknown, and its change time is the run's."""
    known = links.links_of_pair(link_rows, pair).withColumn("source_record_id", links.record_id_in(F.lit(system)))
    known = known.filter(F.col("source_record_id").isNotNull() & ~links.is_tombstone())
    gone = known.join(live, F.lower("source_record_id") == live["record_id"], "left_anti")
    return gone.select(
        F.lit(system).alias("source_system"), F.lit(entity).alias("entity_name"), "source_record_id",
        F.lit("Delete").alias("operation"), scheduled_for.alias("occurred_at"),
        F.lit(None).cast("string").alias("company"),
        F.expr("CAST(map() AS MAP<STRING,STRING>)").alias("data"),
        F.lit(None).cast("string").alias("originating_user_id"),
        F.md5(F.concat_ws("|", F.lit(entity), "source_record_id", scheduled_for.cast("string"))).alias("correlation_id"),
    )


def scheduled_run(
    entity_map: Row, table: DataFrame, entity: pull.Entity, link_rows: DataFrame, token: str,
    scheduled_for: Column, pulled_at: Column | None = None,
) -> ScheduledRun | None:
    """`entity_map` is one ENTITY_MAP row, `token` its stored watermark, `link_rows` the whole
    link table. None when the map has lost its schedule. Incremental runs start at the token and
    save the newest change time; full exports start over and save nothing.

    The source is pulled once and kept: events and watermark come from the same rows, so what
    arrives in a live source meanwhile is left to the next run."""
    schedule = entity_map["schedule"]
    if schedule is None:
        return None
    if entity_map["source_system"].lower() != entity.system.lower():
        raise ValueError(f"map '{entity_map['name']}' pulls from system '{entity_map['source_system']}', not '{entity.system}'")
    scratch = Scratch(table.sparkSession)
    incremental = schedule["mode"].lower() == INCREMENTAL.lower()
    pulled_at = scheduled_for if pulled_at is None else pulled_at
    companies = entity_map["companies"]
    pulled = pull.pull_changes(table, entity, pulled_at, token if incremental else watermarks.START, companies)
    changes = scratch.keep(pulled, "pulled")

    deletes = None
    if schedule["detect_deletes"]:
        if not incremental and not companies:
            live = changes.select(F.lower("source_record_id").alias("record_id")).distinct()
        else:
            live = pull.live_keys(table, entity)
        deletes = deletes_by_absence(link_rows, live, pair_of(entity_map), entity.system, entity.name, scheduled_for)

    mark = None
    if incremental:
        scoped = changes.withColumns({
            "system": F.lit(entity.system), "scope": watermarks.scope_of(F.lit(entity_map["name"])),
        })
        mark = watermarks.advance(scoped, ["system", "scope"], scheduled_for)
    return ScheduledRun(changes, deletes, mark, scratch)
