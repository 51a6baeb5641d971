"""Events to the maps that want them."""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.keys import pair_key

ACTIVE = "Active"

MAP_COLUMNS = ("map_name", "target_system", "target_entity", "pair_key", "companies", "fields", "integration_key")


def active_maps(maps: DataFrame) -> DataFrame:
    """Active maps shaped for routing."""
    return maps.filter(F.lower("status") == ACTIVE.lower()).select(
        F.lower("source_system").alias("_route_system"),
        F.lower("source_entity").alias("_route_entity"),
        F.col("name").alias("map_name"),
        "target_system",
        "target_entity",
        pair_key("source_system", "source_entity", "target_system", "target_entity").alias("pair_key"),
        "companies",
        "fields",
        "integration_key",
    )


def route_events(events: DataFrame, maps: DataFrame) -> DataFrame:
    """One row per event and active map of its source; events no map wants drop out."""
    keyed = active_maps(maps)
    on = (F.lower("source_system") == F.col("_route_system")) & (F.lower("entity_name") == F.col("_route_entity"))
    return events.join(keyed, on, "inner").drop("_route_system", "_route_entity")


def passes_company(companies="companies", company="company", operation="operation") -> Column:
    """No list admits all; a listed company passes; an unknown company only for deletes,
    because a record that vanished cannot tell where it belonged."""
    listed = F.exists(F.col(companies), lambda c: F.lower(c) == F.lower(F.col(company)))
    unknown = F.col(company).isNull() & (F.col(operation) == "Delete")
    return F.coalesce(F.size(companies) <= 0, F.lit(True)) | F.coalesce(listed, F.lit(False)) | unknown


def company_filter(routed: DataFrame) -> DataFrame:
    return routed.filter(passes_company())


def with_unknown_systems(maps: DataFrame, systems: DataFrame, column: str = "target_system") -> DataFrame:
    """Maps naming a system nobody registered. `systems` has one column, `system`."""
    known = systems.select(F.lower("system").alias("_known")).distinct()
    return maps.join(known, F.lower(column) == F.col("_known"), "left_anti")
