"""Finding the target record, and applying writes to a target snapshot.

`by_id` targets own surrogate ids and find a first match by integration key; `by_key`
targets are addressed by the key itself, so their record id is the key segment.
"""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.keys import key_segment
from changesync.functions.values import NULL, _col, json_str
from changesync.operators.mapping import CompiledMaps

BY_ID, BY_KEY = "by_id", "by_key"
COMPANY_KEY = "dataAreaId"


def key_parts(names="integration_key", fields="mapped", company=None) -> Column:
    """ARRAY<STRUCT<name, value>> of an integration key. With `company`, the company column
    stands in where the company field is not mapped."""
    fields = _col(fields)

    def part(name):
        value = F.nullif(F.try_element_at(fields, name), F.lit(NULL))
        if company is not None:
            c = _col(company)
            fallback = F.when((F.lower(name) == COMPANY_KEY.lower()) & (c != ""), json_str(c))
            value = F.coalesce(value, fallback)
        return F.struct(name.alias("name"), value.alias("value"))

    return F.transform(_col(names), part)


def key_problem(names: str, parts: Column) -> Column:
    """Why a key cannot address a record, or null."""
    missing = F.filter(parts, lambda p: p["value"].isNull())
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit("no link and no integration key in the map")).when(
        F.size(missing) > 0, F.concat(F.lit("integration key '"), F.get(missing, F.lit(0))["name"], F.lit("' has no value"))
    )


def with_mode(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Add `upsert_mode` from {system: mode}; systems not named are by_id."""
    mode = F.lit(BY_ID)
    for system, value in modes.items():
        mode = F.when(F.lower("target_system") == system.lower(), F.lit(value)).otherwise(mode)
    return df.withColumn("upsert_mode", mode)


def company_fallback(name: str) -> Column | None:
    """The company column for the company field of a by_key target."""
    if name.lower() != COMPANY_KEY.lower():
        return None
    return F.when((F.col("upsert_mode") == BY_KEY) & (F.col("company") != ""), json_str(F.col("company")))


def with_key_segment(rows: DataFrame, compiled: CompiledMaps | None = None) -> DataFrame:
    """Add `key_segment` and `key_error` (exclusive) from the mapped body."""
    if compiled is not None:
        return compiled.key_segment(rows, company_fallback)
    by_key = F.col("upsert_mode") == BY_KEY
    parts = F.when(by_key, key_parts(company="company")).otherwise(key_parts())
    out = rows.withColumn("_parts", parts)
    out = out.withColumn("key_error", F.when(F.col("map_error").isNull(), key_problem("integration_key", F.col("_parts"))))
    usable = F.col("map_error").isNull() & F.col("key_error").isNull()
    return out.withColumn("key_segment", F.when(usable, key_segment("_parts"))).drop("_parts")


KEY_ENTRY = "probe_key STRING, record_id STRING"


def key_entries(targets: DataFrame, maps: DataFrame, modes: dict[str, str]) -> DataFrame:
    """KEY_ENTRY rows: by_id records under each map's integration key, by_key records under their id."""
    wanted = with_mode(
        maps.select("map_name", "target_system", "target_entity", "integration_key"), modes
    )
    by_id = wanted.filter(F.col("upsert_mode") == BY_ID)
    on = (F.lower("system") == F.lower("target_system")) & (F.lower("entity_name") == F.lower("target_entity"))
    keyed = targets.join(by_id, on).withColumn("_parts", key_parts(fields="fields"))
    keyed = keyed.filter(key_problem("integration_key", F.col("_parts")).isNull())
    ids = keyed.select(id_probe("map_name", key_segment("_parts")).alias("probe_key"), "record_id")

    by_key_systems = [s.lower() for s, m in modes.items() if m == BY_KEY]
    direct = targets.filter(F.lower("system").isin(by_key_systems)).select(
        key_probe("system", "entity_name", "record_id").alias("probe_key"), "record_id"
    )
    return ids.unionByName(direct)


def index_of(entries: DataFrame) -> DataFrame:
    """`probe_key` → (`matches`, `match_id`)."""
    return entries.groupBy("probe_key").agg(F.count("*").alias("matches"), F.min("record_id").alias("match_id"))


def target_index(targets: DataFrame, maps: DataFrame, modes: dict[str, str]) -> DataFrame:
    """The index of a whole target snapshot."""
    return index_of(key_entries(targets, maps, modes))


def entry_changes(old: DataFrame, writes: DataFrame, maps: DataFrame, modes: dict[str, str]) -> DataFrame:
    """What net `writes` do to the entries of the records they name: KEY_ENTRY rows with `present`, those that
    stay as they are left out. `old` has at least the records that `writes` name; others are passed over."""
    named = _target_keys(writes, "target_system", "target_entity").select("_system", "_entity", "record_id")
    mine = _target_keys(old, "system", "entity_name").join(named, ["_system", "_entity", "record_id"], "left_semi").drop("_system", "_entity")
    gone = key_entries(mine, maps, modes).withColumn("present", F.lit(False))
    new = key_entries(apply_writes(mine, writes), maps, modes).withColumn("present", F.lit(True))
    both = gone.unionByName(new).groupBy("probe_key", "record_id").agg(F.min("present").alias("present"), F.max("present").alias("_any"))
    return both.filter("present = _any").drop("_any")


def apply_entries(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The entries after `entry_changes`."""
    kept = old.join(changes, ["probe_key", "record_id"], "left_anti")
    return kept.unionByName(changes.filter("present").drop("present"))


def id_probe(map_name, segment) -> Column:
    return F.concat_ws("|", F.lit("match"), _col(map_name), _col(segment))


def key_probe(system, entity, record_id) -> Column:
    return F.concat_ws("|", F.lit("id"), F.lower(_col(system)), F.lower(_col(entity)), _col(record_id))


def new_record_id(system="target_system", entity="target_entity", segment="key_segment") -> Column:
    """Id for a record a by_id target would create. Derived from the key, so a retried or
    replayed batch names the same record."""
    return F.md5(F.concat_ws("|", F.lower(_col(system)), F.lower(_col(entity)), _col(segment)))


def resolve_targets(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Add `target_exists`, `resolved_id` and extend `key_error` with ambiguity.

    Rows need `upsert_mode`, `link_target_id`, `key_segment`, `key_error`. A linked by_id row
    needs no look-up; its probe key is unique, so it spreads instead of piling up on null.
    """
    by_key = F.col("upsert_mode") == BY_KEY
    own_id = F.coalesce("link_target_id", "key_segment")
    probe = F.when(by_key & own_id.isNotNull(), key_probe("target_system", "target_entity", own_id)).when(
        ~by_key & F.col("link_target_id").isNull() & F.col("key_segment").isNotNull(), id_probe("map_name", "key_segment")
    )
    idle = F.concat_ws("|", F.lit("-"), F.col("arrival_seq").cast("string"), "map_name")
    joined = rows.withColumn("probe_key", F.coalesce(probe, idle)).join(index, "probe_key", "left")
    ambiguous = ~by_key & (F.col("matches") > 1)
    found = F.coalesce("matches", F.lit(0)) > 0
    return (
        joined.withColumn("key_error", F.when(ambiguous, F.lit("integration key matches more than one record")).otherwise(F.col("key_error")))
        .withColumn("target_exists", F.when(by_key | F.col("link_target_id").isNull(), found).otherwise(F.lit(True)))
        .withColumn(
            "resolved_id",
            F.coalesce(
                "link_target_id",
                F.when(F.col("key_error").isNull(), F.when(by_key, F.col("key_segment")).otherwise(
                    F.coalesce("match_id", F.when(F.col("key_segment").isNotNull(), new_record_id())))),
            ),
        )
        .drop("probe_key", "matches", "match_id")
    )


def update_body(fields="mapped", names="integration_key") -> Column:
    """Body of an update: keys address the record, so they are left out."""
    return F.map_filter(_col(fields), lambda k, _: ~F.exists(_col(names), lambda n: F.lower(n) == F.lower(k)))


def create_body(fields="mapped", company="company") -> Column:
    """Body of a create: all fields, plus the company when it is known and not mapped."""
    fields, company = _col(fields), _col(company)
    mapped = F.exists(F.map_keys(fields), lambda k: F.lower(k) == COMPANY_KEY.lower())
    add = F.coalesce(company != "", F.lit(False)) & ~mapped
    return F.when(add, F.map_concat(fields, F.create_map(F.lit(COMPANY_KEY), json_str(company)))).otherwise(fields)


def net_writes(plan: DataFrame) -> DataFrame:
    """Many writes per record → one. `plan` has target_system, target_entity, record_id,
    operation, fields, write_order (sortable). The last delete wipes what came before it;
    after it, each field takes its latest value.

    Aggregates by (record, field) before it gathers a record, so a record with any number
    of writes reaches one task only as one value per field.
    """
    record = ["_system", "_entity", "record_id"]
    marks = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    body = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    parts = _target_keys(plan, "target_system", "target_entity").select(
        *record, "target_system", "target_entity", "write_order",
        (F.col("operation") == "Delete").alias("gone"),
        F.explode(F.when(F.col("operation") == "Delete", marks).otherwise(F.concat(marks, body))).alias("part"),
    )
    latest = parts.groupBy(*record, F.col("part.key").alias("key"), "gone").agg(
        F.max_by("part.value", "write_order").alias("value"), F.max("write_order").alias("at"),
        F.min("target_system").alias("target_system"), F.min("target_entity").alias("target_entity"),
    )
    items = latest.groupBy(*record).agg(
        F.max(F.when(F.col("gone"), F.col("at"))).alias("gone_at"),
        F.max("at").alias("write_order"),
        F.min("target_system").alias("target_system"), F.min("target_entity").alias("target_entity"),
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value", "at"))).alias("items"),
    )
    kept = F.filter("items", lambda i: F.col("gone_at").isNull() | (i["at"] > F.col("gone_at")))
    return items.select(
        "target_system", "target_entity", "record_id",
        F.map_from_entries(F.transform(kept, lambda i: F.struct(i["key"].alias("key"), i["value"].alias("value")))).alias("fields"),
        F.coalesce(F.col("gone_at") == F.col("write_order"), F.lit(False)).alias("deleted"),
        F.col("gone_at").isNotNull().alias("wiped"),
        "write_order",
    )


def _target_keys(df: DataFrame, system: str, entity: str) -> DataFrame:
    return df.withColumns({"_system": F.lower(system), "_entity": F.lower(entity)})


def apply_writes(targets: DataFrame, writes: DataFrame) -> DataFrame:
    """The target after net writes: patch only what was mapped, create what is missing,
    drop what was deleted (a missing record is no error). Adds `created` and `written`."""
    old = _target_keys(targets, "system", "entity_name").withColumnRenamed("fields", "old_fields")
    new = _target_keys(writes, "target_system", "target_entity").withColumn("_write", F.lit(True))
    joined = old.join(new, ["_system", "_entity", "record_id"], "full_outer").filter(
        ~F.coalesce("deleted", F.lit(False))
    )
    untouched = F.map_filter("old_fields", lambda k, _: ~F.map_contains_key(F.col("fields"), k))
    fields = (
        F.when(F.col("_write").isNull(), F.col("old_fields"))
        .when(F.col("old_fields").isNull() | F.col("wiped"), F.col("fields"))
        .otherwise(F.map_concat(untouched, "fields"))
    )
    return joined.select(
        F.coalesce("system", "target_system").alias("system"),
        F.coalesce("entity_name", "target_entity").alias("entity_name"),
        "record_id",
        fields.alias("fields"),
        (F.col("_write").isNotNull() & F.col("system").isNull()).alias("created"),
        F.col("_write").isNotNull().alias("written"),
    )


def apply_deletes(targets: DataFrame, deletes: DataFrame) -> DataFrame:
    """Target rows not named by `deletes` (target_system, target_entity, record_id)."""
    old = _target_keys(targets, "system", "entity_name")
    gone = _target_keys(deletes, "target_system", "target_entity").select("_system", "_entity", "record_id").distinct()
    return old.join(gone, ["_system", "_entity", "record_id"], "left_anti").select(*targets.columns)
