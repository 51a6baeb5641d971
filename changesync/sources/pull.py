"""Pulling records from a source table instead of waiting for its events."""

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F, types as T

from changesync.functions.keys import literal
from changesync.functions.payload import iso_instant
from changesync.functions.values import NULL, decode_str, json_number, json_str


@dataclass(frozen=True)
class Entity:
    """How a source entity is identified, dated and scoped."""

    system: str
    name: str
    key_fields: tuple[str, ...]
    modified_field: str | None = None
    company_field: str | None = None


class SystemTables(Protocol):
    """A system plugs in by naming its tables; any Spark source will do."""

    name: str
    upsert_mode: str

    def read_entity(self, entity: str) -> DataFrame: ...

    def read_catalog(self) -> DataFrame: ...

    def target_table(self) -> DataFrame: ...


def parse_token(token: str) -> datetime:
    try:
        moment = datetime.fromisoformat(token)
    except ValueError:
        raise ValueError(f"unreadable watermark '{token}': not an ISO 8601 time") from None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def scan(
    table: DataFrame, entity: Entity, token: str = "", companies: Sequence[str] = (), keys_only: bool = False
) -> DataFrame:
    """The records to pull. The time bound (inclusive), the companies and the columns are plain
    predicates and projections, so they reach the file reader."""
    if not entity.key_fields:
        raise ValueError(f"entity {entity.name} has no key fields")
    if token:
        if entity.modified_field is None:
            raise ValueError(f"entity {entity.name} has no modification time: pull it in full")
        kind = table.schema[entity.modified_field].dataType
        since = parse_token(token).astimezone(timezone.utc)
        bound = F.lit(since.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind if isinstance(kind, T.TimestampNTZType) else "timestamp")
        table = table.filter(F.col(entity.modified_field) >= bound)
    if companies:
        if entity.company_field is None:
            raise ValueError(f"entity {entity.name} has no company field: it cannot be pulled by company")
        table = table.filter(F.col(entity.company_field).isin(list(companies)))
    return table.select(*entity.key_fields) if keys_only else table


def value_json(field: T.StructField) -> Column:
    """A typed column as JSON text; null becomes the JSON null, bytes base64 text. Numbers take
    the form that payload numbers have; those JSON has none for (NaN, infinities) are strings."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        text = json_str(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = json_str(iso_instant(c))
    elif isinstance(kind, T.DateType):
        text = json_str(c.cast("string"))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.NumericType):
        text = json_number(c.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(c)
    elif isinstance(kind, T.BinaryType):
        text = json_str(F.base64(c))
    else:
        text = json_str(c.cast("string"))
    return F.coalesce(text, F.lit(NULL))


def body_of_columns(table: DataFrame) -> Column:
    """The columns of a table row as a body, annotations (`@…`) left out."""
    fields = [f for f in table.schema.fields if not f.name.startswith("@")]
    return F.map_from_arrays(F.array(*[F.lit(f.name) for f in fields]), F.array(*[value_json(f) for f in fields]))


def explode_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """Result pages as JSON text → `data`, one row per element of each page's `value` list."""
    page = F.try_parse_json(column).try_cast("MAP<STRING,VARIANT>")
    records = pages.select(F.explode(F.try_element_at(page, F.lit("value")).try_cast("ARRAY<VARIANT>")).alias("r"))
    members = F.map_filter(F.col("r").try_cast("MAP<STRING,VARIANT>"), lambda k, _: ~F.startswith(k, F.lit("@")))
    return records.select(F.transform_values(members, lambda _, v: F.to_json(v)).alias("data"))


def _staged(df: DataFrame, entity: Entity, member) -> DataFrame:
    """Add the JSON text of the entity's key, time and company members as plain columns, so
    that each is read once."""
    wanted = {f"_key_{i}": k for i, k in enumerate(entity.key_fields)}
    if entity.modified_field:
        wanted["_modified"] = entity.modified_field
    if entity.company_field:
        wanted["_company"] = entity.company_field
    return df.withColumns({c: F.nullif(member(name), F.lit(NULL)) for c, name in wanted.items()})


def _member_of_body(name: str) -> Column:
    hits = F.filter(F.map_entries("data"), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(-1))["value"]


def _member_of_table(table: DataFrame):
    fields = {f.name.lower(): f for f in table.schema.fields}
    return lambda name: value_json(fields[name.lower()]) if name.lower() in fields else F.lit(None).cast("string")


def record_id(entity: Entity) -> Column:
    """Canonical id of a staged record, the same a write to that entity would use: key parts in
    case-insensitive order. A record without a key value stops the pull."""
    parts = []
    for i, k in sorted(enumerate(entity.key_fields), key=lambda p: p[1].upper()):
        missing = F.raise_error(F.lit(f"a pulled {entity.name} record has no value for key '{k}'")).cast("string")
        parts.append(F.concat(F.lit(f"{k}="), literal(F.col(f"_key_{i}")), F.when(F.col(f"_key_{i}").isNull(), missing).otherwise(F.lit(""))))
    return F.concat_ws(",", *parts)


def to_events(records: DataFrame, entity: Entity, pulled_at: Column) -> DataFrame:
    """Pulled bodies (`data`) → change events."""
    return _events(_staged(records, entity, _member_of_body), entity, pulled_at)


def _events(staged: DataFrame, entity: Entity, pulled_at: Column) -> DataFrame:
    """The operation is always Update (the write decides), and a record without a readable
    modification time changed when it was pulled."""
    modified = decode_str("_modified").try_cast("timestamp") if entity.modified_field else F.lit(None).cast("timestamp")
    company = decode_str("_company") if entity.company_field else F.lit(None).cast("string")
    named = staged.withColumns({"source_record_id": record_id(entity), "occurred_at": F.coalesce(modified, pulled_at)})
    return named.select(
        F.lit(entity.system).alias("source_system"),
        F.lit(entity.name).alias("entity_name"),
        "source_record_id",
        F.lit("Update").alias("operation"),
        "occurred_at",
        company.alias("company"),
        "data",
        F.lit(None).cast("string").alias("originating_user_id"),
        F.md5(F.concat_ws("|", F.lit(entity.name), "source_record_id", F.col("occurred_at").cast("string"))).alias("correlation_id"),
    )


def pull_changes(
    table: DataFrame, entity: Entity, pulled_at: Column, token: str = "", companies: Sequence[str] = (), keys_only: bool = False
) -> DataFrame:
    """Records changed since `token` (all of them when empty) as change events."""
    records = scan(table, entity, token, companies, keys_only)
    staged = _staged(records.withColumn("data", body_of_columns(records)), entity, _member_of_table(records))
    return _events(staged, entity, pulled_at)


def live_keys(table: DataFrame, entity: Entity) -> DataFrame:
    """Distinct lower-case ids of every record of the entity, whatever its company: absence
    has to be absolute."""
    keys = scan(table, entity, keys_only=True).distinct()
    only_keys = replace(entity, modified_field=None, company_field=None)
    return _staged(keys, only_keys, _member_of_table(keys)).select(F.lower(record_id(entity)).alias("record_id")).distinct()


def export_entity(table: DataFrame, entity: Entity, partitions: int | None = None) -> DataFrame:
    """Whole entity for an initial load: `record_id` and `data`, spread evenly by id."""
    only_keys = replace(entity, modified_field=None, company_field=None)
    staged = _staged(table.withColumn("data", body_of_columns(table)), only_keys, _member_of_table(table))
    out = staged.select(record_id(entity).alias("record_id"), "data")
    return out.repartition(partitions, "record_id") if partitions else out
