"""Column layouts shared by every step. All names are snake_case; a record body
(`data`, `fields`) is MAP<STRING,STRING> whose values are JSON text, so that an absent
key, a JSON null, the number 1 and the string "1" all stay distinct and can be hashed."""

SYNC_STATE = (
    "STRUCT<written_to_system: STRING, written_fields: ARRAY<STRING>, written_payload_hash: STRING, "
    "last_writer_system: STRING, last_writer_at: TIMESTAMP>"
)

CHANGE_EVENT = (
    "source_system STRING, entity_name STRING, source_record_id STRING, operation STRING, "
    "occurred_at TIMESTAMP, company STRING, data MAP<STRING,STRING>, originating_user_id STRING, "
    "correlation_id STRING"
)

# Arrival columns the message bus stamps on a published event.
BUS_COLUMNS = "arrival_seq BIGINT, enqueued_at TIMESTAMP, delivery_count INT"

# What a failed event must keep to run again.
EVENT_COLUMNS = [c.split(":")[0].split()[0] for c in f"{CHANGE_EVENT}, {BUS_COLUMNS}".split(", ")]

FIELD_MAP = (
    "STRUCT<source: STRING, target: STRING, transform: STRING, value_map: MAP<STRING,STRING>, "
    "default_value: STRING>"
)

ENTITY_MAP = (
    "name STRING, source_system STRING, source_entity STRING, target_system STRING, target_entity STRING, "
    "direction STRING, status STRING, companies ARRAY<STRING>, "
    f"fields ARRAY<{FIELD_MAP}>, integration_key ARRAY<STRING>, version INT, "
    "schedule STRUCT<cron: STRING, mode: STRING, detect_deletes: BOOLEAN>"
)

# The same document as it lies on disk, in camelCase JSON.
ENTITY_MAP_DOCUMENT = (
    "name STRING, sourceSystem STRING, sourceEntity STRING, targetSystem STRING, targetEntity STRING, "
    "direction STRING, status STRING, companies ARRAY<STRING>, "
    "fields ARRAY<STRUCT<source: STRING, target: STRING, transform: STRING, valueMap: MAP<STRING,STRING>, "
    "defaultValue: VARIANT>>, integrationKey ARRAY<STRING>, version INT, "
    "schedule STRUCT<cron: STRING, mode: STRING, detectDeletes: BOOLEAN>"
)

# A file of them: one map, or a list of maps.
ENTITY_MAP_FILE = f"{ENTITY_MAP_DOCUMENT}, maps ARRAY<STRUCT<{ENTITY_MAP_DOCUMENT}>>"

XREF_LINK = (
    "pair_key STRING, system_a STRING, record_id_a STRING, system_b STRING, record_id_b STRING, "
    f"state {SYNC_STATE}"
)

# A stored link: one row per side, found by lookup_key, with an optimistic-concurrency version.
XREF_ROW = f"lookup_key STRING, {XREF_LINK}, version BIGINT"

TARGET_ROW = "system STRING, entity_name STRING, record_id STRING, fields MAP<STRING,STRING>"

WATERMARK = "system STRING, scope STRING, token STRING, updated_at TIMESTAMP"

HISTORY = (
    "map_name STRING, processed_at TIMESTAMP, outcome STRING, operation STRING, source_system STRING, "
    "source_record_id STRING, target_system STRING, target_record_id STRING, company STRING, "
    "occurred_at TIMESTAMP, error STRING, delivery_count INT, correlation_id STRING"
)

# Change operations by ordinal, and the outcomes of one processing attempt.
OPERATIONS = ("Create", "Update", "Delete")
CREATED, UPDATED, DELETED = "Created", "Updated", "Deleted"
ECHO, DISCARDED, FAILED = "EchoSuppressed", "DiscardedByLastWriterWins", "Failed"
OUTCOMES = (CREATED, UPDATED, DELETED, ECHO, DISCARDED, FAILED)
