"""Identities: pair, lookup, session, message and idempotency keys, target key segments."""

from pyspark.sql import Column, functions as F

from changesync.functions.values import _col, decode_str, is_json_str, payload_hash
from changesync.schema import OPERATIONS

# 100 ns ticks from 0001-01-01 to the Unix epoch, and the largest tick.
EPOCH_TICKS = 621355968000000000
MAX_TICKS = 3155378975999999999

FORBIDDEN_KEY_CHARS = r"[/\\#?\x{0}-\x{1f}\x{7f}-\x{9f}]"


def pair_key(source_system, source_entity, target_system, target_entity) -> Column:
    """Direction-free identity of two entities. Order is case-insensitive in upper case."""

    def side(system, entity):
        name = F.concat(_col(system), F.lit(":"), _col(entity))
        return F.struct(F.upper(name).alias("rank"), F.lower(name).alias("name"))

    sides = F.array_sort(F.array(side(source_system, source_entity), side(target_system, target_entity)))
    return F.array_join(F.transform(sides, lambda s: s["name"]), "|")


def lookup_key(pair, system, record_id) -> Column:
    joined = F.lower(F.concat_ws("|", _col(pair), _col(system), _col(record_id)))
    return F.regexp_replace(joined, FORBIDDEN_KEY_CHARS, "-")


def sanitize_partition(name) -> Column:
    return F.regexp_replace(_col(name), FORBIDDEN_KEY_CHARS, "_")


def session_id(system="source_system", entity="entity_name", record_id="source_record_id") -> Column:
    return F.concat(_col(system), F.lit(":"), _col(entity), F.lit(":"), _col(record_id))


def utc_ticks(ts) -> Column:
    return F.unix_micros(_col(ts)) * 10 + F.lit(EPOCH_TICKS)


def inverted_ticks(ts) -> Column:
    """19-digit text that sorts newest first."""
    return F.lpad((F.lit(MAX_TICKS) - utc_ticks(ts)).cast("string"), 19, "0")


def operation_ordinal(operation) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in OPERATIONS]), _col(operation)) - 1


def message_id(data="data") -> Column:
    """Deterministic id of an event: equal events collapse in duplicate detection."""
    parts = F.concat_ws(
        "|",
        "source_system",
        "entity_name",
        "source_record_id",
        operation_ordinal("operation").cast("string"),
        utc_ticks("occurred_at").cast("string"),
        payload_hash(data),
    )
    return F.upper(F.sha2(parts, 256))


def idempotency_key(map_name="map_name", record_id="source_record_id", occurred_at="occurred_at") -> Column:
    return F.concat(_col(map_name), F.lit(":"), _col(record_id), F.lit(":"), utc_ticks(occurred_at).cast("string"))


def literal(value) -> Column:
    """JSON-encoded value → key literal: null, raw number or bool, else quoted with '' escapes."""
    value = _col(value)

    def quote(text):
        return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))

    return (
        F.when(value.isNull(), F.lit("null"))
        .when(is_json_str(value), quote(decode_str(value)))
        .when(F.startswith(value, F.lit("{")) | F.startswith(value, F.lit("[")), quote(value))
        .otherwise(value)
    )


def key_segment(parts) -> Column:
    """ARRAY<STRUCT<name, value>> → `a='x',b=1`, names in case-insensitive order."""
    ranked = F.array_sort(
        F.transform(
            _col(parts),
            lambda p: F.struct(
                F.upper(p["name"]).alias("rank"),
                F.concat(p["name"], F.lit("="), literal(p["value"])).alias("text"),
            ),
        )
    )
    return F.array_join(F.transform(ranked, lambda p: p["text"]), ",")
