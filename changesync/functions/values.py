"""JSON-encoded scalar values: encode, decode, canonicalise, hash.

Lambdas of higher-order functions are interpreted and share nothing, so an argument that is
used more than once should be a column or a lambda variable, not a computed expression.
"""

from pyspark.sql import Column, functions as F

NULL = "null"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_str(text: Column | str) -> Column:
    """Plain text → JSON string literal."""
    text = _col(text)
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def json_number(text: Column | str) -> Column:
    """Number text → the one JSON form equal numbers have: `1.50` and `1.5`, `1.0E10` and
    `10000000000` come out alike. Text that is no JSON number becomes a string."""
    text = _col(text)
    plain = F.when(text.rlike(r"E\d"), text.try_cast("decimal(38,9)").cast("string"))
    return F.coalesce(F.to_json(F.try_parse_json(F.coalesce(plain, text))), json_str(text))


def is_json_str(value: Column | str) -> Column:
    return F.startswith(_col(value), F.lit('"'))


def decode_str(value: Column | str) -> Column:
    """JSON string literal → its text; null for any other kind of value."""
    value = _col(value)
    bare = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(
        is_json_str(value),
        F.when(F.contains(value, F.lit("\\")), F.try_variant_get(F.try_parse_json(value), "$", "string")).otherwise(bare),
    )


def text_of(value: Column | str) -> Column:
    """The text a value map is keyed by: decoded strings, `True`/`False`, raw number text."""
    value = _col(value)
    return (
        F.when(is_json_str(value), decode_str(value))
        .when(value == "true", F.lit("True"))
        .when(value == "false", F.lit("False"))
        .otherwise(value)
    )


def canonical_json(fields: Column | str) -> Column:
    """Object text with ordinal-sorted keys, so equal content gives equal text."""
    fields = _col(fields)
    members = F.transform(
        F.array_sort(F.map_keys(fields)),
        lambda k: F.concat(json_str(k), F.lit(":"), F.element_at(fields, k)),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def payload_hash(fields: Column | str) -> Column:
    """Upper-hex SHA-256 of the canonical object text."""
    return F.upper(F.sha2(canonical_json(fields), 256))


def project_hash(data: Column | str, names: Column | str) -> Column:
    """Hash of `data` seen through a list of field names; an absent name counts as null."""
    data, names = _col(data), _col(names)
    members = F.transform(
        F.array_sort(names),
        lambda k: F.concat(json_str(k), F.lit(":"), F.coalesce(F.try_element_at(data, k), F.lit(NULL))),
    )
    return F.upper(F.sha2(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), 256))


def variant_values(raw: Column) -> Column:
    """JSON object text → MAP<STRING,STRING> of JSON-encoded values (numbers normalised)."""
    return F.transform_values(F.try_parse_json(raw).try_cast("MAP<STRING,VARIANT>"), lambda _, v: F.to_json(v))


def entries_last_wins(entries: Column) -> Column:
    """ARRAY<STRUCT<key,value>> column → map, the last of equal keys kept."""
    n = F.size(entries)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]),
    )
    unique = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == n
    return F.when(unique, F.map_from_entries(entries)).otherwise(F.map_from_entries(last))
