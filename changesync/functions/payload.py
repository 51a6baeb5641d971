"""Reading change payloads held as VARIANT: case-insensitive members, key/value lists,
value wrappers, dates and ids."""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.values import _col, decode_str, entries_last_wins, is_json_str, json_str

DATE_PATTERN = r"\A/Date\((-?\d+)(?:[+-]\d{4})?\)/\n?\z"
JSON_DATE_PATTERN = r'\A"/Date\(-?\d+(?:[+-]\d{4})?\)/"\z'
EMPTY_ID_PATTERN = r"\A\s*[{(]?0{8}-?0{4}-?0{4}-?0{4}-?0{12}[)}]?\s*\z"

# Message names by operation, and the fields that carry the company.
MESSAGE_NAMES = {
    "Create": "Create",
    "OnExternalCreated": "Create",
    "Update": "Update",
    "OnExternalUpdated": "Update",
    "Delete": "Delete",
    "OnExternalDeleted": "Delete",
}
COMPANY_FIELDS = ("dataareaid", "mserp_dataareaid")

OBJECT = "MAP<STRING,VARIANT>"
PLAIN_WRAPPER_DEPTH = 2


def as_object(value: Column) -> Column:
    """VARIANT → MAP<STRING,VARIANT>; null unless it is a JSON object."""
    return value.try_cast(OBJECT)


def get_ci(obj: Column, name: str) -> Column:
    """First member whose name equals `name` ignoring case; SQL null when there is none."""
    hits = F.filter(F.map_entries(obj), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]


def member_text(names, members, name: str) -> Column:
    """JSON text of the first member called `name` in any case, given the lower-case `names` and
    the values of an object. Cheaper than `get_ci` where many members are read."""
    at = F.array_position(_col(names), F.lit(name.lower())) - 1
    return F.to_json(F.get(_col(members), at.cast("int")))


def has_ci(names: Column, name: str) -> Column:
    """Whether a list of lower-case member names holds `name`."""
    return F.array_contains(names, name.lower())


def operation_of(message_name) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MESSAGE_NAMES.items() for x in pair])
    return F.try_element_at(names, _col(message_name))


def parse_date(text) -> Column:
    """`/Date(ms±zzzz)/` (offset ignored) or an ISO instant; null when unreadable."""
    text = _col(text)
    millis = F.nullif(F.regexp_extract(text, DATE_PATTERN, 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.timestamp_millis(millis), text.try_cast("timestamp"))


def iso_instant(ts: Column) -> Column:
    """ISO text of an instant in UTC, fraction without trailing zeros."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.date_format(ts, ".SSSSSS"), F.lit("0"))
    return F.concat(base, F.when(fraction == ".", F.lit("")).otherwise(fraction), F.lit("+00:00"))


def first_useful_id(*candidates) -> Column:
    """First candidate that is neither blank nor the all-zero id."""
    useful = []
    for c in map(_col, candidates):
        useful.append(F.when(~c.rlike(r"\A[\s\p{Z}]*\z") & ~c.rlike(EMPTY_ID_PATTERN), c))
    return F.coalesce(*useful)


def pairs(array_value: Column) -> Column:
    """Array of `{key, value}` objects → ARRAY<STRUCT<key STRING, value VARIANT>>; elements
    without a string key or without a value member are left out."""
    objects = F.transform(array_value.try_cast("ARRAY<VARIANT>"), as_object)
    read = F.transform(
        objects, lambda o: F.struct(F.to_json(get_ci(o, "key")).alias("key"), get_ci(o, "value").alias("value"))
    )
    usable = F.filter(read, lambda p: is_json_str(p["key"]) & p["value"].isNotNull())
    return F.transform(usable, lambda p: F.struct(decode_str(p["key"]).alias("key"), p["value"].alias("value")))


def find_parameter(root: Column, name: str) -> Column:
    """Value of the first input parameter called `name`, ignoring case."""
    matches = F.filter(pairs(get_ci(root, "InputParameters")), lambda p: F.lower(p["key"]) == name.lower())
    return F.get(matches, F.lit(0))["value"]


def _unwrap(text: Column) -> Column:
    obj = as_object(F.try_parse_json(text))
    inner = F.coalesce(F.to_json(get_ci(obj, "Value")), F.to_json(get_ci(obj, "Id")), text)
    return F.when(F.startswith(text, F.lit("{")), inner).otherwise(text)


def _unwrap_all(text: Column) -> Column:
    """As many levels as the value can have: no more than it has braces."""
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    levels = F.when(braces > 0, F.sequence(F.lit(1), braces)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    return F.aggregate(levels, text, lambda inner, _: _unwrap(inner))


def _date_as_iso(text: Column) -> Column:
    """JSON text, with a `"/Date(ms)/"` string turned into the ISO instant it means."""
    is_date = F.startswith(text, F.lit('"/Date(')) & text.rlike(JSON_DATE_PATTERN)
    return F.when(is_date, json_str(iso_instant(parse_date(decode_str(text))))).otherwise(text)


def with_attributes(df: DataFrame, target: str, name: str) -> DataFrame:
    """Add `name`, the body held by the `Attributes` list of the object column `target`.

    `{Value: …}` and `{Id: …}` wrappers are reduced to what they hold, however deep; dates become
    ISO instants; the last of equal keys wins. The first levels are columns of their own and
    idle where nothing is wrapped; what is wrapped deeper goes through a loop per value.
    """

    def each(items, fn):
        return F.transform(items, lambda p: F.struct(p["key"].alias("key"), fn(p["value"]).alias("value")))

    def where(holds, fn):
        items = F.col("_items")
        return F.when(F.exists(items, lambda p: holds(p["value"])), each(items, fn)).otherwise(items)

    step = df.withColumn("_items", each(pairs(get_ci(F.col(target), "Attributes")), F.to_json))
    for unwrap in [_unwrap] * PLAIN_WRAPPER_DEPTH + [_unwrap_all]:
        step = step.withColumn("_items", where(lambda text: F.startswith(text, F.lit("{")), unwrap))
    step = step.withColumn("_items", where(lambda text: F.startswith(text, F.lit('"/Date(')), _date_as_iso))
    body = F.coalesce(entries_last_wins(F.col("_items")), F.expr("CAST(map() AS MAP<STRING,STRING>)"))
    return step.withColumn(name, body).drop("_items")


def company_of(data) -> Column:
    """Company named by the body, if its field holds a string."""
    hits = F.filter(F.map_entries(_col(data)), lambda e: F.lower(e["key"]).isin(*COMPANY_FIELDS))
    return decode_str(F.get(hits, F.lit(0))["value"])
