"""Field mapping: a record body through a map's field list.

Two forms with equal results. `CompiledMaps` turns a bounded number of maps into plain
generated expressions, the fast path for the usual tens of maps. `map_fields` reads the
field list from the row it was routed with, so any number of maps shares one plan.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from changesync.functions.keys import literal
from changesync.functions.transforms import Transforms
from changesync.functions.values import NULL, entries_last_wins, json_str, text_of

# Beyond this many mapped fields in all, expressions would outgrow generated code.
MAX_COMPILED_FIELDS = 400
MAX_COMPILED_MAPS = 100

EMPTY_MAP = "CAST(map() AS MAP<STRING,STRING>)"


def _steps(data: Column, fields: Column, transforms: Transforms) -> Column:
    """What each field writes: ARRAY<STRUCT<key, value, transform, omitted, error>>. Works in
    passes, so that a value used several times is bound once."""
    found = F.transform(fields, lambda f: F.struct(
        f["source"].alias("source"), f["target"].alias("key"), f["transform"].alias("transform"),
        f["value_map"].alias("value_map"), F.nullif(f["default_value"], F.lit(NULL)).alias("default"),
        F.try_element_at(data, f["source"]).alias("value"),
    ))
    translated = F.transform(found, lambda s: F.struct(
        *[s[n].alias(n) for n in ("source", "key", "transform", "default", "value")],
        (s["value_map"].isNotNull() & (s["value"] != NULL)).alias("coded"),
        F.map_contains_key(s["value_map"], text_of(s["value"])).alias("known"),
        F.try_element_at(s["value_map"], text_of(s["value"])).alias("translated"),
    ))

    def mapped(s):
        absent = s["value"].isNull()
        coded = F.coalesce(s["coded"], F.lit(False))
        error = F.when(
            coded & ~F.coalesce(s["known"], F.lit(False)) & s["default"].isNull(),
            F.concat(F.lit("no translation for '"), s["source"], F.lit("' value "), s["value"]),
        ).when(
            ~absent & s["transform"].isNotNull() & ~transforms.is_registered(s["transform"]),
            F.concat(F.lit("transform '"), s["transform"], F.lit("' is not registered")),
        )
        return F.struct(
            s["key"].alias("key"),
            F.when(absent, s["default"]).when(coded, F.when(s["known"], F.coalesce(json_str(s["translated"]), F.lit(NULL))).otherwise(s["default"]))
            .otherwise(s["value"]).alias("value"),
            F.when(~absent, F.lower(s["transform"])).alias("transform"),
            (absent & s["default"].isNull()).alias("omitted"),
            error.alias("error"),
        )

    return F.transform(F.transform(translated, mapped), lambda s: F.struct(
        s["key"].alias("key"), transforms.apply(s["transform"], s["value"]).alias("value"),
        s["transform"].alias("transform"), s["omitted"].alias("omitted"), s["error"].alias("error"),
    ))


def map_fields(df: DataFrame, data: str = "data", fields: str = "fields", transforms: Transforms | None = None) -> DataFrame:
    """Add `mapped` (target body) and `map_error`.

    An absent source key writes the default, or nothing at all; a present null stays null
    and skips the value map; a value the value map lacks takes the default or is an error;
    the named transform comes last and never touches an absent key's default.
    """
    transforms = transforms or Transforms()
    keep = df.columns
    out = df.withColumn("_steps", _steps(F.col(data), F.col(fields), transforms))
    out = out.withColumns({
        "map_error": F.get(F.array_compact(F.transform("_steps", lambda s: s["error"])), F.lit(0)),
        "_written": F.filter("_steps", lambda s: ~s["omitted"]),
    })
    for key in transforms.python:
        out = _apply_python(out, key, transforms)
    entries = F.transform("_written", lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value")))
    out = out.withColumn("_entries", entries)
    mapped = F.coalesce(entries_last_wins(F.col("_entries")), F.expr(EMPTY_MAP))
    return out.withColumn("mapped", F.when(F.col("map_error").isNull(), mapped)).select(*keep, "mapped", "map_error")


def _apply_python(df: DataFrame, key: str, transforms: Transforms) -> DataFrame:
    """Send the values bound for one Python transform through its UDF, and put them back."""
    mine = F.filter("_written", lambda s: F.coalesce(s["transform"] == key, F.lit(False)))
    df = df.withColumn("_out", transforms.python_udf(key)(F.transform(mine, lambda s: s["value"])))

    def put_back(s, i):
        earlier = F.filter(
            F.slice("_written", F.lit(1), i + 1), lambda x: F.coalesce(x["transform"] == key, F.lit(False))
        )
        value = F.when(F.coalesce(s["transform"] == key, F.lit(False)), F.get("_out", F.size(earlier) - 1))
        return F.struct(
            s["key"].alias("key"), value.otherwise(s["value"]).alias("value"), s["transform"].alias("transform"),
            s["omitted"].alias("omitted"), s["error"].alias("error"),
        )

    return df.withColumn("_written", F.transform("_written", put_back)).drop("_out")


@dataclass
class CompiledMaps:
    """Active maps as expressions over `map_name` and the body."""

    maps: list[Row]
    transforms: Transforms

    @classmethod
    def load(cls, active: DataFrame, transforms: Transforms) -> "CompiledMaps | None":
        """Read the maps (`map_name`, `fields`, `integration_key`), or None when they are too
        many to compile or a Python transform is in use. Reads at most one map past the limit."""
        rows = active.select("map_name", "fields", "integration_key").limit(MAX_COMPILED_MAPS + 1).collect()
        fields = sum(len(r["fields"] or []) for r in rows)
        if len(rows) > MAX_COMPILED_MAPS or fields > MAX_COMPILED_FIELDS or transforms.python:
            return None
        return cls(rows, transforms)

    def _per_map(self, expression: Callable[[Row], Column], kind: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for m in self.maps:
            out = out.when(F.col("map_name") == m["map_name"], expression(m))
        return out

    def _field(self, data: Column, f: Row) -> tuple[Column, Column | None]:
        value = F.try_element_at(data, F.lit(f["source"]))
        default = F.lit(f["default_value"] if f["default_value"] != NULL else None).cast("string")
        has_default = f["default_value"] not in (None, NULL)
        mapped, error = value, None
        if f["value_map"] is not None:
            pairs = [x for k, v in f["value_map"].items() for x in (F.lit(k), F.lit(NULL) if v is None else json_str(F.lit(v)))]
            known = F.try_element_at(F.create_map(*pairs), text_of(value)) if pairs else F.lit(None).cast("string")
            mapped = F.when(value == NULL, value).otherwise(F.coalesce(known, default))
            if not has_default:
                message = F.concat(F.lit(f"no translation for '{f['source']}' value "), value)
                error = F.when((value != NULL) & known.isNull(), message)
        if f["transform"] is not None:
            fn = self.transforms.columns.get(f["transform"].lower())
            if fn is None:
                unknown = F.when(value.isNotNull(), F.lit(f"transform '{f['transform']}' is not registered"))
                error = unknown if error is None else F.coalesce(error, unknown)
            else:
                mapped = fn(mapped)
        return F.when(value.isNull(), default).otherwise(mapped), error

    def map_fields(self, df: DataFrame, data: str = "data") -> DataFrame:
        """Add `mapped` and `map_error`, as the row-driven `map_fields` does."""
        def body(m):
            values: dict[str, Column] = {}
            for f in m["fields"] or []:
                value, _ = self._field(F.col(data), f)
                values[f["target"]] = F.coalesce(value, values[f["target"]]) if f["target"] in values else value
            if not values:
                return F.expr(EMPTY_MAP)
            entries = F.array(*[F.struct(F.lit(t).alias("key"), v.alias("value")) for t, v in values.items()])
            return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

        def first_error(m):
            errors = [e for _, e in (self._field(F.col(data), f) for f in m["fields"] or []) if e is not None]
            return F.coalesce(*errors) if errors else F.lit(None).cast("string")

        out = df.withColumn("map_error", self._per_map(first_error, "string"))
        return out.withColumn("mapped", F.when(F.col("map_error").isNull(), self._per_map(body, "MAP<STRING,STRING>")))

    def key_segment(self, rows: DataFrame, fallback: Callable[[str], Column | None]) -> DataFrame:
        """Add `key_error` and `key_segment` (exclusive) from `mapped`. `fallback(name)` may give
        a value for a key field the map does not write."""
        def value(name):
            own = F.nullif(F.try_element_at("mapped", F.lit(name)), F.lit(NULL))
            other = fallback(name)
            return own if other is None else F.coalesce(own, other)

        def problem(m):
            if not m["integration_key"]:
                return F.lit("no link and no integration key in the map")
            return F.coalesce(*[
                F.when(value(n).isNull(), F.lit(f"integration key '{n}' has no value")) for n in m["integration_key"]
            ])

        def segment(m):
            names = sorted(m["integration_key"] or [], key=str.upper)
            return F.concat_ws(",", *[F.concat(F.lit(f"{n}="), literal(value(n))) for n in names])

        mapped = F.col("map_error").isNull()
        out = rows.withColumn("key_error", F.when(mapped, self._per_map(problem, "string")))
        return out.withColumn("key_segment", F.when(mapped & F.col("key_error").isNull(), self._per_map(segment, "string")))
