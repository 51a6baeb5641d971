"""Registry of named value transforms. A map refers to a transform by name, never by code."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from changesync.functions.text import trim_ws
from changesync.functions.values import decode_str, is_json_str, json_str

ColumnTransform = Callable[[Column], Column]


def on_text(fn: ColumnTransform) -> ColumnTransform:
    """Lift a text expression to JSON-encoded values; anything but a string passes through."""
    return lambda value: F.when(is_json_str(value), json_str(fn(decode_str(value)))).otherwise(value)


class Transforms:
    """Names ignore case; the last registration of a name wins.

    `register` takes an expression over JSON-encoded values and stays inside the JVM.
    `register_python` takes plain Python on one JSON text; it runs as an Arrow-batched
    pandas UDF over all values of that transform in a row, so use it only when no
    expression will do.
    """

    def __init__(self) -> None:
        self.columns: dict[str, ColumnTransform] = {}
        self.python: dict[str, Callable[[str | None], str | None]] = {}
        self._names: dict[str, str] = {}
        self.register("trim", on_text(trim_ws))
        self.register("toUpper", on_text(F.upper))
        self.register("toLower", on_text(F.lower))

    def register(self, name: str, fn: ColumnTransform) -> None:
        self.python.pop(name.lower(), None)
        self.columns[name.lower()] = fn
        self._names.setdefault(name.lower(), name)

    def register_python(self, name: str, fn: Callable[[str | None], str | None]) -> None:
        self.columns.pop(name.lower(), None)
        self.python[name.lower()] = fn
        self._names.setdefault(name.lower(), name)

    @property
    def names(self) -> list[str]:
        return list(self._names.values())

    def is_registered(self, name: Column) -> Column:
        return F.lower(name).isin(list(self._names))

    def apply(self, name: Column, value: Column) -> Column:
        """Expression transforms only; values of Python transforms pass through unchanged."""
        out = F.when(name.isNull(), value)
        for key, fn in self.columns.items():
            out = out.when(F.lower(name) == key, fn(value))
        return out.otherwise(value)

    def python_udf(self, key: str):
        fn = self.python[key]

        @F.pandas_udf("ARRAY<STRING>")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda items: None if items is None else [fn(v) for v in items])

        return run
