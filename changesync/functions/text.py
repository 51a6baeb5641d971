"""Small text rules."""

from pyspark.sql import Column, functions as F

from changesync.functions.values import _col

ELLIPSIS = "…"
MAX_ERROR_LENGTH = 4000
MAX_LOGGED_PAYLOAD = 600


def truncate(text, limit: int) -> Column:
    text = _col(text)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(ELLIPSIS))).otherwise(text)


def trim_ws(text) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(_col(text), r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def is_blank(text) -> Column:
    text = _col(text)
    return text.isNull() | (F.length(trim_ws(text)) == 0)


def type_tail(type_name) -> Column:
    return F.substring_index(_col(type_name), ".", -1)


def is_erp_name(name) -> Column:
    return F.coalesce(_col(name).rlike(r"\A[A-Za-z0-9_]+\z"), F.lit(False))


def is_crm_name(name) -> Column:
    return F.coalesce(_col(name).rlike(r"\A[a-z0-9_]+\z"), F.lit(False))
