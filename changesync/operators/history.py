"""The sync history: an append-only log, read newest first."""

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from changesync.functions.keys import sanitize_partition
from changesync.functions.text import MAX_ERROR_LENGTH, truncate
from changesync.operators import prefix
from changesync.schema import OUTCOMES
from changesync.storage import Scratch

PAGE_SIZE = 50
# Rows of a page that one task may collect.
TASK_PAGE = 10_000

# The CSV columns, in order.
CSV_COLUMNS = (
    "processedAtUtc", "outcome", "operation", "sourceSystem", "sourceRecordId", "targetSystem", "targetRecordId",
    "company", "deliveryCount", "correlationId", "error",
)


# Rows come newest first. A whole batch has one processing time and a record may be attempted many
# times in one transaction, so the stored row number ends the order: no two rows are equal in it.
# The columns, and what stands for null in them.
ORDER = {"newest_first": 0, "correlation_id": "", "source_record_id": "", "delivery_count": -1, "row_id": ""}


def _newest_first() -> Column:
    """A number that falls as time goes on."""
    return F.lit(1 << 62) - F.unix_micros("processed_at")


def to_append(history: DataFrame) -> DataFrame:
    """Rows as stored: long errors cut, the folder-safe `map_partition` and the `day` they live under,
    and what orders them, `newest_first` and a `row_id` of their own."""
    return history.withColumns({
        "error": truncate("error", MAX_ERROR_LENGTH), "map_partition": sanitize_partition("map_name"), "day": F.to_date("processed_at"),
        "newest_first": _newest_first(), "row_id": F.expr("uuid()"),
    })


def append(history: DataFrame, path: str) -> None:
    """Append to the log, by map and day; files hold disjoint stretches of time, so their statistics
    tell a reader which ones a page needs. Rows of one time are divided by their number."""
    order = ["map_partition", "newest_first", "row_id"]
    rows = to_append(history).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("append").partitionBy("map_partition", "day").parquet(path)


def _place(rows: DataFrame) -> list[Column]:
    """The order columns, without nulls. Rows that were never stored have no number of their own."""
    absent = {"newest_first": _newest_first(), "row_id": F.lit("")}
    return [F.coalesce(F.col(c) if c in rows.columns else absent[c], F.lit(none)) for c, none in ORDER.items()]


def _after(rows: DataFrame, cursor: Row) -> Column:
    """Rows that follow the cursor."""
    given = cursor.asDict()
    out = F.lit(False)
    for column, (name, none) in reversed(list(zip(_place(rows), ORDER.items()))):
        if name == "newest_first":
            at = F.lit(1 << 62) - F.unix_micros(F.lit(cursor["processed_at"]).cast("timestamp"))
            exact = F.col(name) if name in rows.columns else column
            return (exact >= at) & ((column > at) | ((column == at) & out))
        at = F.lit(none if given.get(name) is None else given[name])
        out = (column > at) | ((column == at) & out)
    return out


def page(history: DataFrame, map_name: str, before: Column | Row | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """Newest rows of a map; `maybe_more` when the page is full. `before` is the last row of the
    page before, or a time that all rows must be older than. Of a stored log only the map's own
    folders up to the day of `before` are read, and a walk from page to page meets every row once; of
    rows that were never stored, those equal in all order columns cannot be told apart. The end of a page of
    more than TASK_PAGE rows is looked for at once, and no task collects the page."""
    rows = history.filter(F.col("map_name") == map_name)
    if "map_partition" in history.columns:
        rows = rows.filter(F.col("map_partition") == sanitize_partition(F.lit(map_name)))
    if before is not None:
        time = F.lit(before["processed_at"]).cast("timestamp") if isinstance(before, Row) else before
        if "day" in history.columns:
            rows = rows.filter(F.col("day") <= F.to_date(time))
        rows = rows.filter(_after(rows, before) if isinstance(before, Row) else F.col("processed_at") < before)
    if size > TASK_PAGE:
        return _large_page(rows, size)
    top = rows.orderBy(*_place(rows)).limit(size)
    return top.withColumn("maybe_more", F.count("*").over(Window.partitionBy("map_name")) == size)


def _large_page(rows: DataFrame, size: int) -> DataFrame:
    """The first `size` rows: those up to the place of the last one, which the places alone tell."""
    scratch, place = Scratch(rows.sparkSession), F.struct(*[c.alias(n) for c, n in zip(_place(rows), ORDER)])
    try:
        places = scratch.keep(prefix.with_parts(rows.select(place.alias("p")).select("p.*").orderBy(*ORDER)), "places")
        last = prefix.numbered(places, "_n").filter(F.col("_n") == size - 1).select(*ORDER).first()
        if last is None:
            return rows.orderBy(*_place(rows)).withColumn("maybe_more", F.lit(False))
        end = F.struct(*[F.lit(last[n]).cast(places.schema[n].dataType).alias(n) for n in ORDER])
        before = places.filter(F.struct(*ORDER) < end).count()
    finally:
        scratch.delete()
    found = rows.filter(place < end).unionByName(rows.filter(place == end).limit(size - before))
    return found.orderBy(*_place(found)).withColumn("maybe_more", F.lit(True))


def filter_outcome(history: DataFrame, outcome: str | None) -> DataFrame:
    return history if outcome is None else history.filter(F.col("outcome") == outcome)


def outcome_rank(outcome="outcome"):
    return F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(outcome))


def summary(history: DataFrame) -> DataFrame:
    """Rows per outcome, in outcome order."""
    return history.groupBy("map_name", "outcome").agg(F.count("*").alias("entries")).orderBy("map_name", outcome_rank())


def csv_columns(history: DataFrame) -> DataFrame:
    """The export columns as text; nulls are empty."""
    texts = (
        F.concat(F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")), F.col("outcome"), F.col("operation"),
        F.col("source_system"), F.col("source_record_id"), F.col("target_system"), F.col("target_record_id"),
        F.col("company"), F.col("delivery_count").cast("string"), F.col("correlation_id"), F.col("error"),
    )
    return history.select(*[F.coalesce(t, F.lit("")).alias(n) for n, t in zip(CSV_COLUMNS, texts)])


def write_csv(history: DataFrame, path: str) -> None:
    writer = csv_columns(history).write.mode("overwrite").option("header", True)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def csv_line(history: DataFrame) -> DataFrame:
    """The export line of each row: a field with comma, quote or line break is quoted."""
    def quoted(c):
        doubled = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[,"\r\n]'), doubled).otherwise(c)

    rows = csv_columns(history)
    return rows.select(F.concat_ws(",", *[quoted(F.col(c)) for c in CSV_COLUMNS]).alias("line"))
