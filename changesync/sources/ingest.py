"""Raw change payloads → normalised change events, with unreadable ones set aside."""

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changesync.functions import payload as p
from changesync.functions.text import MAX_LOGGED_PAYLOAD, truncate
from changesync.functions.values import _col, decode_str
from changesync.schema import EVENT_COLUMNS


class PayloadParser(Protocol):
    """A system plugs in by recognising its payloads and turning them into events. The text was
    read already: `root` is its JSON object (MAP<STRING,VARIANT>), null for anything else."""

    system_name: str

    def sniff(self, root: Column) -> Column:
        """True when the payload has this system's shape; never fails, false on junk."""

    def parse(self, df: DataFrame, raw: str, root: str) -> DataFrame:
        """Add `event` (the CHANGE_EVENT struct) and `error` (null when readable) for the
        payload text in column `raw`; both null where that text is null."""


def root_of(raw: str) -> Column:
    return p.as_object(F.try_parse_json(_col(raw)))


class ContextParser:
    """Execution-context payloads: an envelope, a message name, and the record's attributes
    as key/value pairs under the input parameter `Target`."""

    # Envelope members, in order of preference.
    TIMES = ("EventTimeIso8601", "EventTime", "OperationCreatedOn")
    USERS = ("InitiatingUserAzureActiveDirectoryObjectId", "InitiatingUserAADObjectId", "UserId")
    ROOT_STRINGS = ("MessageName", "PrimaryEntityName", "PrimaryEntityId", "CorrelationId", *TIMES, *USERS)
    TARGET_STRINGS = ("LogicalName", "Id")

    def __init__(self, system_name: str = "erp") -> None:
        self.system_name = system_name

    def sniff(self, root: Column) -> Column:
        names = F.transform(F.map_keys(root), lambda k: F.lower(k))
        shape = p.has_ci(names, "MessageName") & p.has_ci(names, "InputParameters")
        return F.coalesce(p.has_ci(names, "BusinessEventId") | shape, F.lit(False))

    def parse(self, df: DataFrame, raw: str, root: str) -> DataFrame:
        before = df.columns
        root, target = F.col(root), F.col("_target")
        step = df.withColumns({
            "_target": p.find_parameter(root, "Target"),
            "_names": F.transform(F.map_keys(root), lambda k: F.lower(k)), "_values": F.map_values(root),
        })
        step = step.withColumn("_target_obj", p.as_object(target))
        step = step.withColumns({
            "_t_names": F.transform(F.map_keys("_target_obj"), lambda k: F.lower(k)), "_t_values": F.map_values("_target_obj"),
        })
        # One column per member, first as JSON text and then as string: nothing is computed twice.
        texts = {f"_j_{n}": p.member_text("_names", "_values", n) for n in self.ROOT_STRINGS}
        texts |= {f"_j_T{n}": p.member_text("_t_names", "_t_values", n) for n in self.TARGET_STRINGS}
        step = p.with_attributes(step.withColumns(texts), "_target_obj", "_data")
        step = step.withColumns({f"_s_{t[3:]}": decode_str(t) for t in texts})
        step = step.withColumns({
            "_message": F.col("_s_MessageName"),
            "_operation": p.operation_of("_s_MessageName"),
            "_entity": F.coalesce("_s_PrimaryEntityName", "_s_TLogicalName"),
            "_record": p.first_useful_id("_s_PrimaryEntityId", "_s_TId"),
            "_occurred": F.coalesce(*[p.parse_date(f"_s_{n}") for n in self.TIMES]),
            "_user": p.first_useful_id(*[f"_s_{n}" for n in self.USERS]),
            # A payload without a correlation gets one from its text, so a retried task gives the same.
            "_correlation": F.coalesce(p.first_useful_id("_s_CorrelationId"), F.md5(F.col(raw))),
        })
        error = F.when(F.col(raw).isNotNull(), F.coalesce(
            F.when(root.isNull(), F.lit("payload is not a JSON object")),
            F.when(F.col("_message").isNull(), F.lit("payload has no MessageName")),
            F.when(F.col("_operation").isNull(),
                   F.concat(F.lit("unsupported MessageName '"), F.col("_message"), F.lit("'"))),
            F.when(target.isNull(), F.lit("payload has no Target input parameter")),
            F.when(F.col("_entity").isNull(), F.lit("payload names no entity")),
            F.when(F.col("_record").isNull(), F.lit("payload names no record")),
            F.when(F.col("_occurred").isNull(), F.lit("payload has no readable change time")),
        ))
        step = step.withColumn("error", error)
        event = F.struct(
            F.lit(self.system_name).alias("source_system"),
            F.col("_entity").alias("entity_name"),
            F.col("_record").alias("source_record_id"),
            F.col("_operation").alias("operation"),
            F.col("_occurred").alias("occurred_at"),
            p.company_of("_data").alias("company"),
            F.col("_data").alias("data"),
            F.col("_user").alias("originating_user_id"),
            F.col("_correlation").alias("correlation_id"),
        )
        readable = F.col(raw).isNotNull() & F.col("error").isNull()
        return step.withColumn("event", F.when(readable, event)).select(*before, "event", "error")


def read_raw(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One payload per line: column `raw`. A streaming read takes files as they land."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "raw")


def select_parser(df: DataFrame, parsers: Sequence[PayloadParser], raw: str = "raw") -> DataFrame:
    """Add `parser`: the first registered parser that recognises the payload, else null."""
    return _select(df.withColumn("_root", root_of(raw)), parsers).drop("_root")


def _select(df: DataFrame, parsers: Sequence[PayloadParser]) -> DataFrame:
    return df.withColumn("parser", F.coalesce(*[F.when(q.sniff(F.col("_root")), F.lit(q.system_name)) for q in parsers]))


def parse_events(df: DataFrame, parsers: Sequence[PayloadParser], raw: str = "raw") -> DataFrame:
    """Add `parser`, `event` and `error`; a payload no parser knows is an error too. The JSON text
    is read once, whatever the number of parsers."""
    base = [*df.columns, "parser"]
    out = _select(df.withColumn("_root", root_of(raw)), parsers)
    events, errors = [], []
    for i, q in enumerate(parsers):
        mine = F.col("parser") == q.system_name
        out = out.withColumns({f"_raw_{i}": F.when(mine, F.col(raw)), f"_root_{i}": F.when(mine, F.col("_root"))})
        out = q.parse(out, f"_raw_{i}", f"_root_{i}").withColumnsRenamed({"event": f"_event_{i}", "error": f"_error_{i}"})
        events.append(F.col(f"_event_{i}"))
        errors.append(F.col(f"_error_{i}"))
    known = ", ".join(q.system_name for q in parsers)
    unknown = F.when(F.col("parser").isNull(), F.lit(f"no registered parser ({known}) knows the payload"))
    return out.select(*base, F.coalesce(*events).alias("event"), F.coalesce(unknown, *errors).alias("error"))


def _where(parsed: DataFrame, condition: Column) -> DataFrame:
    """Filter after parsing. Left to itself, the optimizer would push the condition to the scan
    and parse everything a second time inside it; a filter does not move below a column that
    is not deterministic."""
    held = parsed.withColumn("_task", F.spark_partition_id())
    return held.filter(condition & (F.col("_task") >= 0)).drop("_task")


def accepted(parsed: DataFrame, *keep: str) -> DataFrame:
    """The normalised events, with the columns of `keep` carried along."""
    return _where(parsed, F.col("error").isNull()).select(*keep, "event.*")


def quarantine(parsed: DataFrame, *keep: str, raw: str = "raw") -> DataFrame:
    """Payloads that left the flow: whole text for replay, a prefix for reading, the reason."""
    return _where(parsed, F.col("error").isNotNull()).select(
        *keep, raw, truncate(raw, MAX_LOGGED_PAYLOAD).alias("payload_prefix"), "error"
    )


def replay_events(dead_letters: DataFrame) -> DataFrame:
    """Failed events as input again, one delivery more, once each whatever the number of maps
    they failed in. Maps that took them before absorb the repeat."""
    once = dead_letters.dropDuplicates(["source_system", "entity_name", "source_record_id", "arrival_seq"])
    return once.withColumn("delivery_count", F.col("delivery_count") + 1).select(*EVENT_COLUMNS)


def replay(dead_letters: DataFrame, raw: str = "raw") -> DataFrame:
    """Dead letters as input again. Deduplication and last-writer-wins absorb repeats."""
    return dead_letters.select(*[c for c in dead_letters.columns if c not in ("payload_prefix", "error")])
