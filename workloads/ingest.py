"""Raw payloads: recognising, parsing, quarantine, replay, publishing and duplicates."""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions import payload as p
from changesync.functions.values import canonical_json, decode_str
from changesync.operators import dedupe, prefix
from changesync.session import ensure_checkpoint_dir
from changesync.sources import ingest
from changesync.storage import Scratch
from changesync.streaming import pipeline as flow
from workloads import adapters as a
from workloads.functions import MESSAGE_ID
from workloads.registry import workload

# One payload per event. pk decides its flaws: 7 is no JSON, 8 lacks a target, 9 has a message
# name nobody knows, 10 is a list, 11 has no time; 12 and 13 carry the all-zero id, and from 20
# to 29 the envelope is spelled in lower case. crm events come in that system's flat shape.
_DATE = "'/Date(' || unix_millis(occurred_at) || CASE WHEN pk % 2 = 0 THEN '+0000' ELSE '' END || ')/'"
_ISO = "date_format(occurred_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || 'Z'"
_ATTRIBUTES = """'[{"key":"k","value":{"__type":"OptionSetValue","Value":' || k || '}},' ||
  '{"key":"ref","value":{"Id":"' || ref || '","LogicalName":"account"}},' ||
  CASE WHEN has_amount THEN '{"key":"amount","value":' || CASE WHEN amount IS NULL THEN 'null' ELSE '{"value":{"Value":' || amount || '}}' END || '},' ELSE '' END ||
  CASE WHEN company IS NULL THEN '' ELSE '{"Key":"dataAreaId","Value":"' || company || '"},' END ||
  '{"key":"seen","value":"/Date(' || unix_millis(occurred_at) || ')/"},{"key":"tag","value":"dropped"},{"nokey":1},' ||
  '{"key":"tag","value":"' || tag || '"}]'"""
_TIME = f"""CASE WHEN pk = 11 THEN '' WHEN pk % 3 = 0 THEN '"EventTimeIso8601":"' || {_ISO} || '",'
  WHEN pk % 3 = 1 THEN '"EventTimeIso8601":"soon","EventTime":"' || {_DATE} || '",' ELSE '"OperationCreatedOn":"' || {_DATE} || '",' END"""
_MESSAGE = """CASE WHEN pk = 9 THEN 'Assign' WHEN pk % 2 = 0 THEN operation
  ELSE CASE operation WHEN 'Create' THEN 'OnExternalCreated' WHEN 'Update' THEN 'OnExternalUpdated' ELSE 'OnExternalDeleted' END END"""
_ZERO = "00000000-0000-0000-0000-000000000000"
_ERP = f"""'{{"' || CASE WHEN pk BETWEEN 20 AND 29 THEN 'messagename' ELSE 'MessageName' END || '":"' || {_MESSAGE} || '",' || {_TIME} ||
  '"BusinessEventId":"be","PrimaryEntityName":"' || entity_name || '",' ||
  '"PrimaryEntityId":"' || CASE WHEN pk IN (12, 13) THEN '{_ZERO}' ELSE source_record_id END || '",' ||
  '"CorrelationId":"' || correlation_id || '","InitiatingUserAADObjectId":"  ","UserId":"' || originating_user_id || '",' ||
  '"InputParameters":[{{"key":"Other","value":1}}' || CASE WHEN pk = 8 THEN '' ELSE
  ',{{"Key":"target","Value":{{"Id":"' || source_record_id || '","Attributes":' || {_ATTRIBUTES} || '}}}}' END || ']}}'"""
_CRM = """'{"entity":"' || entity_name || '","id":"' || source_record_id || '","op":"' || operation || '","at":"' ||
  date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || 'Z","user":"' || originating_user_id || '","correlation":"' || correlation_id || '"}'"""


def payloads(spark, sf_dir) -> DataFrame:
    return a.events(spark, sf_dir).selectExpr(
        "*", f"CASE WHEN pk = 7 THEN 'not json ' || event_id WHEN pk = 10 THEN '[' || event_id || ']' WHEN source_system = 'crm' THEN {_CRM} ELSE {_ERP} END AS raw"
    ).select("event_id", "raw", "arrival_seq", "enqueued_at", "delivery_count")


class FlatParser:
    """A second system's parser, as a plug-in would write it: flat JSON objects."""

    system_name = "crm"

    def sniff(self, root: Column) -> Column:
        return F.coalesce(F.map_contains_key(root, F.lit("entity")) & F.map_contains_key(root, F.lit("op")), F.lit(False))

    def parse(self, df: DataFrame, raw: str, root: str) -> DataFrame:
        keep = df.columns
        text = lambda n: F.try_variant_get(F.try_element_at(F.col(root), F.lit(n)), "$", "string")
        members = [text(n).alias(n) for n in ("entity", "id", "op", "user", "correlation")]
        b = df.withColumn("_b", F.struct(*members, text("at").try_cast("timestamp").alias("at")))
        event = F.struct(
            F.lit(self.system_name).alias("source_system"), F.col("_b.entity").alias("entity_name"),
            F.col("_b.id").alias("source_record_id"), F.col("_b.op").alias("operation"), F.col("_b.at").alias("occurred_at"),
            F.lit(None).cast("string").alias("company"), F.expr("CAST(map() AS MAP<STRING,STRING>)").alias("data"),
            F.col("_b.user").alias("originating_user_id"), F.col("_b.correlation").alias("correlation_id"),
        )
        ok = F.col(raw).isNotNull() & F.col("_b.id").isNotNull()
        error = F.when(F.col(raw).isNotNull() & F.col("_b.id").isNull(), F.lit("payload has no id"))
        return b.withColumn("event", F.when(ok, event)).withColumn("error", error).select(*keep, "event", "error")


PARSERS = [ingest.ContextParser("erp"), FlatParser()]


def parsed(spark, sf_dir) -> DataFrame:
    return ingest.parse_events(payloads(spark, sf_dir), PARSERS)


EV = f"WITH {a.EV}"
READABLE = "pk NOT IN (7, 8, 9, 10, 11)"
# What the parser must read from the payload of an event. Dates other than ISO carry milliseconds.
READ = f"""{EV}, read AS (
  SELECT *, CASE WHEN source_system = 'crm' OR pk % 3 = 0 THEN epoch_us(occurred_at) ELSE epoch_us(occurred_at) // 1000 * 1000 END AS at_us,
    CASE WHEN source_system = 'crm' THEN NULL ELSE company END AS read_company,
    strftime(make_timestamp(epoch_us(occurred_at) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S') AS sec, epoch_us(occurred_at) // 1000 % 1000 AS ms
  FROM ev
), bodies AS (
  SELECT *, CASE WHEN source_system = 'crm' THEN '{{}}' ELSE '{{' ||
    CASE WHEN has_amount THEN '"amount":' || coalesce(CAST(amount AS VARCHAR), 'null') || ',' ELSE '' END ||
    CASE WHEN company IS NULL THEN '' ELSE '"dataAreaId":"' || company || '",' END ||
    '"k":' || k || ',"ref":"' || ref || '","seen":"' || sec || CASE WHEN ms = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(ms AS VARCHAR), 3, '0'), '0') END ||
    '+00:00","tag":"' || tag || '"}}' END AS body
  FROM read
)"""


@workload("ingest_raw", f"{EV} SELECT event_id, TRUE AS has_text FROM ev")
def ingest_raw(spark, sf_dir):
    return payloads(spark, sf_dir).select("event_id", (F.length("raw") > 0).alias("has_text"))


@workload("sniff_payload", f"{EV} SELECT event_id, source_system = 'erp' AND pk NOT IN (7, 10) AS erp FROM ev")
def sniff_payload(spark, sf_dir):
    return payloads(spark, sf_dir).select("event_id", PARSERS[0].sniff(ingest.root_of("raw")).alias("erp"))


@workload("parser_select", f"{EV} SELECT event_id, CASE WHEN pk NOT IN (7, 10) THEN source_system END AS parser FROM ev")
def parser_select(spark, sf_dir):
    return ingest.select_parser(payloads(spark, sf_dir), PARSERS).select("event_id", "parser")


@workload("parse_events", f"""{READ} SELECT event_id, source_system, entity_name, source_record_id, operation, at_us, read_company AS company,
  body AS data, originating_user_id, correlation_id FROM bodies WHERE {READABLE}""")
def parse_events(spark, sf_dir):
    events = ingest.accepted(parsed(spark, sf_dir), "event_id")
    return events.select(
        "event_id", "source_system", "entity_name", "source_record_id", "operation", F.unix_micros("occurred_at").alias("at_us"),
        "company", canonical_json("data").alias("data"), "originating_user_id", "correlation_id",
    )


ERROR = """CASE pk WHEN 8 THEN 'payload has no Target input parameter' WHEN 9 THEN 'unsupported MessageName ''Assign'''
  WHEN 11 THEN 'payload has no readable change time' ELSE 'no registered parser (erp, crm) knows the payload' END"""


@workload("quarantine", f"{EV} SELECT event_id, {ERROR} AS error FROM ev WHERE NOT ({READABLE})")
def quarantine(spark, sf_dir):
    return ingest.quarantine(parsed(spark, sf_dir), "event_id").select("event_id", "error")


@workload("ingest_flow", f"""{READ} SELECT source_system, source_record_id, operation, at_us, body AS data, correlation_id, CAST(NULL AS VARCHAR) AS error FROM bodies WHERE {READABLE}
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, {ERROR} FROM ev WHERE NOT ({READABLE})""")
def ingest_flow(spark, sf_dir):
    """Payload files read as a stream, published to the change log or quarantined, in two batches; the
    second start goes on where the first ended."""
    root = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    for half in (0, 1):
        payloads(spark, sf_dir).filter(F.col("event_id") % 2 == half).select("raw").write.mode("append").text(f"{root}/in")
        flow.ingest_stream(
            ingest.read_raw(spark, f"{root}/in", streaming=True), PARSERS, f"{root}/log", f"{root}/quarantine", f"{root}/offsets", available_now=True
        ).awaitTermination()
    events, bad = spark.read.parquet(f"{root}/log"), spark.read.parquet(f"{root}/quarantine")
    read = events.select(
        "source_system", "source_record_id", "operation", F.unix_micros("occurred_at").alias("at_us"), canonical_json("data").alias("data"),
        "correlation_id", F.lit(None).cast("string").alias("error"),
    )
    return read.unionByName(bad.select("error"), allowMissingColumns=True)


@workload("dlq_replay", f"""{READ} SELECT message_id, count(*) AS deliveries FROM (
    SELECT {MESSAGE_ID} AS message_id FROM (SELECT * REPLACE (make_timestamp(at_us) AS occurred_at), body AS data_json,
      at_us * 10 + 621355968000000000 AS ticks FROM bodies WHERE {READABLE})) GROUP BY message_id""")
def dlq_replay(spark, sf_dir):
    """Dead letters and the live flow go through ingestion again together; duplicates collapse
    and what was unreadable stays out."""
    keep = ["arrival_seq", "enqueued_at", "delivery_count"]
    live = ingest.parse_events(payloads(spark, sf_dir).select("raw", *keep), PARSERS)
    live = Scratch(spark).keep(live.withColumn("raw", F.when(F.col("error").isNotNull(), F.col("raw"))), "live")
    dead = ingest.parse_events(ingest.replay(ingest.quarantine(live, *keep)), PARSERS)
    again = ingest.accepted(live, *keep).unionByName(ingest.accepted(dead, *keep))
    published = dedupe.envelope(again)
    return published.groupBy("message_id").agg(F.count("*").alias("deliveries"))


# --- payload functions ------------------------------------------------------------------

def _roots(spark, sf_dir) -> DataFrame:
    root = p.as_object(F.try_parse_json("raw"))
    return payloads(spark, sf_dir).withColumn("root", root)


@workload("fn_get_ci", f"{EV} SELECT event_id, CASE WHEN source_system = 'erp' AND pk NOT IN (7, 10) THEN 'be' END AS business_event FROM ev")
def fn_get_ci(spark, sf_dir):
    found = _roots(spark, sf_dir).withColumn("v", F.to_json(p.get_ci(F.col("root"), "BUSINESSEVENTID")))
    return found.select("event_id", decode_str("v").alias("business_event"))


@workload("fn_operation", f"""{EV} SELECT event_id, CASE WHEN source_system = 'erp' AND pk NOT IN (7, 9, 10) THEN operation END AS operation FROM ev""")
def fn_operation(spark, sf_dir):
    found = _roots(spark, sf_dir).withColumn("v", F.to_json(p.get_ci(F.col("root"), "MessageName"))).withColumn("m", decode_str("v"))
    return found.select("event_id", p.operation_of("m").alias("operation"))


@workload("fn_find_parameter", f"{EV} SELECT event_id, CASE WHEN source_system = 'erp' AND pk NOT IN (7, 8, 10) THEN source_record_id END AS target_id FROM ev")
def fn_find_parameter(spark, sf_dir):
    found = _roots(spark, sf_dir).withColumn("t", p.as_object(p.find_parameter(F.col("root"), "TARGET")))
    return found.withColumn("v", F.to_json(p.get_ci(F.col("t"), "id"))).select("event_id", decode_str("v").alias("target_id"))


def _bodies(spark, sf_dir) -> DataFrame:
    found = _roots(spark, sf_dir).withColumn("t", p.as_object(p.find_parameter(F.col("root"), "Target")))
    return p.with_attributes(found, "t", "data")


@workload("fn_attributes", f"""{READ} SELECT event_id, CASE WHEN source_system = 'erp' AND pk NOT IN (7, 8, 10) THEN body ELSE '{{}}' END AS data FROM bodies""")
def fn_attributes(spark, sf_dir):
    read = _bodies(spark, sf_dir)
    return read.select("event_id", canonical_json("data").alias("data"))


@workload("fn_flatten", f"""{EV} SELECT event_id, CASE WHEN ok THEN CAST(k AS VARCHAR) END AS k, CASE WHEN ok THEN '"' || ref || '"' END AS ref,
  CASE WHEN ok AND has_amount THEN coalesce(CAST(amount AS VARCHAR), 'null') END AS amount
  FROM (SELECT *, source_system = 'erp' AND pk NOT IN (7, 8, 10) AS ok FROM ev)""")
def fn_flatten(spark, sf_dir):
    read = _bodies(spark, sf_dir)
    return read.select("event_id", *[F.try_element_at("data", F.lit(n)).alias(n) for n in ("k", "ref", "amount")])


@workload("fn_dates", f"""{EV} SELECT event_id, epoch_us(occurred_at) // 1000 * 1000 AS wire_us, epoch_us(occurred_at) AS iso_us,
  FALSE AS junk_read, epoch_us(occurred_at) AS first_us FROM ev""")
def fn_dates(spark, sf_dir):
    e = a.events(spark, sf_dir).selectExpr("event_id", f"{_DATE} AS wire", f"{_ISO} AS iso", "'soon ' || event_id AS junk")
    first = F.coalesce(*[p.parse_date(c) for c in ("junk", "iso", "wire")])
    return e.select(
        "event_id", *[F.unix_micros(p.parse_date(c)).alias(f"{c}_us") for c in ("wire", "iso")],
        p.parse_date("junk").isNotNull().alias("junk_read"),
        F.unix_micros(first).alias("first_us"),
    )


@workload("fn_first_useful_id", f"""{EV} SELECT event_id, CASE WHEN pk IN (12, 13) OR pk % 5 = 0 OR company IS NULL THEN source_record_id ELSE company END AS id FROM ev""")
def fn_first_useful_id(spark, sf_dir):
    e = a.events(spark, sf_dir).selectExpr(
        "event_id", "source_record_id", f"CASE WHEN pk IN (12, 13) THEN '{{{_ZERO}}}' WHEN pk % 5 = 0 THEN '  ' ELSE company END AS first"
    )
    return e.select("event_id", p.first_useful_id("first", "source_record_id").alias("id"))


@workload("fn_company", f"{EV} SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE company END AS company FROM ev")
def fn_company(spark, sf_dir):
    value = F.when(F.col("k") == 3, F.lit("17")).otherwise(F.concat(F.lit('"'), "company", F.lit('"')))
    name = F.when(F.col("k") == 1, F.lit("MSERP_dataareaid")).otherwise(F.lit("DataAreaID"))
    body = F.when(F.col("company").isNotNull(), F.create_map(F.lit("ref"), F.lit('"x"'), name, value)).otherwise(F.col("data"))
    return a.events(spark, sf_dir).withColumn("body", body).select("event_id", p.company_of("body").alias("company"))


# --- publishing and duplicates ----------------------------------------------------------

@workload("publish_changes", f"""{EV} SELECT event_id, source_system || ':' || entity_name || ':' || source_record_id AS session_id,
  {MESSAGE_ID} AS message_id, correlation_id FROM evd""")
def publish_changes(spark, sf_dir):
    return dedupe.envelope(a.events(spark, sf_dir)).select("event_id", "session_id", "message_id", "correlation_id")


def deliveries_of(events: DataFrame) -> DataFrame:
    """Every event delivered, and those of larger amounts a second time, nine minutes later."""
    once = dedupe.envelope(events)
    late = F.make_dt_interval(mins=F.lit(9))
    twice = F.when(F.col("amount") > 4000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    many = once.withColumn("copy", F.explode(twice))
    return many.withColumns({
        "enqueued_at": F.when(F.col("copy") == 1, F.col("enqueued_at") + late).otherwise(F.col("enqueued_at")),
        "arrival_seq": F.col("arrival_seq") + F.col("copy") * 1_000_000_000, "delivery_count": F.col("copy") + 1,
    })


@workload("dedupe_batch", f"{EV} SELECT {MESSAGE_ID} AS message_id, event_id, arrival_seq, 1 AS delivery_count FROM evd")
def dedupe_batch(spark, sf_dir):
    first = dedupe.first_of_duplicates(deliveries_of(a.events(spark, sf_dir)))
    return first.select("message_id", "event_id", "arrival_seq", "delivery_count")


@workload("session_order", f"""{EV} SELECT event_id, row_number() OVER (PARTITION BY source_system, entity_name, source_record_id ORDER BY arrival_seq) AS position FROM ev""")
def session_order(spark, sf_dir):
    sessions = dedupe.envelope(a.events(spark, sf_dir))
    chunked = prefix.with_bucket(sessions)
    return prefix.position(chunked, ["session_id"], ["arrival_seq"]).select("event_id", "position")


@workload("lww_running_max", f"""{EV}, w AS (
  SELECT event_id, occurred_at, max(occurred_at) OVER (PARTITION BY source_system, source_record_id ORDER BY arrival_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev)
  SELECT event_id, coalesce(epoch_us(seen), 0) AS seen_us, coalesce(occurred_at < seen, FALSE) AS discarded FROM w""")
def lww_running_max(spark, sf_dir):
    from changesync.operators.resolve import lww_discards

    chunked = prefix.with_bucket(a.events(spark, sf_dir))
    seen = prefix.running_before(
        chunked, ["source_system", "source_record_id"], ["arrival_seq"], {"seen": ("max", F.col("occurred_at"))}
    )
    return seen.select("event_id", F.coalesce(F.unix_micros("seen"), F.lit(0)).alias("seen_us"), lww_discards("occurred_at", "seen").alias("discarded"))
