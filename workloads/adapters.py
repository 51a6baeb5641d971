"""The test tables seen as a sync landscape: two systems, their events, links and targets.

Every Spark adapter has its SQL twin right below it, so a workload and its check start
from the same rows. Adapters only derive columns; they never drop rows to get smaller.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from changesync.functions.keys import pair_key
from changesync.functions.values import payload_hash
from changesync.operators.xref import mirrors
from changesync.sources.maps import parse_maps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a task at most: a payload takes close to a millisecond to parse.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over tasks of `TASK_ROWS` rows at most, one a core at least. Splits of the input
    say little: a row group lies in one of them whole, and their number follows bytes and cores, not rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


# --- change events ----------------------------------------------------------------------

_EVENT_COLUMNS = """
    event_id,
    CASE WHEN pk >= 75 THEN 'crm' ELSE 'erp' END AS source_system,
    CASE WHEN pk >= 75 THEN 'contact' ELSE 'Accounts' END AS entity_name,
    CASE WHEN pk >= 75 THEN 'c-' ELSE 'a-' END || user_id AS source_record_id,
    CASE event_type WHEN 'signup' THEN 'Create' WHEN 'error' THEN 'Delete' ELSE 'Update' END AS operation,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'co' || (user_id % 5) END AS company,
    CASE WHEN event_id % 20 = 0 THEN 'svc-erp' WHEN event_id % 20 = 3 THEN 'svc-crm' ELSE 'u' || user_id END
        AS originating_user_id,
    'corr-' || event_id AS correlation_id,
    (event_id + (event_id * 7919) % 600) * 600 + event_id % 600 AS arrival_seq,
    user_id, pk, pk % 4 AS k,
    CASE WHEN pk >= 75 AND user_id % 7 = 3 THEN 'Q' ELSE 'R' END || user_id AS ref,
    '  Tag ' || (pk % 4) || ' ' AS tag,
    event_id % 10 <> 0 AS has_amount,
    CASE WHEN event_id % 10 > 1 THEN CAST(round(value * 100) AS BIGINT) END AS amount
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of users: `erp` accounts and `crm` contacts, arriving out of order."""
    return events_of(spread(table(spark, sf_dir, "events")))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return events_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def events_of(rows: DataFrame) -> DataFrame:
    base = rows.withColumn("pk", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    late = F.make_dt_interval(secs=((F.col("event_id") * 7919) % 600).cast("decimal(18,6)"))
    out = base.withColumn("occurred_at", at).withColumn("enqueued_at", at + late).selectExpr(
        *[c.strip() for c in _split(_EVENT_COLUMNS)], "occurred_at", "enqueued_at", "1 AS delivery_count"
    )
    body = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("k").alias("key"), F.col("k").cast("string").alias("value")),
        F.struct(F.lit("ref").alias("key"), F.concat(F.lit('"'), "ref", F.lit('"')).alias("value")),
        F.struct(F.lit("tag").alias("key"), F.concat(F.lit('"'), "tag", F.lit('"')).alias("value")),
        F.when(F.col("has_amount"), F.struct(
            F.lit("amount").alias("key"), F.coalesce(F.col("amount").cast("string"), F.lit("null")).alias("value"))),
    )))
    return out.withColumn("data", body)


def _split(columns: str) -> list[str]:
    out, depth, item = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


EV = f"""ev AS (
  SELECT {_EVENT_COLUMNS}, ts AS occurred_at, ts + to_seconds((event_id * 7919) % 600) AS enqueued_at, 1 AS delivery_count
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS pk FROM events)
), evd AS (
  SELECT *, '{{' || CASE WHEN has_amount THEN '"amount":' || coalesce(CAST(amount AS VARCHAR), 'null') || ',' ELSE '' END
    || '"k":' || k || ',"ref":"' || ref || '","tag":"' || tag || '"}}' AS data_json,
    epoch_us(occurred_at) * 10 + 621355968000000000 AS ticks
  FROM ev
)"""

CORE = [
    "source_system", "entity_name", "source_record_id", "operation", "occurred_at", "company", "data",
    "originating_user_id", "correlation_id", "arrival_seq", "enqueued_at", "delivery_count",
]


def sync_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(*CORE)


# --- maps, users, systems ---------------------------------------------------------------

SYSTEMS = {"erp": "by_id", "crm": "by_id", "dw": "by_key"}
INTEGRATION_USERS = ["SVC-ERP", "svc-crm"]

MAP_DOCUMENTS = """[
 {"name": "m1", "sourceSystem": "ERP", "sourceEntity": "Accounts", "targetSystem": "crm", "targetEntity": "contact",
  "direction": "bidirectional", "status": "active", "companies": ["co0", "CO1"], "integrationKey": ["ref"], "version": 3,
  "fields": [{"source": "k", "target": "k"}, {"source": "ref", "target": "ref"}]},
 {"name": "m2", "sourceSystem": "crm", "sourceEntity": "Contact", "targetSystem": "erp", "targetEntity": "Accounts",
  "direction": "bidirectional", "status": "active", "companies": [], "integrationKey": ["ref"], "version": 2,
  "fields": [{"source": "k", "target": "k"}, {"source": "ref", "target": "ref"}]},
 {"name": "m3", "sourceSystem": "erp", "sourceEntity": "accounts", "targetSystem": "dw", "targetEntity": "account",
  "companies": [], "integrationKey": ["ref"],
  "fields": [{"source": "k", "target": "grade", "valueMap": {"0": "gold", "1": "silver", "2": "bronze"}},
             {"source": "ref", "target": "ref"},
             {"source": "amount", "target": "amount"},
             {"source": "tag", "target": "tag", "transform": "TRIM"},
             {"source": "region", "target": "region", "defaultValue": "EMEA"}]},
 {"name": "m4", "sourceSystem": "erp", "sourceEntity": "Accounts", "targetSystem": "crm", "targetEntity": "contact",
  "status": "paused", "companies": [], "integrationKey": ["ref"], "fields": [{"source": "k", "target": "k"}]}
]"""


def maps(spark: SparkSession) -> DataFrame:
    docs = spark.range(1).select(F.explode(F.from_json(F.lit(MAP_DOCUMENTS), "ARRAY<VARIANT>")).alias("v"))
    return parse_maps(docs.select(F.to_json("v").alias("document")))


MAPS = """maps(map_name, source_system, entity_name, target_system, target_entity, pair_key, companies) AS (VALUES
  ('m1', 'erp', 'Accounts', 'crm', 'contact', 'crm:contact|erp:accounts', ['co0', 'co1']),
  ('m2', 'crm', 'contact', 'erp', 'Accounts', 'crm:contact|erp:accounts', CAST([] AS VARCHAR[])),
  ('m3', 'erp', 'Accounts', 'dw', 'account', 'dw:account|erp:accounts', CAST([] AS VARCHAR[])))"""

ROUTED = """routed AS (
  SELECT e.*, m.map_name, m.target_system, m.target_entity, m.pair_key
  FROM evd e JOIN maps m USING (source_system, entity_name)
), admitted AS (
  SELECT r.* FROM routed r JOIN maps m USING (map_name)
  WHERE len(m.companies) = 0 OR list_contains(m.companies, lower(r.company))
     OR (r.company IS NULL AND r.operation = 'Delete')
)"""


def integration_users(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(u) for u in INTEGRATION_USERS])).alias("user_id"))


# --- links and targets ------------------------------------------------------------------

def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link per customer already synced: its account and its contact. Some links have no
    state yet, some were deleted."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'HOUSEHOLD'")
    written = F.create_map(
        F.lit("k"), (F.col("c_nationkey") % 4).cast("string"), F.lit("ref"), F.concat(F.lit('"R'), "c_custkey", F.lit('"'))
    )
    tomb = F.col("c_acctbal") < 500
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(c_nationkey)")
    state = F.struct(
        F.lit("crm").alias("written_to_system"),
        F.when(tomb, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array(F.lit("k"), F.lit("ref"))).alias("written_fields"),
        F.when(tomb, F.lit("")).otherwise(payload_hash(written)).alias("written_payload_hash"),
        F.lit("erp").alias("last_writer_system"),
        day.alias("last_writer_at"),
    )
    return c.select(
        pair_key(F.lit("erp"), F.lit("Accounts"), F.lit("crm"), F.lit("contact")).alias("pair_key"),
        F.lit("erp").alias("system_a"), F.concat(F.lit("a-"), "c_custkey").alias("record_id_a"),
        F.lit("crm").alias("system_b"), F.concat(F.lit("c-"), "c_custkey").alias("record_id_b"),
        F.when(F.col("c_mktsegment") != "MACHINERY", state).alias("state"),
        (F.col("c_nationkey") % 3 + 1).cast("bigint").alias("version"),
    )


def xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrors(links(spark, sf_dir))


LINKS = """links AS (
  SELECT c_custkey AS u, 'crm:contact|erp:accounts' AS pair_key, 'erp' AS system_a, 'a-' || c_custkey AS record_id_a,
    'crm' AS system_b, 'c-' || c_custkey AS record_id_b, c_mktsegment <> 'MACHINERY' AS has_state,
    c_acctbal < 500 AS tomb,
    CASE WHEN c_acctbal < 500 THEN '' ELSE upper(sha256('{"k":' || (c_nationkey % 4) || ',"ref":"R' || c_custkey || '"}')) END AS hash,
    TIMESTAMP '2024-01-01' + to_days(c_nationkey) AS lw_at, CAST(c_nationkey % 3 + 1 AS BIGINT) AS version
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
)"""


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target snapshots: every contact and account, and the warehouse rows that exist."""
    c = table(spark, sf_dir, "customer")
    k = (F.col("c_nationkey") % 4).cast("string")
    contact_ref = F.when(F.col("c_custkey") % 7 == 3, F.concat(F.lit("Q"), "c_custkey")).otherwise(F.concat(F.lit("R"), "c_custkey"))
    account_ref = F.concat(F.lit("R"), "c_custkey")

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    rows = F.array_compact(F.array(
        F.struct(F.lit("crm").alias("system"), F.lit("contact").alias("entity_name"), F.concat(F.lit("c-"), "c_custkey").alias("record_id"),
                 F.create_map(F.lit("k"), k, F.lit("ref"), quoted(contact_ref), F.lit("name"), quoted(F.col("c_name"))).alias("fields")),
        F.struct(F.lit("erp").alias("system"), F.lit("Accounts").alias("entity_name"), F.concat(F.lit("a-"), "c_custkey").alias("record_id"),
                 F.create_map(F.lit("ref"), quoted(account_ref)).alias("fields")),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.struct(
            F.lit("dw").alias("system"), F.lit("account").alias("entity_name"), F.concat(F.lit("ref='"), account_ref, F.lit("'")).alias("record_id"),
            F.create_map(F.lit("ref"), quoted(account_ref), F.lit("segment"), quoted(F.col("c_mktsegment"))).alias("fields"))),
    ))
    return c.select(F.explode(rows).alias("r")).select("r.*")
