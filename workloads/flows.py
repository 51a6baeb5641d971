"""Pulls, scheduled runs, history, metrics and streams."""

import uuid

from pyspark.sql import DataFrame, functions as F

from changesync.functions.values import canonical_json
from changesync.operators import dedupe, history as log, metrics
from changesync.plans import capture, scheduled
from changesync.schema import FAILED
from changesync.session import ensure_checkpoint_dir
from changesync.sources import maps as map_store, pull
from changesync.storage import KeyedTable
from workloads import adapters as a
from workloads.functions import MESSAGE_ID
from workloads.ingest import deliveries_of
from workloads.registry import workload

ORDERS = pull.Entity("erp", "Orders", ("o_orderkey", "o_custkey"), "o_orderdate", "o_orderpriority")
RUN_AT = "TIMESTAMP '2001-01-01 06:00:00'"
TOKEN = "1998-01-01T00:00:00.0000000+00:00"

# --- pulls ------------------------------------------------------------------------------


def _pulled(events: DataFrame) -> DataFrame:
    return events.select("source_record_id", "operation", F.unix_micros("occurred_at").alias("at_us"), "company")


PULLED = "SELECT 'o_custkey=' || o_custkey || ',o_orderkey=' || o_orderkey AS source_record_id, 'Update' AS operation, epoch_us(o_orderdate) AS at_us, o_orderpriority AS company FROM orders"


@workload("pull_full", PULLED)
def pull_full(spark, sf_dir):
    return _pulled(pull.pull_changes(a.table(spark, sf_dir, "orders"), ORDERS, F.expr(RUN_AT)))


@workload("pull_incremental", f"{PULLED} WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def pull_incremental(spark, sf_dir):
    return _pulled(pull.pull_changes(a.table(spark, sf_dir, "orders"), ORDERS, F.expr(RUN_AT), TOKEN))


@workload("pull_company", f"{PULLED} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def pull_company(spark, sf_dir):
    return _pulled(pull.pull_changes(a.table(spark, sf_dir, "orders"), ORDERS, F.expr(RUN_AT), companies=["1-URGENT", "5-LOW"]))


@workload("pull_keys_only", "SELECT 'o_custkey=' || o_custkey || ',o_orderkey=' || o_orderkey AS source_record_id, '{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || '}' AS data FROM orders")
def pull_keys_only(spark, sf_dir):
    keys = pull.pull_changes(a.table(spark, sf_dir, "orders"), ORDERS, F.expr(RUN_AT), keys_only=True)
    return keys.select("source_record_id", canonical_json("data").alias("data"))


def order_pages(spark, sf_dir) -> DataFrame:
    """A result page per order: the order, and its customer's copy without a change time."""
    day = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z'"
    page = f"""'{{"@count":2,"value":[{{"@etag":"w","dataAreaId":"' || o_orderpriority || '","No":' || o_orderkey || ',"Modified":"' || {day} || '","Status":"' || o_orderstatus ||
      '"}},{{"DATAAREAID":"' || o_orderpriority || '","no":"C' || o_orderkey || '","Modified":null}}],"@nextLink":"' || o_orderkey || '"}}'"""
    return a.table(spark, sf_dir, "orders").selectExpr(f"{page} AS page")


PAGE_ENTITY = pull.Entity("erp", "OrderHeaders", ("dataAreaId", "No"), "Modified", "dataAreaId")


@workload("explode_pages", """SELECT '{"Modified":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z","No":' || o_orderkey || ',"Status":"' || o_orderstatus || '","dataAreaId":"' || o_orderpriority || '"}' AS data FROM orders
  UNION ALL SELECT '{"DATAAREAID":"' || o_orderpriority || '","Modified":null,"no":"C' || o_orderkey || '"}' FROM orders""")
def explode_pages(spark, sf_dir):
    return pull.explode_pages(order_pages(spark, sf_dir)).select(canonical_json("data").alias("data"))


@workload("pull_to_events", f"""SELECT 'dataAreaId=''' || o_orderpriority || ''',No=' || o_orderkey AS source_record_id, 'Update' AS operation, epoch_us(o_orderdate) AS at_us, o_orderpriority AS company FROM orders
  UNION ALL SELECT 'dataAreaId=''' || o_orderpriority || ''',No=''C' || o_orderkey || '''', 'Update', epoch_us({RUN_AT}), o_orderpriority FROM orders""")
def pull_to_events(spark, sf_dir):
    return _pulled(pull.to_events(pull.explode_pages(order_pages(spark, sf_dir)), PAGE_ENTITY, F.expr(RUN_AT)))


@workload("initial_export", """SELECT 'c_custkey=' || c_custkey AS record_id, '{"c_acctbal":' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS data FROM customer""")
def initial_export(spark, sf_dir):
    entity = pull.Entity("erp", "Customers", ("c_custkey",))
    return pull.export_entity(a.table(spark, sf_dir, "customer"), entity).select("record_id", canonical_json("data").alias("data"))


# --- change capture by snapshots --------------------------------------------------------


def captured(spark, sf_dir) -> capture.Capture:
    """Two pulls of the orders, the first before 1998. Later, orders of the lowest priority are gone and
    open ones have another total; the ones of 1998 are new."""
    orders = a.table(spark, sf_dir, "orders")
    then = orders.filter("o_orderdate < TIMESTAMP '1998-01-01'")
    now = orders.filter("o_orderpriority <> '5-LOW'").withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0))
    first = capture.capture(then, ORDERS, spark.createDataFrame([], capture.SNAPSHOT), F.expr(RUN_AT))
    return capture.capture(now, ORDERS, first.snapshot, F.expr(RUN_AT))


@workload("snapshot_changes", f"""WITH o AS (SELECT 'o_custkey=' || o_custkey || ',o_orderkey=' || o_orderkey AS source_record_id, o_orderdate < TIMESTAMP '1998-01-01' AS before,
    o_orderpriority <> '5-LOW' AS alive, o_orderstatus = 'O' AS moved, epoch_us(o_orderdate) AS at_us, o_orderpriority AS company FROM orders)
  SELECT source_record_id, CASE WHEN alive AND NOT before THEN 'Create' WHEN alive THEN 'Update' ELSE 'Delete' END AS operation,
    CASE WHEN alive THEN at_us ELSE epoch_us({RUN_AT}) END AS at_us, company
  FROM o WHERE CASE WHEN alive THEN NOT before OR moved ELSE before END""")
def snapshot_changes(spark, sf_dir):
    return _pulled(captured(spark, sf_dir).events)


# --- scheduled runs ---------------------------------------------------------------------

ACCOUNTS = pull.Entity("erp", "Accounts", ("u",), "changed", "company")
FINISHED = "o_orderstatus = 'F'"


def accounts(spark, sf_dir) -> DataFrame:
    """The source still knows the customers of finished orders."""
    return a.table(spark, sf_dir, "orders").filter(FINISHED).selectExpr(
        "o_custkey AS u", "o_orderdate AS changed", "o_orderpriority AS company")


def account_links(spark, sf_dir) -> DataFrame:
    """The links of the pair, and of another one that knows records of its own."""
    own = a.links(spark, sf_dir).withColumn("record_id_a", F.concat(F.lit("U="), F.substring("record_id_a", 3, 20)))
    other = own.withColumns({"pair_key": F.lit("dw:lead|erp:accounts"), "record_id_a": F.concat(F.lit("lead-"), "record_id_a"), "system_b": F.lit("dw")})
    return own.unionByName(other).withColumn("lookup_key", F.col("record_id_a"))


@workload("live_keys", f"SELECT DISTINCT 'u=' || o_custkey AS record_id FROM orders WHERE {FINISHED}")
def live_keys(spark, sf_dir):
    return pull.live_keys(accounts(spark, sf_dir), ACCOUNTS)


GONE = f"""SELECT 'U=' || u AS source_record_id, 'Delete' AS operation, epoch_us({RUN_AT}) AS at_us, CAST(NULL AS VARCHAR) AS company
  FROM links WHERE NOT (has_state AND tomb) AND u NOT IN (SELECT o_custkey FROM orders WHERE {FINISHED})"""


@workload("deletes_by_absence", f"WITH {a.LINKS} {GONE}")
def deletes_by_absence(spark, sf_dir):
    live = pull.live_keys(accounts(spark, sf_dir), ACCOUNTS)
    pair = scheduled.pair_of(nightly(spark))
    return _pulled(scheduled.deletes_by_absence(account_links(spark, sf_dir), live, pair, "erp", "Accounts", F.expr(RUN_AT)))


def nightly(spark):
    document = """{"name": "nightly", "sourceSystem": "erp", "sourceEntity": "Accounts", "targetSystem": "crm", "targetEntity": "contact", "fields": [],
      "companies": ["1-URGENT", "2-HIGH"], "schedule": {"cron": "0 0 6 * * *", "mode": "incremental", "detectDeletes": true}}"""
    return map_store.parse_maps(spark.range(1).select(F.lit(document).alias("document"))).first()


def run(spark, sf_dir) -> scheduled.ScheduledRun:
    return scheduled.scheduled_run(nightly(spark), accounts(spark, sf_dir), ACCOUNTS, account_links(spark, sf_dir), TOKEN, F.expr(RUN_AT))


CHANGED = f"FROM orders WHERE {FINISHED} AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1998-01-01'"
RUN = f"""WITH {a.LINKS}, published AS (SELECT 'u=' || o_custkey AS source_record_id, 'Update' AS operation, epoch_us(o_orderdate) AS at_us,
  o_orderpriority AS company {CHANGED} UNION ALL {GONE})"""


@workload("scheduled_run", f"{RUN} SELECT * FROM published")
def scheduled_run(spark, sf_dir):
    return _pulled(run(spark, sf_dir).events)


@workload("run_summary", f"""{RUN} SELECT 'map:nightly' AS scope, count(*) FILTER (WHERE operation <> 'Delete') AS published, count(*) FILTER (WHERE operation = 'Delete') AS deletes,
  (SELECT strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' {CHANGED}) AS token FROM published""")
def run_summary(spark, sf_dir):
    done = run(spark, sf_dir)
    totals = done.summary().withColumn("scope", F.lit("map:nightly"))
    return totals.join(done.watermark.select("scope", "token"), "scope", "left")


# --- history ----------------------------------------------------------------------------

_OUTCOME = """CASE WHEN event_type = 'error' THEN 'Failed' WHEN k = 3 THEN 'EchoSuppressed' WHEN k = 2 THEN 'DiscardedByLastWriterWins'
    WHEN event_type = 'signup' THEN 'Created' ELSE 'Updated' END"""
_ERROR = """CASE WHEN event_type = 'error' THEN 'target said "no", code ' || pk || repeat('é!', pk * 30) END"""


def history(spark, sf_dir) -> DataFrame:
    """One history row per event, with errors from short to far too long."""
    base = a.table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = a.events(spark, sf_dir).join(base, "event_id").selectExpr(
        "CASE WHEN source_system = 'erp' THEN 'm/1' ELSE 'm2' END AS map_name", "enqueued_at AS processed_at", f"{_OUTCOME} AS outcome", "operation",
        "source_system", "source_record_id", "'dw' AS target_system", "CASE WHEN k < 2 THEN ref END AS target_record_id", "company", "occurred_at",
        f"{_ERROR} AS error", "delivery_count", "correlation_id")
    return rows


HISTORY = f"""WITH ev0 AS (SELECT event_id, event_type FROM events), {a.EV}, hist AS (
  SELECT CASE WHEN source_system = 'erp' THEN 'm/1' ELSE 'm2' END AS map_name, enqueued_at AS processed_at, {_OUTCOME} AS outcome, operation, source_system,
    source_record_id, 'dw' AS target_system, CASE WHEN k < 2 THEN ref END AS target_record_id, company, occurred_at, {_ERROR} AS error, delivery_count, correlation_id
  FROM ev JOIN ev0 USING (event_id))"""


@workload("history_append", f"""{HISTORY} SELECT correlation_id, replace(map_name, '/', '_') AS map_partition,
  CASE WHEN length(error) > 4000 THEN left(error, 4000) || '…' ELSE error END AS error FROM hist""")
def history_append(spark, sf_dir):
    """Written to the partitioned log, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    log.append(history(spark, sf_dir), path)
    return spark.read.parquet(path).select("correlation_id", "map_partition", "error")


@workload("history_csv", f"""{HISTORY} SELECT strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%f') || '0Z,' || outcome || ',' || operation || ',' || source_system || ',' || source_record_id || ',dw,' ||
  coalesce(target_record_id, '') || ',' || coalesce(company, '') || ',1,' || correlation_id || ',' ||
  CASE WHEN error IS NULL THEN '' ELSE '"' || replace(error, '"', '""') || '"' END AS line FROM hist""")
def history_csv(spark, sf_dir):
    return log.csv_line(history(spark, sf_dir))


@workload("history_filter", f"{HISTORY} SELECT correlation_id, outcome FROM hist WHERE outcome = 'Failed'")
def history_filter(spark, sf_dir):
    return log.filter_outcome(history(spark, sf_dir), "Failed").select("correlation_id", "outcome")


@workload("history_summary", f"{HISTORY} SELECT map_name, outcome, count(*) AS entries FROM hist GROUP BY ALL")
def history_summary(spark, sf_dir):
    return log.summary(history(spark, sf_dir))


CURSOR = "TIMESTAMP '2024-01-15 12:00:00'"
_PAGE = "SELECT correlation_id, epoch_us(processed_at) AS processed_us, TRUE AS maybe_more FROM hist WHERE map_name = 'm/1' {0} ORDER BY processed_at DESC, correlation_id LIMIT 50"


@workload("history_page", f"{HISTORY} {_PAGE.format('')}")
def history_page(spark, sf_dir):
    return log.page(history(spark, sf_dir), "m/1").select("correlation_id", F.unix_micros("processed_at").alias("processed_us"), "maybe_more")


@workload("history_page_next", f"{HISTORY} {_PAGE.format('AND processed_at < ' + CURSOR)}")
def history_page_next(spark, sf_dir):
    page = log.page(history(spark, sf_dir), "m/1", before=F.expr(CURSOR))
    return page.select("correlation_id", F.unix_micros("processed_at").alias("processed_us"), "maybe_more")


_TIED = HISTORY.replace("enqueued_at AS processed_at", "date_trunc('day', enqueued_at) AS processed_at")


@workload("history_page_tied", f"""{_TIED} SELECT correlation_id, epoch_us(processed_at) AS processed_us, TRUE AS maybe_more FROM hist WHERE map_name = 'm/1'
  ORDER BY processed_at DESC, correlation_id, source_record_id, delivery_count LIMIT 50 OFFSET 50""")
def history_page_tied(spark, sf_dir):
    """The second page of the stored log, where whole days have one processing time."""
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    log.append(history(spark, sf_dir).withColumn("processed_at", F.date_trunc("day", "processed_at")), path)
    stored = spark.read.parquet(path)
    last = log.page(stored, "m/1").tail(1)[0]
    return log.page(stored, "m/1", last).select("correlation_id", F.unix_micros("processed_at").alias("processed_us"), "maybe_more")


@workload("history_walk", f"""{HISTORY} SELECT epoch_us(occurred_at) AS occurred_us, company, target_record_id FROM hist WHERE map_name = 'm/1'""")
def history_walk(spark, sf_dir):
    """The stored log walked to its end, over rows that are equal in all that the caller knows them by."""
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    same = {"processed_at": F.expr(CURSOR), "correlation_id": F.lit("c"), "source_record_id": F.lit("r"), "delivery_count": F.lit(None).cast("int")}
    log.append(history(spark, sf_dir).withColumns(same), path)
    stored = spark.read.parquet(path)
    size = stored.count() // 4 + 1
    pages, last = [], None
    while True:
        found = log.page(stored, "m/1", last, size)
        pages.append(found)
        tail = found.orderBy("row_id").tail(1)
        if not tail or not tail[0]["maybe_more"]:
            break
        last = tail[0]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out.select(F.unix_micros("occurred_at").alias("occurred_us"), "company", "target_record_id")


# --- metrics ----------------------------------------------------------------------------

@workload("metrics_rates", f"""{HISTORY} SELECT map_name, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'EchoSuppressed') AS echoes,
  count(*) FILTER (WHERE outcome = 'DiscardedByLastWriterWins') AS conflicts, count(*) FILTER (WHERE outcome = 'Failed') AS failures,
  round(count(*) FILTER (WHERE outcome = 'EchoSuppressed') / count(*), 6) AS echo_rate,
  round(count(*) FILTER (WHERE outcome = 'DiscardedByLastWriterWins') / count(*), 6) AS conflict_rate FROM hist GROUP BY map_name""")
def metrics_rates(spark, sf_dir):
    return metrics.rates(history(spark, sf_dir))


@workload("metrics_latency", f"""{HISTORY}, t AS (SELECT *, epoch_us(processed_at) // 1000 - epoch_us(occurred_at) // 1000 AS ms FROM hist)
  SELECT map_name, outcome, count(*) AS entries, min(ms) AS min_ms, max(ms) AS max_ms, CAST(sum(ms) AS BIGINT) AS sum_ms FROM t GROUP BY ALL""")
def metrics_latency(spark, sf_dir):
    return metrics.latency(history(spark, sf_dir))


@workload("latency_quantiles")
def latency_quantiles(spark, sf_dir):
    """Quantiles from sketches that were stored by two batches of the history: its failures, and the rest."""
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/latency-{uuid.uuid4().hex}", metrics.LATENCY_SKETCH, ["map_name", "day"], 8)
    rows = history(spark, sf_dir)
    failed = F.col("outcome") == FAILED
    for batch, part in enumerate((rows.filter(failed), rows.filter(~failed))):
        metrics.store_latency(table, part, batch)
    return metrics.latency_quantiles(table.read())


@workload("metrics_throughput", f"""WITH {a.EV} SELECT '5 minutes' AS width, source_system, epoch_us(time_bucket(INTERVAL 5 MINUTE, enqueued_at)) AS start_us, count(*) AS events, count(*) > 5000 AS over_limit FROM ev GROUP BY ALL
  UNION ALL SELECT '1 hour', source_system, epoch_us(time_bucket(INTERVAL 1 HOUR, enqueued_at)), count(*), count(*) > 50000 FROM ev GROUP BY ALL""")
def metrics_throughput(spark, sf_dir):
    e = a.events(spark, sf_dir)
    parts = [
        metrics.throughput(e, width, limit).select(F.lit(width).alias("width"), "source_system", F.unix_micros("window_start").alias("start_us"), "events", "over_limit")
        for width, limit in (("5 minutes", metrics.EVENTS_PER_5_MINUTES), ("1 hour", metrics.EVENTS_PER_HOUR))
    ]
    return parts[0].unionByName(parts[1])


# --- streams ----------------------------------------------------------------------------

@workload("stream_dedupe", f"WITH {a.EV} SELECT {MESSAGE_ID} AS message_id, event_id FROM evd")
def stream_dedupe(spark, sf_dir):
    """Every event, some delivered twice nine minutes apart, through the ten-minute window."""
    root = f"{ensure_checkpoint_dir(spark)}/dedupe-{uuid.uuid4().hex}"
    once = dedupe.drop_stream_duplicates(deliveries_of(a.event_stream(spark, sf_dir)))
    query = (
        once.select("message_id", "event_id").writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")
