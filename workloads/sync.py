"""The pipeline end to end: outcomes, history, link state, target."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from changesync.functions.keys import pair_key
from changesync.functions.values import canonical_json
from changesync.operators import dedupe, metrics
from changesync.plans.load import loaded_links
from changesync.plans.sync import SyncConfig, SyncResult, sync_batch
from changesync.session import ensure_checkpoint_dir
from changesync.sources import ingest
from changesync.streaming.pipeline import SyncTables, sync_stream
from workloads import adapters as a
from workloads.functions import M3_BODY, M3_FULL
from workloads.registry import workload


def run_batch(spark: SparkSession, sf_dir: str, xref: DataFrame | None = None, **config) -> SyncResult:
    return sync_batch(
        a.sync_events(spark, sf_dir), a.maps(spark), a.xref(spark, sf_dir) if xref is None else xref,
        a.target(spark, sf_dir), a.integration_users(spark), SyncConfig(a.SYSTEMS, **config), F.col("enqueued_at"),
    )


# One row per event and map, grouped by link, replayed in arrival order.
def replay(links: str) -> str:
    return f"""WITH RECURSIVE {a.EV}, {a.MAPS}, {a.ROUTED}, {links}, seg AS (
  SELECT c_custkey AS u, c_mktsegment FROM customer
), rows AS (
  SELECT r.*, s.c_mktsegment, r.map_name <> 'm3' AND l.u IS NOT NULL AS link0,
    r.map_name <> 'm3' AND l.u IS NOT NULL AND l.has_state AS state0, l.hash AS hash0, l.lw_at AS at0,
    lower(r.originating_user_id) IN ('svc-erp', 'svc-crm') AS ours,
    r.map_name = 'm3' AND r.k = 3 AS map_error,
    upper(sha256('{{"k":' || r.k || ',"ref":"' || r.ref || '"}}')) AS hash,
    r.pair_key || '|' || r.user_id || CASE WHEN r.map_name <> 'm3' AND l.u IS NULL AND r.user_id % 7 = 3 THEN r.source_system ELSE '' END AS g
  FROM admitted r JOIN seg s ON s.u = r.user_id LEFT JOIN links l ON l.u = r.user_id
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY arrival_seq, map_name) AS rn FROM rows
), fold AS (
  SELECT g, rn, correlation_id, map_name, link0 AS before, state0 AS st_before, 'crm' AS wr, hash0 AS h, at0 AS lw,
    CAST(NULL AS BOOLEAN) AS ex,
    CASE WHEN ours OR (state0 AND source_system = 'crm' AND hash = hash0) THEN 'EchoSuppressed'
      WHEN state0 AND occurred_at < at0 THEN 'DiscardedByLastWriterWins'
      WHEN map_error THEN 'Failed' WHEN operation = 'Delete' THEN 'Deleted' ELSE 'Upserted' END AS v,
    target_system AS t, hash AS nh, occurred_at AS nat
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.g, n.rn, n.correlation_id, n.map_name, s.link1, s.st1, s.wr1, s.h1, s.lw1, s.ex1,
    CASE WHEN n.ours OR (s.st1 AND n.source_system = s.wr1 AND n.hash = s.h1) THEN 'EchoSuppressed'
      WHEN s.st1 AND n.occurred_at < s.lw1 THEN 'DiscardedByLastWriterWins'
      WHEN n.map_error THEN 'Failed' WHEN n.operation = 'Delete' THEN 'Deleted' ELSE 'Upserted' END,
    n.target_system, n.hash, n.occurred_at
  FROM (SELECT g, rn, before OR v = 'Upserted' AS link1,
      CASE WHEN v = 'Upserted' OR (v = 'Deleted' AND before) THEN TRUE ELSE st_before END AS st1,
      CASE WHEN v = 'Upserted' OR (v = 'Deleted' AND before) THEN t ELSE wr END AS wr1,
      CASE WHEN v = 'Upserted' THEN nh WHEN v = 'Deleted' AND before THEN '' ELSE h END AS h1,
      CASE WHEN v = 'Upserted' OR (v = 'Deleted' AND before) THEN nat ELSE lw END AS lw1,
      CASE v WHEN 'Upserted' THEN TRUE WHEN 'Deleted' THEN FALSE ELSE ex END AS ex1
    FROM fold) s
  JOIN numbered n ON n.g = s.g AND n.rn = s.rn + 1
), settled AS (
  SELECT n.*, f.before, f.h AS state_hash,
    CASE WHEN f.v <> 'Upserted' THEN f.v
      WHEN n.map_name = 'm3' THEN CASE WHEN coalesce(f.ex, n.c_mktsegment = 'AUTOMOBILE') THEN 'Updated' ELSE 'Created' END
      WHEN f.before OR n.user_id % 7 <> 3 THEN 'Updated' ELSE 'Created' END AS outcome,
    CASE WHEN n.map_name = 'm3' THEN 'ref=''' || n.ref || ''''
      WHEN n.link0 OR n.user_id % 7 <> 3 THEN CASE n.source_system WHEN 'erp' THEN 'c-' ELSE 'a-' END || n.user_id
      ELSE md5(lower(n.target_system) || '|' || lower(n.target_entity) || '|ref=''' || n.ref || '''') END AS other_id
  FROM fold f JOIN numbered n USING (g, rn)
), hist AS (
  SELECT *, CASE WHEN outcome IN ('Created', 'Updated') OR (before AND outcome <> 'Failed') THEN other_id END AS target_record_id,
    CASE WHEN outcome = 'Failed' THEN 'no translation for ''k'' value ' || k END AS error,
    enqueued_at AS processed_at
  FROM settled
)"""


REPLAY = replay(a.LINKS)


@workload("sync_outcomes", f"{REPLAY} SELECT map_name, outcome, count(*) AS n FROM hist GROUP BY ALL")
def sync_outcomes(spark, sf_dir) -> DataFrame:
    return run_batch(spark, sf_dir).history.groupBy("map_name", "outcome").agg(F.count("*").alias("n"))


@workload("link_fold", f"""{REPLAY} SELECT correlation_id, map_name, outcome, before AS had_link, target_record_id FROM hist""")
def link_fold(spark, sf_dir) -> DataFrame:
    rows = run_batch(spark, sf_dir).rows
    known = F.when(F.col("outcome").isin("Created", "Updated") | (F.col("has_link") & (F.col("outcome") != "Failed")), F.col("counterpart"))
    return rows.select("correlation_id", "map_name", "outcome", F.col("has_link").alias("had_link"), known.alias("target_record_id"))


@workload("outcomes", f"{REPLAY} SELECT map_name, operation, outcome, target_record_id IS NOT NULL AS has_target, count(*) AS n FROM hist GROUP BY ALL")
def outcomes(spark, sf_dir) -> DataFrame:
    found = run_batch(spark, sf_dir).history.withColumn("has_target", F.col("target_record_id").isNotNull())
    return found.groupBy("map_name", "operation", "outcome", "has_target").agg(F.count("*").alias("n"))


@workload("history_rows", f"""{REPLAY} SELECT map_name, epoch_us(processed_at) AS processed_us, outcome, operation, source_system, source_record_id,
  target_system, target_record_id, company, epoch_us(occurred_at) AS occurred_us, error, delivery_count, correlation_id FROM hist""")
def history_rows(spark, sf_dir) -> DataFrame:
    h = run_batch(spark, sf_dir).history
    micros = {"processed_at": "processed_us", "occurred_at": "occurred_us"}
    return h.select(*[F.unix_micros(c).alias(micros[c]) if c in micros else F.col(c) for c in h.columns])


@workload("metrics_dead_letters", f"""{REPLAY} SELECT map_name, source_system, count(*) AS letters, count(DISTINCT source_record_id) AS records,
  epoch_us(min(occurred_at)) AS oldest_us FROM hist WHERE outcome = 'Failed' GROUP BY ALL""")
def metrics_dead_letters(spark, sf_dir) -> DataFrame:
    depth = metrics.dead_letters(run_batch(spark, sf_dir).dead_letters())
    return depth.select("map_name", "source_system", "letters", "records", F.unix_micros("oldest").alias("oldest_us"))


@workload("dlq_failed_events", f"""{REPLAY} SELECT DISTINCT correlation_id, source_system, source_record_id, operation, epoch_us(occurred_at) AS at_us, company,
  delivery_count + 1 AS delivery_count, data_json AS data FROM hist WHERE outcome = 'Failed'""")
def dlq_failed_events(spark, sf_dir) -> DataFrame:
    """Failed events go through ingestion again whole, once each."""
    again = ingest.replay_events(run_batch(spark, sf_dir).dead_letters())
    return again.select(
        "correlation_id", "source_system", "source_record_id", "operation", F.unix_micros("occurred_at").alias("at_us"), "company", "delivery_count",
        canonical_json("data").alias("data"),
    )


# What a row writes, as text: whole bodies, or without the key where the key addresses the record.
_BODY = f"""CASE WHEN map_name <> 'm3' THEN '{{"k":' || k || ',"ref":"' || ref || '"}}' ELSE {M3_FULL} END"""


@workload("write_commands", f"""{REPLAY} SELECT correlation_id, target_system, target_entity, operation, other_id AS record_id, company,
  map_name || ':' || source_record_id || ':' || ticks AS idempotency_key, outcome,
  CASE WHEN map_name = 'm3' AND outcome = 'Updated' THEN {M3_BODY % ''}
    WHEN map_name = 'm3' AND outcome = 'Created' AND company IS NOT NULL THEN replace({M3_FULL}, '"grade":', '"dataAreaId":"' || company || '","grade":')
    ELSE {_BODY} END AS fields
  FROM settled WHERE outcome IN ('Created', 'Updated', 'Deleted')""")
def write_commands(spark, sf_dir) -> DataFrame:
    """The write plan of the whole batch, over all maps."""
    return run_batch(spark, sf_dir).writes.select(
        "correlation_id", "target_system", "target_entity", "operation", "record_id", "company", "idempotency_key", "outcome",
        canonical_json("fields").alias("fields"),
    )


@workload("link_states", f"""{REPLAY}, saved AS (
    SELECT *, {_BODY} AS body FROM settled WHERE outcome IN ('Created', 'Updated') OR (outcome = 'Deleted' AND before)
  ), ends AS (
    SELECT g, arg_min(row(link0, user_id, source_system, source_record_id, target_system, other_id, pair_key), row(arrival_seq, map_name)) AS f,
      arg_max(row(target_system, CASE WHEN operation = 'Delete' THEN '' ELSE upper(sha256(body)) END, occurred_at, source_system), row(arrival_seq, map_name)) AS l
    FROM saved GROUP BY g
  ) SELECT f[7] AS pair_key, CASE WHEN f[1] THEN 'erp' ELSE f[3] END AS system_a, CASE WHEN f[1] THEN 'a-' || f[2] ELSE f[4] END AS record_id_a,
    CASE WHEN f[1] THEN 'crm' ELSE f[5] END AS system_b, CASE WHEN f[1] THEN 'c-' || f[2] ELSE f[6] END AS record_id_b,
    l[1] AS written_to, l[2] AS hash, epoch_us(l[3]) AS at_us, l[4] AS writer FROM ends""")
def link_states(spark, sf_dir) -> DataFrame:
    """The links that a batch leaves changed, with their last state."""
    return run_batch(spark, sf_dir).link_updates.select(
        "pair_key", "system_a", "record_id_a", "system_b", "record_id_b", F.col("state.written_to_system").alias("written_to"),
        F.col("state.written_payload_hash").alias("hash"), F.unix_micros("state.last_writer_at").alias("at_us"), F.col("state.last_writer_system").alias("writer"),
    )


# Everything copied to the CRM before the events drain: one link per customer, dated by the copy.
LOADED = """links AS (SELECT c_custkey AS u, TRUE AS has_state, FALSE AS tomb,
    upper(sha256('{"k":' || (c_nationkey % 4) || ',"ref":"R' || c_custkey || '"}')) AS hash, TIMESTAMP '2024-01-08' + to_days(c_nationkey % 10) AS lw_at
  FROM customer)"""


@workload("cutover_drain", f"{replay(LOADED)} SELECT map_name, outcome, count(*) AS n FROM hist GROUP BY ALL")
def cutover_drain(spark, sf_dir) -> DataFrame:
    """Bulk copy of the customers, then the backlog of events: those older than the copy lose."""
    copied = a.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("a-"), "c_custkey").alias("record_id_a"), F.concat(F.lit("c-"), "c_custkey").alias("record_id_b"),
        F.create_map(F.lit("k"), (F.col("c_nationkey") % 4).cast("string"), F.lit("ref"), F.concat(F.lit('"R'), "c_custkey", F.lit('"'))).alias("fields"),
        F.expr("TIMESTAMP '2024-01-08 00:00:00' + make_dt_interval(c_nationkey % 10)").alias("changed_at"),
    )
    pair = pair_key(F.lit("erp"), F.lit("Accounts"), F.lit("crm"), F.lit("contact"))
    links = loaded_links(copied, pair, "erp", "crm", F.current_timestamp())
    return run_batch(spark, sf_dir, links).history.groupBy("map_name", "outcome").agg(F.count("*").alias("n"))


@workload("stream_pipeline", f"{REPLAY} SELECT map_name, outcome, count(*) AS n FROM hist GROUP BY ALL")
def stream_pipeline(spark, sf_dir) -> DataFrame:
    """The same events as a stream, through duplicate detection and `foreachBatch`, with link and
    target tables on disk; what the history then holds."""
    root = f"{ensure_checkpoint_dir(spark)}/flow-{uuid.uuid4().hex}"
    tables = SyncTables(f"{root}/xref", f"{root}/target", f"{root}/history", f"{root}/dead")
    tables.links(spark).write(a.xref(spark, sf_dir), 0)
    tables.records(spark).write(a.target(spark, sf_dir), 0)
    changes = dedupe.envelope(a.event_stream(spark, sf_dir).select(*a.CORE)).drop("session_id")
    query = sync_stream(
        changes, lambda: a.maps(spark), a.integration_users(spark), tables, SyncConfig(a.SYSTEMS), f"{root}/offsets",
        available_now=True,
    )
    query.awaitTermination()
    return spark.read.parquet(tables.history).groupBy("map_name", "outcome").agg(F.count("*").alias("n"))
