"""Snapshot comparison, stored latency sketches and the stored key index."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from changesync.operators import dedupe, metrics, route, targets
from changesync.plans import capture
from changesync.plans.sync import SyncConfig, sync_batch
from changesync.schema import HISTORY
from changesync.sources import pull
from changesync.sources.maps import parse_maps
from changesync.storage import KeyedTable
from changesync.streaming.pipeline import SyncTables, sync_stream
from workloads import adapters as a

DATA = "/root/testdata/sf0.001"
ENTITY = pull.Entity("erp", "Items", ("id",), "changed", "company")
ROW = "id STRING, changed TIMESTAMP, company STRING, v INT"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
NOW = T0 + timedelta(days=30)


def step(spark, rows, previous):
    c = capture.capture(spark.createDataFrame(rows, ROW), ENTITY, previous, F.lit(NOW))
    events = sorted((r["operation"], r["source_record_id"], r["company"], r["data"].get("v")) for r in c.events.collect())
    kept = spark.createDataFrame(c.snapshot.collect(), capture.SNAPSHOT)
    c.close()
    return events, kept


def test_captured_changes_replay_to_the_table(spark):
    empty = spark.createDataFrame([], capture.SNAPSHOT)
    first = [("a", T0, "co1", 1), ("b", T0, None, 2), ("C", None, "co2", None)]
    events, kept = step(spark, first, empty)
    assert events == [("Create", "id='C'", "co2", "null"), ("Create", "id='a'", "co1", "1"), ("Create", "id='b'", None, "2")]
    assert step(spark, first, kept)[0] == []
    # b changes without a new time, a goes, c only changes the case of its id, d comes twice.
    second = [("b", T0, None, 3), ("c", None, "co2", None), ("d", T0, "x", 1), ("d", T0 + timedelta(1), "x", 2), ("d", T0 + timedelta(1), "x", 2)]
    events, kept = step(spark, second, kept)
    assert events == [("Create", "id='d'", "x", "2"), ("Delete", "id='a'", "co1", None), ("Update", "id='b'", None, "3"), ("Update", "id='c'", "co2", "null")]
    events, kept = step(spark, [], kept)
    assert [(op, key) for op, key, *_ in events] == [("Delete", "id='b'"), ("Delete", "id='c'"), ("Delete", "id='d'")]
    assert kept.count() == 0 and step(spark, [], kept)[0] == []


def test_a_failed_publish_keeps_the_snapshot_before(spark):
    saved = []
    c = capture.capture(spark.createDataFrame([("a", T0, None, 1)], ROW), ENTITY, spark.createDataFrame([], capture.SNAPSHOT), F.lit(NOW))

    def fails(_):
        raise OSError("bus down")

    with pytest.raises(OSError):
        c.publish(fails, saved.append)
    assert saved == []


def entry(i, ms):
    at = T0 + timedelta(days=i % 3)
    return ("m" if i % 5 else "n", at + timedelta(milliseconds=ms), "Updated", "Update", "s", "r", "t", None, None, at, None, 1, f"c{i}")


def test_stored_sketches_give_quantiles_within_the_error(spark, tmp_path):
    late = [(i * 7919) % 30_011 for i in range(30_000)]
    rows = spark.createDataFrame([entry(i, ms) for i, ms in enumerate(late)], HISTORY).cache()
    table = KeyedTable(spark, f"{tmp_path}/latency", metrics.LATENCY_SKETCH, ["map_name", "day"], 4)
    number = F.substring("correlation_id", 2, 9).cast("int")
    for batch in range(3):
        metrics.store_latency(table, rows.filter(number % 3 == batch), batch)
    metrics.store_latency(table, rows.filter(number % 3 == 2), 2)  # repeated after a restart
    got = {r["map_name"]: r for r in metrics.latency_quantiles(table.read()).collect()}
    for name in ("m", "n"):
        exact = sorted(ms for i, ms in enumerate(late) if ("m" if i % 5 else "n") == name)
        assert (got[name]["entries"], got[name]["days"]) == (len(exact), 3)
        for rank, column in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms")):
            below = sum(x <= got[name][column] for x in exact) / len(exact)
            assert abs(below - rank) < 0.002, (name, rank, below)
    empty = KeyedTable(spark, f"{tmp_path}/none", metrics.LATENCY_SKETCH, ["map_name", "day"], 4)
    metrics.store_latency(empty, rows.limit(0), 0)
    assert metrics.latency_quantiles(empty.read()).count() == 0



def test_stream_with_a_stored_index_equals_one_batch(spark, tmp_path):
    events, config = dedupe.envelope(a.sync_events(spark, DATA)).drop("session_id"), SyncConfig(a.SYSTEMS)
    once = sync_batch(events, a.maps(spark), a.xref(spark, DATA), a.target(spark, DATA), a.integration_users(spark), config)
    cut = events.selectExpr("percentile(arrival_seq, 0.5) AS h").first()["h"]
    for part in (events.filter(F.col("arrival_seq") <= cut), events.filter(F.col("arrival_seq") > cut)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables = SyncTables(f"{tmp_path}/xref", f"{tmp_path}/target", f"{tmp_path}/history", f"{tmp_path}/dead", buckets=4,
                        key_index=f"{tmp_path}/keys", latency=f"{tmp_path}/latency")
    tables.links(spark).write(a.xref(spark, DATA), 0)
    tables.records(spark).write(a.target(spark, DATA), 0)
    sync_stream(stream, lambda: a.maps(spark), a.integration_users(spark), tables, config, f"{tmp_path}/cp", available_now=True).awaitTermination()

    cols = ["map_name", "correlation_id", "outcome", "target_record_id", "error"]
    want, got = once.history.select(cols).collect(), spark.read.parquet(tables.history).select(cols).collect()
    once.close()
    assert sorted(map(str, got)) == sorted(map(str, want))
    record = tables.records(spark)
    (folder,) = (tmp_path / "keys").iterdir()  # the maps stayed as they were
    stored = tables.entries(spark, folder.name)
    assert stored.version() == record.version() >= 2
    entries = targets.key_entries(record.read(), route.active_maps(a.maps(spark)), config.systems)
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, entries.collect()))
    assert tables.latencies(spark).read().agg(F.sum("entries")).first()[0] == len(got)


def test_a_batch_with_stored_entries_does_not_read_the_target(spark, tmp_path):
    a.target(spark, DATA).write.parquet(f"{tmp_path}/target")
    snapshot, active = spark.read.parquet(f"{tmp_path}/target"), route.active_maps(a.maps(spark))
    targets.key_entries(snapshot, active, a.SYSTEMS).write.parquet(f"{tmp_path}/keys")
    events, config = a.sync_events(spark, DATA), SyncConfig(a.SYSTEMS)
    (tmp_path / "target").rename(tmp_path / "away")  # whoever reads it now fails
    result = sync_batch(events, a.maps(spark), a.xref(spark, DATA), snapshot, a.integration_users(spark), config, entries=spark.read.parquet(f"{tmp_path}/keys"))
    got = sorted(map(str, result.history.drop("processed_at").collect()))
    result.close()
    (tmp_path / "away").rename(tmp_path / "target")
    result = sync_batch(events, a.maps(spark), a.xref(spark, DATA), snapshot, a.integration_users(spark), config)
    assert got == sorted(map(str, result.history.drop("processed_at").collect())) and got
    result.close()


def test_entries_are_built_anew_for_other_integration_keys(spark, tmp_path):
    """A map that is edited meets the entries of its new key, and of its old one when it is edited back."""
    doc = {"name": "m", "sourceSystem": "erp", "sourceEntity": "Accounts", "targetSystem": "crm", "targetEntity": "contact",
           "fields": [{"source": "x", "target": "x"}, {"source": "y", "target": "y"}]}
    schema = "source_system STRING, entity_name STRING, source_record_id STRING, operation STRING, occurred_at TIMESTAMP, company STRING, data MAP<STRING,STRING>, originating_user_id STRING, correlation_id STRING, arrival_seq BIGINT, enqueued_at TIMESTAMP, delivery_count INT, message_id STRING"
    tables = SyncTables(f"{tmp_path}/xref", f"{tmp_path}/target", f"{tmp_path}/history", f"{tmp_path}/dead", buckets=4, key_index=f"{tmp_path}/keys")
    for i, key in enumerate(["x", "y", "x"]):
        data = {"x": f'"{"same" if i != 1 else "other"}"', "y": f'"{i // 2}"'}
        row = ("erp", "Accounts", f"r{i}", "Update", T0, None, data, "u", f"c{i}", i, T0, 1, f"id{i}")
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        maps = parse_maps(spark.createDataFrame([(json.dumps({**doc, "integrationKey": [key]}),)], "document STRING"))
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sync_stream(stream, lambda: maps, spark.createDataFrame([("svc",)], "user_id STRING"), tables, SyncConfig({"erp": "by_id", "crm": "by_id"}),  # noqa: B023
                    f"{tmp_path}/cp", available_now=True).awaitTermination()
    got = [(r["correlation_id"], r["outcome"]) for r in spark.read.parquet(tables.history).orderBy("correlation_id").collect()]
    # r1 finds r0's record by y = 0 and renames its x; r2 looks for x = same, which is no more.
    assert got == [("c0", "Created"), ("c1", "Updated"), ("c2", "Created")]
