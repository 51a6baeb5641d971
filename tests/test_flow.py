"""Raw payloads to change log, quarantine and target, with restarts in between."""

import json

import pytest

from changesync.plans.sync import SyncConfig
from changesync.sources import ingest, maps
from changesync.streaming import pipeline as flow
from workloads.ingest import FlatParser

MAP = {"name": "m", "sourceSystem": "crm", "sourceEntity": "contact", "targetSystem": "erp", "targetEntity": "Accounts",
       "fields": [{"source": "x", "target": "X", "defaultValue": "new"}], "integrationKey": ["X"]}


def payload(i):
    return f'{{"entity":"contact","id":"r{i}","op":"Update","at":"2024-01-01T00:00:{i:02d}Z","user":"u","correlation":"c{i}"}}'


def test_raw_files_reach_the_target_once(spark, tmp_path):
    tables = flow.SyncTables(f"{tmp_path}/xref", f"{tmp_path}/target", f"{tmp_path}/history", f"{tmp_path}/dead", buckets=4)
    docs = maps.parse_maps(spark.createDataFrame([(json.dumps(MAP),)], "document STRING"))
    users = spark.createDataFrame([("svc",)], "user_id STRING")

    def publish(checkpoint="cp1"):
        raw = ingest.read_raw(spark, f"{tmp_path}/in", streaming=True)
        flow.ingest_stream(raw, [FlatParser()], f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/{checkpoint}", available_now=True).awaitTermination()

    def sync():
        changes = flow.read_changes(spark, f"{tmp_path}/log")
        flow.sync_stream(changes, lambda: docs, users, tables, SyncConfig({"crm": "by_id", "erp": "by_id"}), f"{tmp_path}/cp2", available_now=True).awaitTermination()

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([payload(0), "not json", payload(1)]))
    publish()
    sync()
    (tmp_path / "in" / "b.txt").write_text("\n".join([payload(2), "{}", payload(3)]))
    publish()
    publish()  # nothing new
    sync()
    log = spark.read.parquet(f"{tmp_path}/log").orderBy("arrival_seq").collect()
    assert [r["correlation_id"] for r in log] == ["c0", "c1", "c2", "c3"] and len({r["arrival_seq"] for r in log}) == 4
    assert [r["arrival_seq"] >> flow.BATCH_BITS for r in log] == [0, 0, 1, 1]
    assert sorted(r["raw"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == ["not json", "{}"]
    history = spark.read.parquet(f"{tmp_path}/history")
    assert sorted(r["source_record_id"] for r in history.collect()) == ["r0", "r1", "r2", "r3"]
    assert tables.records(spark).read().count() == 1 and tables.links(spark).read().filter("system_a = 'crm'").count() == 5
    with pytest.raises(Exception, match="another checkpoint"):
        publish("cp-lost")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    # A batch that was written but not noted down is written again in the same place.
    done = next((tmp_path / "log" / "_done").glob("*/1"))
    for name in ("1", ".1.crc"):
        (tmp_path / "cp1" / "commits" / name).unlink(missing_ok=True)
    done.unlink()
    publish()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4 and done.exists()


def test_batches_run_adaptively_and_only_with_events(spark, tmp_path, monkeypatch):
    """A stateful query plans without adaptive execution, and ends with a batch that has no events."""
    tables = flow.SyncTables(f"{tmp_path}/xref", f"{tmp_path}/target", f"{tmp_path}/history", f"{tmp_path}/dead", buckets=4)
    docs = maps.parse_maps(spark.createDataFrame([(json.dumps(MAP),)], "document STRING"))
    users = spark.createDataFrame([("svc",)], "user_id STRING")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(payload(i) for i in range(3)))
    raw = ingest.read_raw(spark, f"{tmp_path}/in", streaming=True)
    flow.ingest_stream(raw, [FlatParser()], f"{tmp_path}/log", f"{tmp_path}/bad", f"{tmp_path}/cp1", available_now=True).awaitTermination()
    adaptive, whole = [], flow.sync_batch

    def watched(events, *args, **kwargs):
        adaptive.append(events.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return whole(events, *args, **kwargs)

    monkeypatch.setattr(flow, "sync_batch", watched)
    changes = flow.read_changes(spark, f"{tmp_path}/log")
    flow.sync_stream(changes, lambda: docs, users, tables, SyncConfig({"crm": "by_id", "erp": "by_id"}), f"{tmp_path}/cp2", available_now=True).awaitTermination()
    assert adaptive == [spark.conf.get("spark.sql.adaptive.enabled")] == ["true"]
    assert spark.read.parquet(f"{tmp_path}/history").count() == 3 and tables.links(spark).version() == 1
