"""How the workloads deal out their input."""

from datetime import datetime

from pyspark.sql import functions as F

from workloads import adapters, ingest as flows


def test_rows_in_one_split_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 10)
    splits = spark.range(0, 1600, 1, 16).filter("id < 100")  # enough splits, and all rows in one
    held = adapters.spread(splits).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 100 and max(r["count"] for r in held) <= 20


def test_replay_parses_live_payloads_once(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1)
    rows = [(i, at, i % 3, "purchase", 1.5, f'{{"k": {i % 20}}}') for i in range(60)]
    rows += rows[:5]
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    seen, parse = [], flows.ingest.parse_events

    def counted(df, *args):
        seen.append(df.count())
        return parse(df, *args)

    monkeypatch.setattr(flows.ingest, "parse_events", counted)
    got = flows.dlq_replay(spark, str(tmp_path)).collect()
    unreadable = sum(1 for r in rows if r[0] % 20 in (7, 8, 9, 10, 11))
    assert seen == [65, unreadable]
    assert sum(r["deliveries"] for r in got) == 65 - unreadable
