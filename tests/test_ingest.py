"""Payload recognition, parsing and quarantine."""

import json

import pytest
from pyspark.sql import functions as F

from changesync.sources import ingest

ZERO = "00000000-0000-0000-0000-000000000000"


def payload(**changes):
    target = {"Attributes": [
        {"key": "Account", "value": "C-1"}, {"key": "dataAreaId", "value": "co1"},
        {"key": "Limit", "value": {"__type": "Money", "Value": 1500.50}}, {"key": "Blocked", "value": {"Value": 0}},
        {"key": "Invoice", "value": {"Id": "inv-1", "LogicalName": "x"}}, {"key": "Changed", "value": "/Date(1719999999000)/"},
        {"key": "Memo", "value": None}, {"key": "Deep", "value": {"Value": {"Value": {"Id": True}}}},
        {"key": "Deeper", "value": {"Value": {"Id": {"Value": {"Value": {"Value": {"Id": {"Value": {"Value": {"Value": {"Value": 7}}}}}}}}}}},
        {"key": "Raw", "value": {"a": [1, 2]}}, {"key": "Account", "value": "C-2"}, {"value": "no key"}, {"key": 5, "value": 1},
    ], "Id": "id-from-target", "LogicalName": "entity_from_target"}
    doc = {
        "BusinessEventId": "be", "MessageName": "Create", "EventTime": "/Date(1720000000000)/", "CorrelationId": "c-1",
        "InitiatingUserAzureActiveDirectoryObjectId": ZERO, "UserId": "u-1", "PrimaryEntityId": "id-1", "PrimaryEntityName": "entity",
        "InputParameters": [{"key": "Target", "value": target}],
    }
    doc.update(changes)
    return json.dumps({k: v for k, v in doc.items() if v != "drop"})


def parse(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n INT, raw STRING")
    return ingest.parse_events(df, [ingest.ContextParser("erp")])


def test_full_payload(spark):
    e = ingest.accepted(parse(spark, payload())).withColumn("us", F.unix_millis("occurred_at")).first()
    assert (e["source_system"], e["operation"], e["entity_name"], e["source_record_id"]) == ("erp", "Create", "entity", "id-1")
    assert (e["company"], e["originating_user_id"], e["correlation_id"], e["us"]) == ("co1", "u-1", "c-1", 1720000000000)
    assert e["data"] == {
        "Account": '"C-2"', "dataAreaId": '"co1"', "Limit": "1500.5", "Blocked": "0", "Invoice": '"inv-1"',
        "Changed": '"2024-07-03T09:46:39+00:00"', "Memo": "null", "Deep": "true", "Deeper": "7", "Raw": '{"a":[1,2]}',
    }


def test_fallbacks(spark):
    bare = payload(
        MessageName="OnExternalDeleted", BusinessEventId="drop", PrimaryEntityId=ZERO, PrimaryEntityName="drop", EventTime="soon",
        OperationCreatedOn="/Date(1784051293000+0000)/", CorrelationId=ZERO, UserId=" ",
        InputParameters=[{"KEY": "target", "VALUE": {"attributes": [{"Key": "k", "Value": 1}], "id": "t-1", "logicalname": "e"}}],
    )
    e = ingest.accepted(parse(spark, bare)).withColumn("us", F.unix_millis("occurred_at")).first()
    assert (e["operation"], e["entity_name"], e["source_record_id"], e["us"]) == ("Delete", "e", "t-1", 1784051293000)
    assert e["company"] is None and e["originating_user_id"] is None
    assert e["correlation_id"] not in (None, ZERO) and e["data"] == {"k": "1"}


@pytest.mark.parametrize("raw, reason", [
    (payload(MessageName="Assign"), "unsupported"), (payload(MessageName=""), "unsupported"), (payload(MessageName="drop"), "no MessageName"),
    (payload(InputParameters=[]), "no Target"), (payload(EventTime="drop"), "change time"), ("not json", "no registered parser"),
    ("[1, 2]", "no registered parser"), ('{"subject": "other"}', "no registered parser"),
])
def test_errors_are_quarantined(spark, raw, reason):
    parsed = parse(spark, raw)
    assert ingest.accepted(parsed).count() == 0
    q = ingest.quarantine(parsed).first()
    assert reason in q["error"] and q["raw"] == raw


def test_sniffing_and_prefix(spark):
    df = spark.createDataFrame(
        [(payload(),), ('{"messagename": "x", "INPUTPARAMETERS": []}',), ('{"MessageName": "x"}',), ("[1]",), ("x" * 700,), (None,)], "raw STRING")
    sniffed = df.select(ingest.ContextParser().sniff(ingest.root_of("raw")).alias("s"))
    assert [r["s"] for r in sniffed.collect()] == [True, True, False, False, False, False]
    long = ingest.quarantine(parse(spark, "x" * 700)).first()
    assert len(long["payload_prefix"]) == 601 and long["payload_prefix"].endswith("…") and len(long["raw"]) == 700


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join([payload(PrimaryEntityId=f"r{i}"), f"junk {i}"]))
    parsers = [ingest.ContextParser("erp")]
    batch = ingest.accepted(ingest.parse_events(ingest.read_raw(spark, f"{tmp_path}/in"), parsers))
    stream = ingest.accepted(ingest.parse_events(ingest.read_raw(spark, f"{tmp_path}/in", streaming=True), parsers))
    query = (stream.select("source_record_id").writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(r["source_record_id"] for r in batch.collect()) == ["r0", "r1", "r2"]


def test_a_repeated_member_name_is_readable(spark):
    raw = payload().replace('"MessageName": "Create"', '"MessageName": "Update", "MessageName": "Create"')
    assert ingest.accepted(parse(spark, raw)).first()["operation"] == "Create"


def test_the_text_is_read_once_whatever_the_number_of_parsers(spark):
    df = spark.createDataFrame([(payload(),)], "raw STRING")
    parsers = [ingest.ContextParser(n) for n in ("a", "b", "c")]
    plan = ingest.parse_events(df, parsers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(raw#") == 1
