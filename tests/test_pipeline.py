"""The whole pipeline: single outcomes, and a stream of batches against one batch."""

import json
import re
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from changesync.operators import dedupe
from changesync.plans.sync import SyncConfig, apply_result, sync_batch
from changesync.schema import BUS_COLUMNS, CHANGE_EVENT, TARGET_ROW, XREF_LINK
from changesync.operators import xref
from changesync.sources.maps import parse_maps
from changesync.storage import Scratch
from changesync.streaming.pipeline import SyncTables, sync_stream
from workloads import adapters as a

DATA = "/root/testdata/sf0.001"
NOW = datetime(2024, 7, 1, tzinfo=timezone.utc)
MAP = {"name": "customers", "sourceSystem": "erp", "sourceEntity": "Customers", "targetSystem": "crm", "targetEntity": "account",
       "fields": [{"source": "Name", "target": "name"}], "integrationKey": ["name"]}
PAIR = "crm:account|erp:customers"


def event(seq=1, op="Update", at=NOW, company=None, user=None, data=None, correlation="c-1", system="erp", entity="customers", record="REC-1"):
    return (system, entity, record, op, at, company, {"Name": '"Contoso"'} if data is None else data, user, correlation, seq, at, 3)


def run(spark, events, links=(), target=(), maps=(MAP,), modes=None, apply=False):
    ev = spark.createDataFrame(list(events), f"{CHANGE_EVENT}, {BUS_COLUMNS}")
    docs = parse_maps(spark.createDataFrame([(json.dumps(m),) for m in maps], "document STRING"))
    table = xref.mirrors(spark.createDataFrame(list(links), XREF_LINK).withColumn("version", F.lit(1).cast("bigint")))
    snapshot = spark.createDataFrame(list(target), TARGET_ROW)
    users = spark.createDataFrame([("svc",)], "user_id STRING")
    result = sync_batch(ev, docs, table, snapshot, users, SyncConfig(modes or {"erp": "by_id", "crm": "by_id"}), F.lit(NOW))
    rows = [r.asDict() for r in result.history.orderBy("correlation_id", "map_name").collect()]
    return (rows, *apply_result(result, table, snapshot)) if apply else rows


def link(state=None):
    return (PAIR, "erp", "REC-1", "crm", "T-1", state)


def state(at, fields=("name",), digest="HASH", to="crm"):
    return (to, list(fields), digest, "erp", at)


def test_create_writes_target_and_link(spark):
    rows, links, target = run(spark, [event()], apply=True)
    assert [(r["outcome"], r["error"], r["delivery_count"]) for r in rows] == [("Created", None, 3)]
    written = target.first()
    assert written["record_id"] == rows[0]["target_record_id"] and written["fields"] == {"name": '"Contoso"'}
    saved = links.collect()
    assert len(saved) == 2 and {r["lookup_key"] for r in saved} == {f"{PAIR}|erp|rec-1", f"{PAIR}|crm|{written['record_id']}"}
    assert saved[0]["state"]["written_to_system"] == "crm" and saved[0]["state"]["last_writer_at"].replace(tzinfo=timezone.utc) == NOW


@pytest.mark.parametrize("names", [("erp", "crm"), ("crm", "erp")])
@pytest.mark.parametrize("mode", ["by_id", "by_key"])
@pytest.mark.parametrize("second", [5, -5])
def test_records_that_share_a_key_keep_links_of_their_own(spark, names, mode, second):
    """The second record resolves to what the first one created: Updated, whatever the systems
    are called and however old its change is; their links do not meet."""
    source, target = names
    shared = {**MAP, "sourceSystem": source, "targetSystem": target}
    events = [
        event(1, system=source, record="A"), event(2, at=NOW + timedelta(minutes=second), system=source, record="B", correlation="c-2"),
        event(3, at=NOW + timedelta(minutes=second - 1), system=source, record="B", correlation="c-3"),
        event(4, at=NOW + timedelta(minutes=1), system=source, record="A", correlation="c-4"),
    ]
    rows, links, after = run(spark, events, maps=(shared,), modes={source: "by_id", target: mode}, apply=True)
    assert [r["outcome"] for r in rows] == ["Created", "Updated", "DiscardedByLastWriterWins", "Updated"]
    assert len({r["target_record_id"] for r in rows}) == 1 and after.count() == 1
    assert links.count() == 3  # a row per source record and one for the target, of the link saved last


def test_by_key_writes_follow_the_key_and_company_rules(spark):
    keyed = {**MAP, "integrationKey": ["dataAreaId", "name"]}
    rows, links, after = run(spark, [event(company="usmf")], maps=(keyed,), modes={"erp": "by_id", "crm": "by_key"}, apply=True)
    created = after.first()
    assert rows[0]["outcome"] == "Created" and created["record_id"] == "dataAreaId='usmf',name='Contoso'"
    assert created["fields"] == {"name": '"Contoso"', "dataAreaId": '"usmf"'}
    old = [("crm", "account", "name='Old'", {"name": '"Old"', "x": "1"})]
    more = {**MAP, "fields": [*MAP["fields"], {"source": "X", "target": "x"}]}
    linked = (PAIR, "erp", "REC-1", "crm", "name='Old'", None)
    rows, links, after = run(spark, [event(data={"Name": '"Contoso"', "X": "2"})], links=[linked], target=old, maps=(more,),
                             modes={"erp": "by_id", "crm": "by_key"}, apply=True)
    assert rows[0]["outcome"] == "Updated" and [(r["record_id"], r["fields"]) for r in after.collect()] == [("name='Old'", {"name": '"Old"', "x": "2"})]


def test_content_echo_inside_one_system(spark):
    same = {"fields": [{"source": "Name", "target": "Name"}], "integrationKey": ["Name"]}
    there = {**MAP, **same, "name": "there", "targetSystem": "erp", "targetEntity": "copies"}
    events = [event(1), event(2, at=NOW + timedelta(minutes=1), correlation="c-2")]
    rows = run(spark, events, maps=(there,), modes={"erp": "by_id"})
    assert [r["outcome"] for r in rows] == ["Created", "EchoSuppressed"]


def test_key_match_ambiguity_and_missing_key(spark):
    one = [("crm", "account", "T-7", {"name": '"Contoso"'})]
    assert [(r["outcome"], r["target_record_id"]) for r in run(spark, [event()], target=one)] == [("Updated", "T-7")]
    two = [*one, ("crm", "account", "T-8", {"name": '"Contoso"'})]
    failed = run(spark, [event()], target=two)[0]
    assert failed["outcome"] == "Failed" and "more than one" in failed["error"] and failed["target_record_id"] is None
    assert "no value" in run(spark, [event(data={"Name": "null"})])[0]["error"]
    unknown = {**MAP, "targetSystem": "nowhere"}
    assert "nowhere" in run(spark, [event()], maps=[unknown])[0]["error"]


@pytest.mark.parametrize("minutes, outcome", [(-10, "DiscardedByLastWriterWins"), (0, "Updated"), (5, "Updated")])
def test_last_writer_wins(spark, minutes, outcome):
    rows = run(spark, [event(at=NOW + timedelta(minutes=minutes))], [link(state(NOW))])
    assert [(r["outcome"], r["target_record_id"]) for r in rows] == [(outcome, "T-1")]


def test_company_scope(spark):
    scoped = {**MAP, "companies": ["CO1"]}
    events = [event(1, company="co1", correlation="a"), event(2, company="co2", correlation="b"), event(3, correlation="c"),
              event(4, op="Delete", correlation="d", at=NOW + timedelta(1))]
    rows = run(spark, events, [link()], maps=[scoped])
    assert [(r["correlation_id"], r["outcome"]) for r in rows] == [("a", "Updated"), ("d", "Deleted")]


def test_echoes_and_tombstone(spark):
    back = {**MAP, "name": "back", "sourceSystem": "crm", "sourceEntity": "account", "targetSystem": "erp", "targetEntity": "Customers",
            "fields": [{"source": "name", "target": "Name"}], "integrationKey": ["Name"]}
    crm = dict(system="crm", entity="account", record="T-1")
    later = [NOW + timedelta(minutes=i) for i in range(8)]
    events = [
        event(1, at=later[0], correlation="1"),
        event(2, at=later[1], correlation="2", data={"name": '"Contoso"', "other": "1"}, **crm),
        event(3, at=later[2], correlation="3", user="SVC"),
        event(4, at=later[3], correlation="4", data={"name": '"Fabrikam"'}, **crm),
        event(5, at=later[4], correlation="5", op="Delete"),
        event(6, at=later[2], correlation="6", data={"name": '"Late"'}, **crm),
        event(7, at=later[6], correlation="7", data={"name": '"New"'}, **crm),
    ]
    rows, links, _ = run(spark, events, [link()], maps=[MAP, back], apply=True)
    assert [(r["correlation_id"], r["outcome"]) for r in rows] == [
        ("1", "Updated"), ("2", "EchoSuppressed"), ("3", "EchoSuppressed"), ("4", "Updated"), ("5", "Deleted"),
        ("6", "DiscardedByLastWriterWins"), ("7", "Updated"),
    ]
    final = {r["state"]["written_to_system"] for r in links.collect()}
    assert final == {"erp"}


def test_by_key_target_reports_created_after_delete(spark):
    events = [event(1, correlation="1"), event(2, op="Delete", at=NOW + timedelta(1), correlation="2"), event(3, at=NOW + timedelta(2), correlation="3")]
    rows = run(spark, events, target=[("crm", "account", "name='Contoso'", {})], modes={"erp": "by_id", "crm": "by_key"})
    assert [(r["outcome"], r["target_record_id"]) for r in rows] == [
        ("Updated", "name='Contoso'"), ("Deleted", "name='Contoso'"), ("Created", "name='Contoso'")]


def _seeded(spark, root):
    tables = SyncTables(f"{root}/xref", f"{root}/target", f"{root}/history", f"{root}/dead")
    tables.links(spark).write(a.xref(spark, DATA), 0)
    tables.records(spark).write(a.target(spark, DATA), 0)
    return tables


def test_stream_in_batches_equals_one_batch(spark, tmp_path):
    events = dedupe.envelope(a.sync_events(spark, DATA)).drop("session_id")
    once = sync_batch(events, a.maps(spark), a.xref(spark, DATA), a.target(spark, DATA), a.integration_users(spark), SyncConfig(a.SYSTEMS), F.lit(NOW))
    cut = events.selectExpr("percentile(arrival_seq, 0.5) AS h").first()["h"]
    for part in (events.filter(F.col("arrival_seq") <= cut), events.filter(F.col("arrival_seq") > cut)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables = _seeded(spark, tmp_path)
    sync_stream(stream, lambda: a.maps(spark), a.integration_users(spark), tables, SyncConfig(a.SYSTEMS), f"{tmp_path}/cp", available_now=True).awaitTermination()

    cols = ["map_name", "correlation_id", "outcome", "target_record_id"]
    live = spark.read.parquet(tables.history)
    assert live.select("batch_id").distinct().count() == 2
    assert sorted(map(str, live.select(cols).collect())) == sorted(map(str, once.history.select(cols).collect()))

    want_links, want_target = apply_result(once, a.xref(spark, DATA), a.target(spark, DATA))
    got_links = tables.links(spark).read()
    got_target = tables.records(spark).read()
    shown = ["lookup_key", "record_id_a", "record_id_b", F.to_json("state").alias("s")]
    assert sorted(map(str, got_links.select(shown).collect())) == sorted(map(str, want_links.select(shown).collect()))

    def bodies(df):
        return sorted((r["system"].lower(), r["record_id"], str(sorted(r["fields"].items()))) for r in df.collect())

    assert bodies(got_target) == bodies(want_target)


def test_a_link_stored_twice_gives_a_row_for_each(spark):
    """Look-ups come after the wide rows are numbered: what they repeat must not multiply in later joins."""
    events = [event(), event(seq=2, correlation="c-2", data={"Name": '"Fabrikam"'})]
    rows = run(spark, events, links=[link(state(NOW - timedelta(days=1)))] * 2, target=[("crm", "account", "T-1", {"name": '"Old"'})])
    assert [(r["correlation_id"], r["outcome"], r["target_record_id"]) for r in rows] == [(f"c-{i}", "Updated", "T-1") for i in (1, 1, 2, 2)]


def _lying(*roots):
    """The scratch tables that lie under `roots` now, and how many files of shuffles."""
    files = [str(f) for root in roots for f in Path(root).rglob("*") if f.is_file()]
    tables = {m[1] for f in files if (m := re.search(r"/(work-[^/]+/[^/]+)/part-", f))}
    return tables, sum("/shuffle_" in f and f.endswith(".data") for f in files)


def test_a_batch_frees_what_it_has_read(spark, tmp_path, monkeypatch):
    """tables and shuffles of all steps lay on the disk until the batch ended, message ids in most of them."""
    jvm_local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    local, work = [str(d) for d in jvm_local], spark.conf.get("spark.checkpoint.dir")
    events = dedupe.envelope(a.sync_events(spark, DATA))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    tables, seen, whole = _seeded(spark, tmp_path), {}, Scratch.keep

    def watched(self, df, name):
        kept = whole(self, df, name)
        time.sleep(2 * (name in ("rows", "saves")))  # shuffle files go in the background
        seen.setdefault(name, (kept.columns, *_lying(work, *local)))
        return kept

    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before = _lying(work, *local)
    monkeypatch.setattr(Scratch, "keep", watched)
    sync_stream(stream, lambda: a.maps(spark), a.integration_users(spark), tables, SyncConfig(a.SYSTEMS), f"{tmp_path}/cp", available_now=True).awaitTermination()
    mine = {n: {t.split("-")[-1] for t in on_disk - before[0]} for n, (_, on_disk, _) in seen.items()}
    assert mine["resolved"] == {"routed", "linked", "resolved"} and mine["chunked"] == {"routed", "owned", "chunked"}
    assert mine["rows"] == {"routed", "decided", "rows"} and mine["saves"] == {"rows", "writes", "saves"}
    assert not any("message_id" in columns for columns, _, _ in seen.values())
    # Of the shuffles only that of the stream is left, a file for each of its tasks, whatever was shuffled since.
    assert seen["rows"][2] <= seen["events"][2] and seen["saves"][2] <= seen["events"][2]


def test_slices_of_a_batch_give_the_same_rows(spark):
    """The rows of a batch are put together a slice at a time; so are the bodies of contested links."""
    events = dedupe.envelope(a.sync_events(spark, DATA)).drop("session_id")

    def run(**how):
        result = sync_batch(
            events, a.maps(spark), a.xref(spark, DATA), a.target(spark, DATA), a.integration_users(spark), SyncConfig(a.SYSTEMS, **how), F.lit(NOW), keep_rows=True,
        )
        try:
            letters = result.dead_letters().withColumn("data", F.to_json("data"))
            writes = result.writes.filter("operation <> 'Delete'").withColumn("fields", F.to_json("fields"))
            return [sorted(map(str, df.collect())) for df in (result.history, letters, writes, result.link_updates)]
        finally:
            result.close()

    whole, sliced = run(), run(slice_rows=700)
    assert whole == sliced and all(whole)
