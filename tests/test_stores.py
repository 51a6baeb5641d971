"""Links, targets, pulls, scheduled runs, history and maps on small tables."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from changesync.functions import keys, text, values
from changesync.operators import history, targets, xref
from changesync.plans import scheduled
from changesync.schema import HISTORY, XREF_LINK, XREF_ROW
from changesync.sources import catalog, maps, pull, watermarks
from changesync.storage import KeyedTable, StaleWriter

T = datetime(2024, 5, 1, tzinfo=timezone.utc)
TOMB = ("crm", [], "", "erp", T)
LIVE = ("crm", ["name"], "HASH", "erp", T)


def link(n, state=None, pair="crm:contact|erp:accounts"):
    return (pair, "erp", f"A{n}", "crm", f"C{n}", state)


def link_table(spark, *rows):
    return xref.save(spark.createDataFrame([], XREF_ROW), spark.createDataFrame(list(rows), XREF_LINK).withColumn("at", F.lit(1)), "at")


def test_link_is_found_from_both_sides(spark):
    table = link_table(spark, link(1, LIVE))
    events = spark.createDataFrame(
        [("crm:contact|erp:accounts", "ERP", "a1", "crm"), ("crm:contact|erp:accounts", "crm", "C1", "Erp"), ("x|y", "erp", "A1", "crm")],
        "pair_key STRING, source_system STRING, source_record_id STRING, target_system STRING")
    got = {(r["source_system"], r["link_target_id"]) for r in xref.lookup(events, table).collect()}
    assert got == {("ERP", "C1"), ("crm", "A1"), ("erp", None)}


def test_pair_scan_and_stale_save(spark):
    table = link_table(spark, link(1), link(2, TOMB), link(3, None, "other|pair"))
    pair = xref.links_of_pair(table, "CRM:contact|ERP:accounts")
    assert sorted(r["record_id_a"] for r in pair.collect()) == ["A1", "A2"]
    key = "crm:contact|erp:accounts|erp|a1"
    saves = spark.createDataFrame([("A1", key, 1), ("A1", key, 0), ("new", None, None)], "record_id_a STRING, read_key STRING, read_version BIGINT")
    accepted, rejected = xref.conditional_save(table, saves)
    assert sorted(r["record_id_a"] for r in accepted.collect()) == ["A1", "new"] and rejected.first()["read_version"] == 0


def test_key_segment_and_literals(spark):
    row = spark.createDataFrame([({"Account": '"C\'1"', "n": "5"}, "usmf", "")], "mapped MAP<STRING,STRING>, company STRING, blank STRING")
    parts = targets.key_parts(F.array(F.lit("dataAreaId"), F.lit("Account")), "mapped", "company")
    assert row.select(keys.key_segment(parts)).first()[0] == "Account='C''1',dataAreaId='usmf'"
    missing = targets.key_parts(F.array(F.lit("dataAreaId")), "mapped", "blank")
    problem = row.withColumn("k", F.array(F.lit("dataAreaId"))).select(targets.key_problem("k", missing))
    assert "dataAreaId" in problem.first()[0]
    pk = row.select(keys.pair_key(F.lit("s"), F.lit("a_b"), F.lit("S"), F.lit("ab"))).first()[0]
    assert pk == "s:ab|s:a_b"  # upper-case order: '_' comes after the letters


def test_writes_replay_to_the_same_target(spark):
    old = spark.createDataFrame([("crm", "c", "1", {"a": "1", "b": "2"}), ("crm", "c", "2", {"a": "1"}), ("crm", "c", "3", {"z": "1"})],
                                "system STRING, entity_name STRING, record_id STRING, fields MAP<STRING,STRING>")
    plan = spark.createDataFrame([
        ("CRM", "C", "1", "Update", {"a": "9"}, 1), ("crm", "c", "1", "Update", {"c": "null"}, 2),
        ("crm", "c", "2", "Delete", None, 3), ("crm", "c", "3", "Delete", {"x": "1"}, 4), ("crm", "c", "3", "Create", {"y": "5"}, 5),
        ("crm", "c", "4", "Update", {}, 6), ("crm", "c", "5", "Delete", {}, 7),
    ], "target_system STRING, target_entity STRING, record_id STRING, operation STRING, fields MAP<STRING,STRING>, write_order INT")
    net = targets.net_writes(plan)
    once = targets.apply_writes(old, net)
    state = {r["record_id"]: r["fields"] for r in once.collect()}
    assert state == {"1": {"a": "9", "b": "2", "c": "null"}, "3": {"y": "5"}, "4": {}}
    again = targets.apply_writes(once.select(*old.columns), net)
    assert {r["record_id"]: r["fields"] for r in again.collect()} == state
    assert {r["record_id"] for r in once.filter("created").collect()} == {"4"}


def test_bodies(spark):
    row = spark.createDataFrame([({"No": "1", "x": "2"}, ["no"], "co")], "mapped MAP<STRING,STRING>, integration_key ARRAY<STRING>, company STRING")
    update, create = row.select(targets.update_body(), targets.create_body()).first()
    assert update == {"x": "2"} and create == {"No": "1", "x": "2", "dataAreaId": '"co"'}


ENTITY = pull.Entity("erp", "Accounts", ("id",), "changed", "company")


def source(spark, *rows):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), c) for i, t, c in rows], "id STRING, changed TIMESTAMP, company STRING")


def entity_map(mode, deletes=True, companies=(), scheduled_map=True):
    schedule = {"mode": mode, "detect_deletes": deletes, "cron": "0 0 * * * *"} if scheduled_map else None
    pair = {"source_system": "ERP", "source_entity": "Accounts", "target_system": "crm", "target_entity": "contact"}
    return {"name": "m", "companies": list(companies), "schedule": schedule, **pair}


def pair_links(spark, *ids):
    """Links of the map's pair, and one of another pair with the same source."""
    rows = [("crm:contact|erp:accounts", "erp", f"id='{i}'", "crm", f"C{i}", s) for i, s in ids]
    rows.append(("crm:lead|erp:orders", "erp", "no='O1'", "crm", "L1", LIVE))
    return link_table(spark, *rows)


def at():
    return F.expr("TIMESTAMP '2024-06-01 00:00:00'")


def test_incremental_run(spark):
    table = source(spark, ("A", "2024-05-01T10:00:00+00:00", "co1"), ("B", "2024-05-02T10:00:00+00:00", "co2"), ("C", "2024-04-01T00:00:00+00:00", "co1"))
    done = scheduled.scheduled_run(entity_map("incremental", companies=["co1"]), table, ENTITY, pair_links(spark, ("b", LIVE), ("X", LIVE), ("Y", TOMB)),
                                   "2024-05-01T00:00:00.0000000+00:00", at())
    assert [r["source_record_id"] for r in done.changes.collect()] == ["id='A'"]
    gone = done.deletes.collect()
    assert [(r["source_record_id"], r["company"], r["data"]) for r in gone] == [("id='X'", None, {})]
    assert done.watermark.first()["token"] == "2024-05-01T10:00:00.0000000+00:00"
    s = done.summary().first()
    assert (s["published"], s["deletes"]) == (1, 1)
    with pytest.raises(ValueError, match="pulls from system"):
        other = pull.Entity("crm", "Accounts", ("id",), "changed", "company")
        scheduled.scheduled_run(entity_map("incremental"), table, other, pair_links(spark), "", at())


def test_a_growing_source_never_moves_the_watermark_past_a_change(spark, tmp_path):
    path = f"{tmp_path}/live"
    source(spark, ("A", "2024-05-01T10:00:00+00:00", "co1")).write.parquet(path)
    run = scheduled.scheduled_run(entity_map("incremental", False), spark.read.parquet(path), ENTITY, pair_links(spark), "", at())
    source(spark, ("B", "2024-05-09T10:00:00+00:00", "co1")).write.mode("append").parquet(path)
    steps = []
    run.publish(lambda e: steps.append([r["source_record_id"] for r in e.collect()]), lambda w: steps.append(w.first()["token"]))
    assert steps == [["id='A'"], "2024-05-01T10:00:00.0000000+00:00"]
    again = scheduled.scheduled_run(entity_map("incremental", False), spark.read.parquet(path), ENTITY, pair_links(spark), steps[1], at())
    with pytest.raises(RuntimeError):
        again.publish(lambda e: (_ for _ in ()).throw(RuntimeError("bus down")), lambda w: steps.append("saved"))
    assert len(steps) == 2


def test_values_of_every_type(spark):
    row = spark.sql("""SELECT CAST(1.50 AS DECIMAL(5,2)) AS a, CAST(1e10 AS DOUBLE) AS b, CAST('NaN' AS DOUBLE) AS c, X'00FF' AS d, DATE '2024-01-02' AS e,
      true AS f, array(1, 2) AS g, CAST(NULL AS INT) AS h, CAST('Infinity' AS FLOAT) AS i, INTERVAL '1' DAY AS j, 100.0D AS k""")
    got = row.select(pull.body_of_columns(row).alias("m")).first()["m"]
    want = {"a": "1.5", "b": "10000000000", "c": '"NaN"', "d": '"AP8="', "e": '"2024-01-02"', "f": "true", "g": "[1,2]", "h": "null", "i": '"Infinity"', "k": "100"}
    assert {k: v for k, v in got.items() if k != "j"} == want and got["j"].startswith('"')
    payload = spark.sql("""SELECT transform_values(CAST(parse_json('{"a":1.50,"b":10000000000,"k":100.0}') AS MAP<STRING,VARIANT>), (k, v) -> to_json(v)) AS m""").first()["m"]
    assert payload == {k: want[k] for k in payload}


def test_no_changes_keep_the_watermark_and_full_export_saves_none(spark):
    table = source(spark, ("A", "2024-05-01T10:00:00+00:00", "co1"))
    idle = scheduled.scheduled_run(entity_map("incremental", False), table, ENTITY, pair_links(spark, ("A", None)), "2025-01-01T00:00:00+00:00", at())
    assert idle.watermark.count() == 0 and idle.deletes is None
    full = scheduled.scheduled_run(entity_map("fullExport"), table, ENTITY, pair_links(spark, ("a", None), ("B", None)), "2025-01-01T00:00:00+00:00", at())
    assert full.watermark is None and full.changes.count() == 1
    assert [r["source_record_id"] for r in full.deletes.collect()] == ["id='B'"]
    assert scheduled.scheduled_run(entity_map("x", scheduled_map=False), table, ENTITY, None, "", at()) is None


def test_scan_errors_and_push_down(spark, tmp_path):
    table = source(spark, ("A", "2024-05-01T10:00:00+00:00", "co1"))
    with pytest.raises(ValueError, match="unreadable"):
        pull.scan(table, ENTITY, "yesterday")
    with pytest.raises(ValueError, match="modification"):
        pull.scan(table, pull.Entity("erp", "X", ("id",)), "2024-01-01")
    with pytest.raises(ValueError, match="key"):
        pull.scan(table, pull.Entity("erp", "X", ()))
    table.write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = pull.scan(spark.read.parquet(f"{tmp_path}/t"), ENTITY, "2024-01-01", ["co1"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(changed" in plan and "EqualTo(company,co1)" in plan
    keys_plan = pull.scan(spark.read.parquet(f"{tmp_path}/t"), ENTITY, keys_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in keys_plan


def test_watermarks(spark):
    marks = spark.createDataFrame([("ERP", "map:M", "t1", T)], "system STRING, scope STRING, token STRING, updated_at TIMESTAMP")
    wanted = spark.createDataFrame([("erp", "MAP:m"), ("erp", "map:other")], "system STRING, scope STRING")
    assert {r["scope"]: r["token"] for r in watermarks.get(marks, wanted).collect()} == {"MAP:m": "t1", "map:other": ""}
    after = watermarks.save(marks, marks.withColumn("token", F.lit("t2")))
    assert [r["token"] for r in after.collect()] == ["t2"]


def test_history(spark, tmp_path):
    rows = [("m/1", datetime(2024, 1, 1, 0, i, tzinfo=timezone.utc), "Failed" if i == 2 else "Created", "Update", "erp", f"r{i}", "crm", None, None, T,
             'said "no", twice\n' + "x" * 5000 if i == 2 else None, 1, f"c{i}") for i in range(5)]
    h = spark.createDataFrame(rows, HISTORY)
    first = history.page(h, "m/1", size=2).collect()
    assert [r["correlation_id"] for r in first] == ["c4", "c3"] and first[0]["maybe_more"]
    nxt = history.page(h, "m/1", before=F.expr("TIMESTAMP '2024-01-01 00:03:00'"), size=4).collect()
    assert [r["correlation_id"] for r in nxt] == ["c2", "c1", "c0"] and not nxt[0]["maybe_more"]
    assert history.page(h, "none").count() == 0
    tied = h.withColumn("processed_at", F.lit(T).cast("timestamp"))
    seen, cursor = [], None
    while rows_ := history.page(tied, "m/1", cursor, size=2).collect():
        seen += [r["correlation_id"] for r in rows_]
        cursor = rows_[-1]
    assert seen == ["c0", "c1", "c2", "c3", "c4"]
    assert [(r["outcome"], r["entries"]) for r in history.summary(h).collect()] == [("Created", 4), ("Failed", 1)]
    history.append(h, f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log").filter("outcome = 'Failed'").first()
    assert stored["map_partition"] == "m_1" and len(stored["error"]) == 4001
    blank = h.filter("outcome = 'Created'").withColumn("source_record_id", F.lit("  id 1  "))
    history.write_csv(blank, f"{tmp_path}/blanks")
    assert {r[0].split(",")[4] for r in spark.read.text(f"{tmp_path}/blanks").collect()} == {"  id 1  ", "sourceRecordId"}
    plan = history.page(spark.read.parquet(f"{tmp_path}/log"), "m/1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(map_partition" in plan
    history.write_csv(h, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv")
    assert back.columns == list(history.CSV_COLUMNS)
    assert back.filter("outcome = 'Failed'").first()["error"].startswith('said "no", twice\nx')


def test_a_walk_over_tied_rows_meets_each_once(spark, tmp_path):
    """One record, one transaction, one processing time, no delivery counts: only the stored row number differs."""
    rows = [("m/1", T, "Failed", "Update", "erp", "r", "crm", None, None, T, str(i), None, "c") for i in range(120)]
    older = [("m/1", datetime(2023, 1, 1, tzinfo=timezone.utc), "Created", "Update", "erp", "r", "crm", None, None, T, "old", 1, None)]
    history.append(spark.createDataFrame(rows + older, HISTORY), f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    seen, cursor, more = [], None, True
    while more:
        page = history.page(stored, "m/1", cursor).collect()
        seen += [r["error"] for r in page]
        cursor, more = page[-1], page[-1]["maybe_more"]
    assert sorted(seen) == sorted([str(i) for i in range(120)] + ["old"]) and seen[-1] == "old"
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = history.page(stored, "m/1", cursor)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(newest_first" in scan


def test_tied_rows_are_stored_by_several_tasks(spark, tmp_path):
    rows = [("m/1", T, "Failed", "Update", "erp", "r", "crm", None, None, T, str(i), None, "c") for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        history.append(spark.createDataFrame(rows, HISTORY), f"{tmp_path}/log")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "log").rglob("*.parquet"))) > 1


@pytest.mark.parametrize("size", [1, 7, 20, 21])
def test_large_pages_are_cut_like_small_ones(spark, tmp_path, monkeypatch, size):
    rows = [("m/1", T if i % 3 else None, "Failed", "Update", "erp", None if i % 2 else "r", "crm", None, None, T, str(i), None, "c") for i in range(20)]
    history.append(spark.createDataFrame(rows, HISTORY), f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    twice = spark.createDataFrame(rows + rows, HISTORY).drop("error")  # equal in all that orders them
    small = [history.page(t, "m/1", size=size).collect() for t in (stored, twice)]
    monkeypatch.setattr(history, "TASK_PAGE", 0)
    large = [history.page(t, "m/1", size=size) for t in (stored, twice)]
    assert [t.collect() for t in large] == small
    assert "TakeOrdered" not in large[0]._jdf.queryExecution().executedPlan().toString()


def test_maps_round_trip(spark, tmp_path):
    doc = {"name": "m", "sourceSystem": "erp", "sourceEntity": "e", "targetSystem": "crm", "targetEntity": "f", "direction": "oneWay",
           "status": "paused", "companies": ["x"], "integrationKey": ["k"], "version": 8,
           "fields": [{"source": "a", "target": "k", "valueMap": {"1": "one"}, "defaultValue": 5}],
           "schedule": {"cron": "0 0 * * * *", "mode": "fullExport", "detectDeletes": True}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "note.txt").write_text("not a map")
    read = maps.read_maps(spark, str(tmp_path))
    assert json.loads(maps.to_documents(read).first()["document"]) == doc
    assert read.select(maps.violations()).first()[0] == []
    assert maps.get_map(read, "gone").count() == 0
    both = read.unionByName(read.withColumn("name", F.lit("n")))
    maps.write_maps(both, f"{tmp_path}/out")
    again = maps.read_maps(spark, f"{tmp_path}/out")
    assert sorted(r["document"] for r in maps.to_documents(again).collect()) == sorted(r["document"] for r in maps.to_documents(both).collect())
    assert maps.delete_maps(read, spark.createDataFrame([("zzz",)], "name STRING")).count() == 1


def test_maps_share_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maps, "FILE_MAPS", 4)
    docs = [json.dumps({"name": f"m{i}", "companies": [], "fields": [{"source": "a", "target": "b", "defaultValue": i}]}) for i in range(10)]
    some = maps.parse_maps(spark.createDataFrame([(d,) for d in [*docs, docs[0]]], "document STRING").coalesce(1))
    maps.write_maps(some, str(tmp_path))
    assert len(list(tmp_path.glob("*.json"))) == 3
    (tmp_path / "own.json").write_text('{"name": "own",\n "fields": []}')
    read = maps.read_maps(spark, str(tmp_path))
    own = maps.parse_maps(spark.createDataFrame([('{"name": "own", "fields": []}',)], "document STRING"))
    wanted = maps.to_documents(some.unionByName(own)).collect()
    assert sorted(r["document"] for r in maps.to_documents(read).collect()) == sorted(r["document"] for r in wanted)


def test_catalogs(spark):
    options = {"LogicalName": "f", "OptionSet": {"Options": []}, "GlobalOptionSet": {"Options": [{"Value": 2, "Label": None}, {"Value": 1, "Label": {"UserLocalizedLabel": {"Label": "one"}}}]}}
    sets = catalog.read_documents(spark.createDataFrame([(json.dumps(options),)], "document STRING"), catalog.CRM_OPTIONS)
    assert {r["value"]: r["label"] for r in catalog.crm_options(sets).collect()} == {"2": "2", "1": "one"}
    names = spark.createDataFrame([("b", True), ("B", True), ("", True), ("a", False), ("_c", True)], "name STRING, listed BOOLEAN")
    assert [r["name"] for r in catalog.entities(names, "name", "listed").collect()] == ["B", "_c"]


def test_text_rules(spark):
    row = spark.createDataFrame([("a/b\\c#d?e\u0001\u0085",)], "s STRING")
    assert row.select(keys.sanitize_partition("s")).first()[0] == "a_b_c_d_e__"
    assert row.select(text.is_erp_name(F.lit("Ab_1")), text.is_erp_name(F.lit("a b")), text.is_crm_name(F.lit("Ab")), text.is_crm_name(F.lit(""))).first()[:] == (True, False, False, False)
    body = spark.createDataFrame([({"b": "1", "a": '"x"', 'q"': "null"},)], "d MAP<STRING,STRING>")
    assert body.select(values.canonical_json("d")).first()[0] == '{"a":"x","b":1,"q\\"":null}'


def test_keyed_table_batches_repeat_safely(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k INT, v INT")
    assert table.version() is None and table.read().count() == 0
    table.write(spark.createDataFrame([(1, 1)], "k INT, v INT"), 1)
    for _ in range(2):
        assert [r["v"] for r in table.before(2).collect()] == [1]
        table.write(spark.createDataFrame([(1, 2)], "k INT, v INT"), 2)
    assert [r["v"] for r in table.read().collect()] == [2] and table.version() == 2


def test_an_update_writes_only_the_buckets_it_touches(spark, tmp_path):
    """Ten records of ten thousand: their buckets get new files, all others are shared with the version
    before; an emptied bucket goes, a repeated batch writes the same, old versions are removed."""
    schema, root = "k STRING, v INT", tmp_path / "t"
    table = KeyedTable(spark, str(root), schema, ["k"], buckets=16)
    table.write(spark.range(10_000).selectExpr("'K' || id AS k", "0 AS v"), 1)
    assert len(list(root.glob("v=1/bucket=*"))) == 16
    ten = spark.range(0, 10_000, 3_500).selectExpr("'k' || id AS K2", "7 AS w")  # the case of a key does not move it

    def merge(old):
        return old.join(ten, F.lower("k") == F.col("K2"), "left").select("k", F.coalesce("w", "v").alias("v"))

    for _ in range(2):
        table.update(ten, 2, merge, ["K2"])
        touched = {p.name for p in root.glob("v=2/bucket=*")}
        assert 1 <= len(touched) <= 3 and {p.name for p in root.glob("v=1/bucket=*")} >= {f"bucket={i}" for i in range(16)}
        assert table.read().groupBy("v").count().orderBy("v").collect() == [(0, 9_997), (7, 3)]
        assert table.before(2).filter("v = 7").count() == 0
    again = KeyedTable(spark, str(root), schema, ["k"], buckets=64)  # the number it was written with holds
    again.update(spark.range(0).selectExpr("'x' AS k"), 3, lambda old: old)
    assert again.read().count() == 10_000 and not list(root.glob("v=3/*"))
    gone = spark.range(10_000).selectExpr("'K' || id AS k")
    again.update(gone, 4, lambda old: old.filter("v = 7"))
    assert again.read().count() == 3
    again.update(spark.range(0).selectExpr("'x' AS k"), 5, lambda old: old)
    again.update(spark.range(0).selectExpr("'x' AS k"), 6, lambda old: old)
    assert again.read().count() == 3 and sorted(p.name for p in root.glob("v=*")) == ["v=4"]
    assert sorted(p.name for p in (root / "_commits").glob("[0-9]*")) == ["4", "5", "6"]


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    """A second writer commits while the first one merges: the first reads again and both changes are there,
    versions of the links counted up by each. What the lost attempt wrote is removed; a batch older than the table is refused."""
    root = tmp_path / "links"
    table = KeyedTable(spark, str(root), "k STRING, v INT, version INT", ["k"], buckets=2)
    other = KeyedTable(spark, str(root), "k STRING, v INT, version INT", ["k"], buckets=2)
    merges = []

    def adding(n):
        def merge(old):
            return old.select("k", (F.col("v") + n).alias("v"), (F.col("version") + 1).alias("version"))
        return merge

    def slow(old):
        merges.append(1)
        if len(merges) == 1:  # the race: the other writer is through before this one commits
            assert other.change(one, adding(10)) == 2
        return adding(1)(old)

    one = spark.createDataFrame([("x",)], "k STRING")
    first = spark.createDataFrame([("x", 0, 1)], "k STRING, v INT, version INT")
    assert table.change(first, lambda old: old.unionByName(first)) == 1
    assert table.change(one, slow) == 3 and len(merges) == 2
    assert [r[:] for r in table.read().collect()] == [("x", 11, 3)]
    assert len(list(root.glob("v=*"))) == 3  # one folder a version, none of the lost attempt
    for n in range(4):
        table.change(one, adding(n))
    assert [r[:] for r in other.read().collect()] == [("x", 17, 7)] and len(list(root.glob("v=*"))) <= 4

    def beaten(old):
        other.change(one, adding(0))
        return old

    with pytest.raises(StaleWriter):
        table.change(one, beaten, attempts=2)
    with pytest.raises(StaleWriter):
        table.write(first, 1)
    assert [r["v"] for r in table.read().collect()] == [17]


def test_interleaved_savers_lose_no_link(spark, tmp_path):
    """Both save a link of their own and one that they share; the slower one starts over on what the other saved."""
    saved = f"{XREF_LINK}, save_order LONG"
    row = lambda n, order: (*link(n), order)
    mine, theirs = (spark.createDataFrame([row(n, i), row(9, i)], saved) for n, i in ((1, 1), (2, 2)))
    tables = [KeyedTable(spark, str(tmp_path / "links"), XREF_ROW, ["lookup_key"], 2) for _ in range(2)]
    entered = []

    def slow(old):
        entered.append(1)
        if len(entered) == 1:
            tables[1].change(xref.mirrors(theirs), lambda rows: xref.save(rows, theirs, "save_order"))
        return xref.save(old, mine, "save_order")

    tables[0].change(xref.mirrors(mine), slow)
    got = {(r["record_id_a"], r["version"]) for r in tables[1].read().collect()}
    assert len(entered) == 2 and got == {("A1", 1), ("A2", 1), ("A9", 2)} and tables[1].read().count() == 6
