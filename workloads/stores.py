"""Links, targets, watermarks, maps and catalogs as keyed tables."""

import uuid

from pyspark.sql import DataFrame, functions as F

from changesync.functions.values import canonical_json
from changesync.functions.transforms import Transforms
from changesync.operators import route, targets, xref as links
from changesync.operators.mapping import CompiledMaps
from changesync.schema import FIELD_MAP
from changesync.session import ensure_checkpoint_dir
from changesync.sources import catalog, maps as map_store, watermarks
from changesync.storage import KeyedTable, Scratch
from workloads import adapters as a
from workloads.registry import workload

LINKS = f"WITH {a.LINKS}"

# --- links ------------------------------------------------------------------------------


@workload("tombstones", f"{LINKS} SELECT record_id_a, has_state AND tomb AS tombstone FROM links")
def tombstones(spark, sf_dir):
    return a.links(spark, sf_dir).select("record_id_a", links.is_tombstone().alias("tombstone"))


@workload("xref_other_side", f"""{LINKS} SELECT record_id_a, record_id_a AS in_erp, record_id_b AS in_crm, CAST(NULL AS VARCHAR) AS in_dw FROM links""")
def xref_other_side(spark, sf_dir):
    return a.links(spark, sf_dir).select("record_id_a", *[
        links.record_id_in(F.lit(s)).alias(n) for s, n in (("ERP", "in_erp"), ("crm", "in_crm"), ("dw", "in_dw"))
    ])


def link_edits(spark, sf_dir) -> DataFrame:
    """Saves for every customer: the contact moves to the nation's own record, so many links
    share a side and the latest save owns its mirror."""
    return a.table(spark, sf_dir, "customer").select(
        F.lit("crm:contact|erp:accounts").alias("pair_key"), F.lit("erp").alias("system_a"),
        F.concat(F.lit("a-"), "c_custkey").alias("record_id_a"), F.lit("crm").alias("system_b"),
        F.concat(F.lit("n-"), "c_nationkey").alias("record_id_b"),
        F.lit(None).cast(a.xref(spark, sf_dir).schema["state"].dataType).alias("state"), F.col("c_custkey").alias("saved_at"),
    )


@workload("xref_save", f"""{LINKS}, old AS (
    SELECT lower(pair_key || '|erp|' || record_id_a) AS lookup_key, record_id_a, record_id_b, version FROM links
    UNION ALL SELECT lower(pair_key || '|crm|' || record_id_b), record_id_a, record_id_b, version FROM links
  ), edits AS (
    SELECT 'crm:contact|erp:accounts|erp|a-' || c_custkey AS lookup_key, 'a-' || c_custkey AS record_id_a, 'n-' || c_nationkey AS record_id_b, c_custkey FROM customer
    UNION ALL SELECT 'crm:contact|erp:accounts|crm|n-' || c_nationkey, 'a-' || c_custkey, 'n-' || c_nationkey, c_custkey FROM customer
  ), new AS (
    SELECT lookup_key, max_by(record_id_a, c_custkey) AS record_id_a, max_by(record_id_b, c_custkey) AS record_id_b, count(*) AS saves FROM edits GROUP BY lookup_key
  ) SELECT coalesce(o.lookup_key, n.lookup_key) AS lookup_key, coalesce(n.record_id_a, o.record_id_a) AS record_id_a,
    coalesce(n.record_id_b, o.record_id_b) AS record_id_b, coalesce(o.version, 0) + coalesce(n.saves, 0) AS version
  FROM old o FULL OUTER JOIN new n ON o.lookup_key = n.lookup_key""")
def xref_save(spark, sf_dir):
    after = links.save(a.xref(spark, sf_dir), link_edits(spark, sf_dir), "saved_at")
    return after.select("lookup_key", "record_id_a", "record_id_b", "version")


@workload("xref_conditional_save", f"""{LINKS} SELECT 'a-' || c_custkey AS record_id_a,
    CASE WHEN l.u IS NOT NULL AND l.version = 2 THEN 'accepted' ELSE 'rejected' END AS verdict
  FROM customer c LEFT JOIN links l ON l.u = c.c_custkey""")
def xref_conditional_save(spark, sf_dir):
    """Every customer's link is saved as if read at version 2."""
    saves = a.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("a-"), "c_custkey").alias("record_id_a"),
        F.concat(F.lit("crm:contact|erp:accounts|erp|a-"), "c_custkey").alias("read_key"), F.lit(2).cast("bigint").alias("read_version"),
    )
    accepted, rejected = links.conditional_save(a.xref(spark, sf_dir), saves)
    return accepted.select("record_id_a", F.lit("accepted").alias("verdict")).unionByName(
        rejected.select("record_id_a", F.lit("rejected").alias("verdict"))
    )


@workload("xref_pair_scan", f"{LINKS} SELECT record_id_a, record_id_b, has_state FROM links")
def xref_pair_scan(spark, sf_dir):
    found = links.links_of_pair(a.xref(spark, sf_dir), "CRM:Contact|erp:accounts")
    return found.select("record_id_a", "record_id_b", F.col("state").isNotNull().alias("has_state"))


# --- targets ----------------------------------------------------------------------------

def order_writes(spark, sf_dir) -> DataFrame:
    """Orders as writes to the contact of their customer: priority by field, finished orders
    delete it, customers whose key is even are written under a new id."""
    new = F.when(F.col("o_custkey") % 2 == 0, F.lit("n-")).otherwise(F.lit("c-"))
    body = F.create_map(F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))), F.col("o_orderkey").cast("string"),
                        F.lit("last"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    return a.table(spark, sf_dir, "orders").select(
        F.lit("CRM").alias("target_system"), F.lit("Contact").alias("target_entity"), F.concat(new, "o_custkey").alias("record_id"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400_000), F.lit("Delete")).otherwise(F.lit("Update")).alias("operation"),
        body.alias("fields"), F.col("o_orderkey").alias("write_order"),
    )


NET = """WITH w AS (
    SELECT CASE WHEN o_custkey % 2 = 0 THEN 'n-' ELSE 'c-' END || o_custkey AS record_id, o_orderkey AS pos,
      o_orderstatus = 'F' AND o_totalprice > 400000 AS gone, 'p' || left(o_orderpriority, 1) AS f, o_orderstatus AS st FROM orders
  ), d AS (SELECT record_id, max(pos) FILTER (WHERE gone) AS gone_at, max(pos) AS last_at FROM w GROUP BY record_id
  ), parts AS (
    SELECT record_id, f, max(pos)::VARCHAR AS v FROM w JOIN d USING (record_id) WHERE NOT gone AND (gone_at IS NULL OR pos > gone_at) GROUP BY ALL
    UNION ALL
    SELECT record_id, 'last', '"' || max_by(st, pos) || '"' FROM w JOIN d USING (record_id) WHERE NOT gone AND (gone_at IS NULL OR pos > gone_at) GROUP BY ALL
  ), old AS (
    SELECT 'c-' || c_custkey AS record_id, 'k' AS f, CAST(c_nationkey % 4 AS VARCHAR) AS v FROM customer
    UNION ALL SELECT 'c-' || c_custkey, 'ref', '"' || CASE WHEN c_custkey % 7 = 3 THEN 'Q' ELSE 'R' END || c_custkey || '"' FROM customer
    UNION ALL SELECT 'c-' || c_custkey, 'name', '"' || c_name || '"' FROM customer
  ), kept AS (
    SELECT o.* FROM old o LEFT JOIN d USING (record_id) WHERE d.gone_at IS NULL
    UNION ALL SELECT p.* FROM parts p
  ), state AS (SELECT record_id, '{' || string_agg('"' || f || '":' || v, ',' ORDER BY f) || '}' AS fields FROM kept GROUP BY record_id)"""


# The rows of the other systems, which no write names.
OTHERS = """(SELECT 'a-' || c_custkey AS record_id, '{"ref":"R' || c_custkey || '"}' AS fields FROM customer
  UNION ALL SELECT 'ref=''R' || c_custkey || '''', '{"ref":"R' || c_custkey || '","segment":"AUTOMOBILE"}' FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"""


def after_writes(spark, sf_dir) -> DataFrame:
    return targets.apply_writes(a.target(spark, sf_dir), targets.net_writes(order_writes(spark, sf_dir)))


@workload("target_upsert", f"{NET} SELECT record_id, fields FROM state UNION ALL SELECT * FROM {OTHERS}")
def target_upsert(spark, sf_dir):
    return after_writes(spark, sf_dir).select("record_id", canonical_json("fields").alias("fields"))


@workload("target_upsert_created", f"""{NET} SELECT record_id, record_id LIKE 'n-%' AS created, record_id IN (SELECT record_id FROM w) AS written FROM state
  UNION ALL SELECT record_id, FALSE, FALSE FROM {OTHERS}""")
def target_upsert_created(spark, sf_dir):
    return after_writes(spark, sf_dir).select("record_id", "created", "written")


@workload("target_delete", f"""{NET} SELECT 'c-' || c_custkey AS record_id FROM customer WHERE 'c-' || c_custkey NOT IN (SELECT record_id FROM w WHERE gone)
  UNION ALL SELECT record_id FROM {OTHERS}""")
def target_delete(spark, sf_dir):
    deletes = order_writes(spark, sf_dir).filter("operation = 'Delete'")
    return targets.apply_deletes(a.target(spark, sf_dir), deletes).select("record_id")


@workload("resolve_integration_key", """WITH n AS (SELECT p_name, p_type, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(n.n, 0) > 0 AS found,
    CASE WHEN n.n > 1 THEN NULL ELSE 'p-' || n.id END AS matched, coalesce(n.n > 1, FALSE) AS ambiguous
  FROM lineitem JOIN part p ON p.p_partkey = l_partkey
  LEFT JOIN n ON n.p_name = p.p_name AND n.p_type = CASE WHEN l_returnflag = 'R' THEN 'NONE' ELSE p.p_type END""")
def resolve_integration_key(spark, sf_dir):
    """Order lines look for their part by the composite key name and type, which is not unique;
    returned lines look for a type that does not exist."""
    part = a.table(spark, sf_dir, "part")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = lambda t: F.create_map(F.lit("name"), q(F.col("p_name")), F.lit("type"), q(t))
    snapshot = part.select(
        F.lit("erp").alias("system"), F.lit("Parts").alias("entity_name"), F.concat(F.lit("p-"), "p_partkey").alias("record_id"),
        body(F.col("p_type")).alias("fields"))
    wanted = F.when(F.col("l_returnflag") == "R", F.lit("NONE")).otherwise(F.col("p_type"))
    rows = a.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("lines").alias("map_name"), F.lit("erp").alias("target_system"),
        F.lit("Parts").alias("target_entity"), body(wanted).alias("mapped"),
        F.lit(None).cast("string").alias("map_error"), F.lit(None).cast("string").alias("link_target_id"), F.lit(None).cast("string").alias("company"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("arrival_seq"))
    config = spark.range(1).select(
        F.lit("lines").alias("map_name"), F.lit("erp").alias("target_system"), F.lit("Parts").alias("target_entity"),
        F.array(F.lit("type"), F.lit("name")).alias("integration_key"), F.lit(None).cast(f"ARRAY<{FIELD_MAP}>").alias("fields"))
    compiled = CompiledMaps.load(config, Transforms())
    found = targets.resolve_targets(
        targets.with_key_segment(targets.with_mode(rows, {}), compiled), targets.target_index(snapshot, config, {}))
    exact = F.col("target_exists") & F.col("key_error").isNull()
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("target_exists").alias("found"),
        F.when(exact, F.col("resolved_id")).alias("matched"), F.col("key_error").isNotNull().alias("ambiguous"))


@workload("key_index_update", f"""{NET} SELECT 'match|m1|ref=''' || CASE WHEN c_custkey % 7 = 3 THEN 'Q' ELSE 'R' END || c_custkey || '''' AS probe_key, 'c-' || c_custkey AS record_id
    FROM customer WHERE 'c-' || c_custkey NOT IN (SELECT record_id FROM d WHERE gone_at IS NOT NULL)
  UNION ALL SELECT 'match|m2|ref=''R' || c_custkey || '''', 'a-' || c_custkey FROM customer
  UNION ALL SELECT 'id|dw|account|ref=''R' || c_custkey || '''', 'ref=''R' || c_custkey || '''' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def key_index_update(spark, sf_dir):
    """The stored index after a batch of writes: records written anew have no key field, nor have those that a
    delete emptied before."""
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}", targets.KEY_ENTRY, ["probe_key"], 8)
    active, snapshot = route.active_maps(a.maps(spark)), a.target(spark, sf_dir)
    table.write(targets.key_entries(snapshot, active, a.SYSTEMS), 0)
    scratch = Scratch(spark)
    changes = targets.entry_changes(snapshot, targets.net_writes(order_writes(spark, sf_dir)), active, a.SYSTEMS)
    moved = scratch.keep(changes, "moved")
    table.update(moved, 1, lambda old: targets.apply_entries(old, moved))
    scratch.delete()
    return table.read()


# --- watermarks -------------------------------------------------------------------------

STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00'"


def marks(spark, sf_dir) -> DataFrame:
    """A mark per customer and system, as a finished run would have left it."""
    return a.table(spark, sf_dir, "customer").select(
        F.lit("ERP").alias("system"), F.concat(F.lit("map:C"), "c_custkey").alias("scope"),
        watermarks.token_of(F.expr("TIMESTAMP '1997-01-01 00:00:00' + make_dt_interval(c_nationkey)")).alias("token"),
        F.expr("TIMESTAMP '1999-01-01 00:00:00'").alias("updated_at"))


MARKS = f"""marks AS (SELECT 'map:C' || c_custkey AS scope, {STAMP.format("TIMESTAMP '1997-01-01' + to_days(c_nationkey)")} AS token FROM customer)"""


@workload("watermark_get", f"""WITH {MARKS} SELECT o_orderkey, coalesce(m.token, '') AS token FROM orders LEFT JOIN marks m
  ON o_orderpriority <> '5-LOW' AND lower(m.scope) = 'map:c' || o_custkey""")
def watermark_get(spark, sf_dir):
    wanted = a.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("crm")).otherwise(F.lit("erp")).alias("system"),
        F.concat(F.lit("MAP:c"), "o_custkey").alias("scope"))
    return watermarks.get(marks(spark, sf_dir), wanted).select("o_orderkey", "token")


def order_marks(spark, sf_dir) -> DataFrame:
    events = a.table(spark, sf_dir, "orders").select(
        F.lit("erp").alias("system"), watermarks.scope_of(F.concat(F.lit("c"), "o_custkey")).alias("scope"),
        F.col("o_orderdate").cast("timestamp").alias("occurred_at"))
    return watermarks.advance(events, ["system", "scope"], F.expr("TIMESTAMP '2000-01-01 00:00:00'"))


@workload("watermark_advance", f"""SELECT 'map:c' || o_custkey AS scope, {STAMP.format('max(o_orderdate)')} AS token FROM orders GROUP BY o_custkey""")
def watermark_advance(spark, sf_dir):
    return order_marks(spark, sf_dir).select("scope", "token")


@workload("watermark_save", f"""WITH {MARKS}, n AS (SELECT 'map:c' || o_custkey AS scope, {STAMP.format('max(o_orderdate)')} AS token FROM orders GROUP BY o_custkey)
  SELECT coalesce(n.scope, m.scope) AS scope, coalesce(n.token, m.token) AS token FROM marks m FULL OUTER JOIN n ON lower(m.scope) = n.scope""")
def watermark_save(spark, sf_dir):
    return watermarks.save(marks(spark, sf_dir), order_marks(spark, sf_dir)).select("scope", "token")


# --- maps -------------------------------------------------------------------------------

def part_documents(spark, sf_dir) -> DataFrame:
    """A map document per part, with every kind of flaw spread over them."""
    doc = """'{"name":"' || CASE WHEN p_size = 1 THEN '  ' ELSE 'map ' || p_partkey END || '","sourceSystem":"ERP","sourceEntity":"' ||
      CASE WHEN p_size = 2 THEN ' ' ELSE p_name END || '","targetSystem":"' || CASE WHEN p_size = 3 THEN 'erp' WHEN p_size < 20 THEN 'crm' ELSE 'Lake' END ||
      '","targetEntity":"' || lower(p_type) || '","status":"' || CASE WHEN p_brand LIKE '%1' THEN 'paused' ELSE 'active' END ||
      '","companies":["' || p_brand || '","all"],"fields":[{"source":" no ","target":"' || CASE WHEN p_size = 4 THEN ' ' ELSE ' Number' END ||
      '","transform":" ","valueMap":{" a ":"b"," ":"c"}},{"source":"","target":"Blank"},{"source":"size","target":"' ||
      CASE WHEN p_size = 4 THEN '' ELSE 'Size' END || '","defaultValue":' || p_size || '}],"integrationKey":[' ||
      CASE WHEN p_size = 5 THEN '' ELSE '"number","Gone"' END || ']' || CASE WHEN p_size > 30 THEN ',"version":' || p_size ELSE '' END ||
      CASE WHEN p_type = 'ECONOMY' THEN ',"schedule":{"cron":"' || CASE WHEN p_size = 6 THEN ' ' ELSE '0 */15 * * * *' END || '","detectDeletes":true}' ELSE '' END || '}'"""
    return a.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{doc} AS document")


def part_maps(spark, sf_dir) -> DataFrame:
    return map_store.parse_maps(part_documents(spark, sf_dir))


NAMES = "CASE WHEN p_size = 1 THEN '  ' ELSE 'map ' || p_partkey END"
TARGET = "CASE WHEN p_size = 3 THEN 'erp' WHEN p_size < 20 THEN 'crm' ELSE 'Lake' END"


@workload("maps_all", f"""SELECT {NAMES} AS name, CASE WHEN p_size = 2 THEN ' ' ELSE p_name END AS source_entity, {TARGET} AS target_system,
  CASE WHEN p_brand LIKE '%1' THEN 'paused' ELSE 'active' END AS status, 'oneWay' AS direction, p_brand || ',all' AS companies, 3 AS n_fields,
  CASE WHEN p_size > 30 THEN p_size ELSE 1 END AS version, CASE WHEN p_type = 'ECONOMY' THEN 'incremental' END AS mode FROM part""")
def maps_all(spark, sf_dir):
    """Written to a folder of documents and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/maps-{uuid.uuid4().hex}"
    map_store.write_maps(part_maps(spark, sf_dir), path)
    return map_store.read_maps(spark, path).select(
        "name", "source_entity", "target_system", "status", "direction", F.array_join("companies", ",").alias("companies"),
        F.size("fields").alias("n_fields"), "version", F.col("schedule.mode").alias("mode"))


@workload("maps_get", f"SELECT {NAMES} AS name, {TARGET} AS target_system FROM part WHERE {NAMES} = 'map 7'")
def maps_get(spark, sf_dir):
    return map_store.get_map(part_maps(spark, sf_dir), "map 7").select("name", "target_system")


@workload("maps_by_kind", "SELECT CASE WHEN p_type = 'ECONOMY' THEN 'scheduled' ELSE 'event' END AS kind, count(*) AS maps FROM part GROUP BY ALL")
def maps_by_kind(spark, sf_dir):
    return map_store.with_kind(part_maps(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("maps"))


@workload("maps_runnable", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS due_us FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_size <> 1 AND p_type = 'ECONOMY' AND p_brand NOT LIKE '%1'""")
def maps_runnable(spark, sf_dir):
    requests = a.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("map "), "l_partkey").alias("map_name"), F.col("l_shipdate").cast("timestamp").alias("scheduled_for"))
    ready = map_store.runnable(part_maps(spark, sf_dir), requests)
    return ready.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros("scheduled_for").alias("due_us"))


@workload("maps_validate", """SELECT CASE WHEN p_size = 1 THEN 'name is missing' WHEN p_size = 2 THEN 'an entity is missing'
    WHEN p_size = 3 THEN 'source and target are the same system' WHEN p_size = 4 THEN 'no field is mapped'
    WHEN p_size = 5 THEN 'no integration key' WHEN p_size = 6 AND p_type = 'ECONOMY' THEN 'the schedule has no cron expression' END AS problem, count(*) AS maps FROM part GROUP BY ALL""")
def maps_validate(spark, sf_dir):
    maps = part_maps(spark, sf_dir).select(F.get(map_store.violations(), F.lit(0)).alias("problem"))
    return maps.groupBy("problem").agg(F.count("*").alias("maps"))


@workload("maps_complete_fields", f"""SELECT {NAMES} AS name, CASE WHEN p_size = 4 THEN '' ELSE 'no>Number,size>Size' END AS fields,
  CASE WHEN p_size = 4 THEN NULL ELSE 'a=b' END AS value_map, CASE WHEN p_size <> 4 THEN CAST(p_size AS VARCHAR) END AS default_value FROM part""")
def maps_complete_fields(spark, sf_dir):
    done = part_maps(spark, sf_dir).select("name", map_store.complete_fields().alias("f"))
    names = F.array_join(F.transform("f", lambda x: F.concat(x["source"], F.lit(">"), x["target"])), ",")
    pairs = F.map_entries(F.get("f", F.lit(0))["value_map"])
    return done.select(
        "name", names.alias("fields"),
        F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("value_map"),
        F.get("f", F.lit(1))["default_value"].alias("default_value"))


@workload("maps_prune_key", f"SELECT {NAMES} AS name, CASE WHEN p_size IN (4, 5) THEN '' ELSE 'number' END AS kept FROM part")
def maps_prune_key(spark, sf_dir):
    return part_maps(spark, sf_dir).select("name", F.array_join(map_store.prune_key(), ",").alias("kept"))


@workload("maps_to_json", f"""SELECT '{{"name":"' || {NAMES} || '","sourceSystem":"ERP","sourceEntity":"' || CASE WHEN p_size = 2 THEN ' ' ELSE p_name END ||
  '","targetSystem":"' || {TARGET} || '","targetEntity":"' || lower(p_type) || '","direction":"oneWay","status":"' ||
  CASE WHEN p_brand LIKE '%1' THEN 'paused' ELSE 'active' END || '","companies":["' || p_brand || '","all"],"fields":[{{"source":" no ","target":"' ||
  CASE WHEN p_size = 4 THEN ' ' ELSE ' Number' END || '","transform":" ","valueMap":{{" a ":"b"," ":"c"}}}},{{"source":"","target":"Blank"}},{{"source":"size","target":"' ||
  CASE WHEN p_size = 4 THEN '' ELSE 'Size' END || '","defaultValue":' || p_size || '}}],"integrationKey":[' ||
  CASE WHEN p_size = 5 THEN '' ELSE '"number","Gone"' END || '],"version":' || CASE WHEN p_size > 30 THEN p_size ELSE 1 END ||
  CASE WHEN p_type = 'ECONOMY' THEN ',"schedule":{{"cron":"' || CASE WHEN p_size = 6 THEN ' ' ELSE '0 */15 * * * *' END || '","mode":"incremental","detectDeletes":true}}' ELSE '' END || '}}' AS document FROM part""")
def maps_to_json(spark, sf_dir):
    return map_store.to_documents(part_maps(spark, sf_dir)).select("document")


def version_log(spark, sf_dir) -> DataFrame:
    """A save of the part's map for each order line, in line order: a long version history."""
    lines = a.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("map "), "l_partkey").alias("name"), F.col("l_returnflag").alias("status"),
        F.col("l_quantity").cast("int").alias("version"))
    return lines.groupBy("name", "version").agg(F.min("status").alias("status"))


VERSIONS = """WITH log AS (SELECT 'map ' || l_partkey AS name, CAST(l_quantity AS INTEGER) AS version, min(l_returnflag) AS status FROM lineitem GROUP BY ALL),
  saved AS (SELECT * FROM log UNION ALL SELECT 'map ' || p_partkey, coalesce(l.last, 0) + 1, 'new' FROM part
    LEFT JOIN (SELECT name, max(version) AS last FROM log GROUP BY name) l ON l.name = 'map ' || p_partkey)"""


@workload("maps_save_version", f"{VERSIONS} SELECT name, count(*) AS versions, max(version) AS current, max_by(status, version) AS status FROM saved GROUP BY name")
def maps_save_version(spark, sf_dir):
    edits = a.table(spark, sf_dir, "part").select(F.concat(F.lit("map "), "p_partkey").alias("name"), F.lit("new").alias("status"))
    log = map_store.save_versions(version_log(spark, sf_dir), edits)
    now = map_store.current(log).select("name", F.col("version").alias("current"), "status")
    return log.groupBy("name").agg(F.count("*").alias("versions")).join(now, "name")


@workload("maps_delete", f"SELECT {NAMES} AS name FROM part WHERE p_size = 1 OR 'map ' || p_partkey NOT IN (SELECT 'map ' || s_suppkey FROM supplier)")
def maps_delete(spark, sf_dir):
    gone = a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("map "), "s_suppkey").alias("name"))
    return map_store.delete_maps(part_maps(spark, sf_dir), gone).select("name")


@workload("valuemap_duplicates", """SELECT p_brand AS field, p_name AS key, count(*) AS uses FROM part GROUP BY ALL HAVING count(*) > 1""")
def valuemap_duplicates(spark, sf_dir):
    pairs = a.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("field"), F.concat(F.lit(" \t"), "p_name", F.lit("  ")).alias("key"), F.col("p_type").alias("value"))
    return map_store.duplicate_value_map_keys(pairs, ["field"]).select("field", "key", "uses")


@workload("unknown_systems", f"SELECT {NAMES} AS name, {TARGET} AS target_system FROM part WHERE {TARGET} = 'Lake'")
def unknown_systems(spark, sf_dir):
    known = spark.range(1).select(F.explode(F.array(*[F.lit(s.upper()) for s in a.SYSTEMS])).alias("system"))
    return route.with_unknown_systems(part_maps(spark, sf_dir), known).select("name", "target_system")


# --- catalogs ---------------------------------------------------------------------------

@workload("catalog_fields_crm", """SELECT 'c_' || c_custkey AS entity_name, f.n AS field_name, f.t AS field_type, f.n = 'id' AS is_key FROM customer
  CROSS JOIN (VALUES ('id', 'Uniqueidentifier'), ('name', 'String'), ('segment', 'Unknown')) f(n, t)""")
def catalog_fields_crm(spark, sf_dir):
    doc = """'{"LogicalName":"c_' || c_custkey || '","PrimaryIdAttribute":"id","Attributes":[{"LogicalName":"id","AttributeType":"Uniqueidentifier","AttributeOf":null},
      {"LogicalName":"name","AttributeType":"String"},{"LogicalName":"segment","AttributeType":null},{"LogicalName":"segmentname","AttributeType":"Virtual","AttributeOf":"segment"}]}'"""
    docs = a.table(spark, sf_dir, "customer").selectExpr(f"{doc} AS document")
    return catalog.crm_fields(catalog.read_documents(docs, catalog.CRM_ENTITY))


ERP_DOC = """'{"EntitySetName":"Parts' || p_partkey || '","Properties":[{"Name":"dataAreaId","TypeName":"Edm.String","IsKey":true},' ||
  '{"Name":"No","TypeName":"Edm.Int64","IsKey":true},{"Name":"Kind","TypeName":"Catalog.Enums.' || p_type || '"},{"Name":"Free","TypeName":null}]}'"""


@workload("catalog_fields_erp", """SELECT 'Parts' || p_partkey AS entity_name, f.n AS field_name, coalesce(f.t, p_type) AS field_type, f.k AS is_key FROM part
  CROSS JOIN (VALUES ('dataAreaId', 'String', TRUE), ('No', 'Int64', TRUE), ('Kind', NULL, FALSE), ('Free', 'Unknown', FALSE)) f(n, t, k)""")
def catalog_fields_erp(spark, sf_dir):
    docs = a.table(spark, sf_dir, "part").selectExpr(f"{ERP_DOC} AS document")
    return catalog.erp_fields(catalog.read_documents(docs, catalog.ERP_ENTITY))


@workload("catalog_entities", """SELECT name FROM (SELECT min(CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END) AS name
  FROM part WHERE p_brand <> 'Brand#1' GROUP BY lower(p_name)) ORDER BY name""")
def catalog_entities(spark, sf_dir):
    listed = a.table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 25, F.upper("p_name")).when(F.col("p_brand") == "Brand#1", F.lit("")).otherwise(F.col("p_name")).alias("name"),
        (F.col("p_brand") != "Brand#1").alias("listed"))
    return catalog.entities(listed, "name", "listed")


@workload("catalog_companies", "SELECT DISTINCT p_brand AS company FROM part WHERE p_brand <> '' ORDER BY 1")
def catalog_companies(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", F.lit(""), F.lit(None))).alias("company"))
    return catalog.companies(rows, "company")


@workload("companies_union", """SELECT min(company) AS company FROM (SELECT p_brand AS company FROM part UNION ALL SELECT lower(p_brand) FROM part
  UNION ALL SELECT c_mktsegment FROM customer) GROUP BY lower(company)""")
def companies_union(spark, sf_dir):
    part = a.table(spark, sf_dir, "part")
    return catalog.companies_union(
        part.select(F.col("p_brand").alias("company")), part.select(F.lower("p_brand").alias("company")),
        a.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("company")))


@workload("catalog_options", """SELECT 'crm' AS system, 'c_' || c_custkey AS field_name, o.v AS value, coalesce(o.l, c_mktsegment) AS label FROM customer
    CROSS JOIN (VALUES (TRUE, '1', NULL), (TRUE, '2', '2'), (FALSE, '7', 'seven')) o(local, v, l) WHERE o.local = (c_acctbal >= 0)
  UNION ALL SELECT 'erp', 'Parts' || p_partkey || '.Kind', m, m FROM part CROSS JOIN (VALUES ('Yes'), ('No')) v(m) WHERE p_type <> 'SMALL'""")
def catalog_options(spark, sf_dir):
    doc = """'{"LogicalName":"c_' || c_custkey || '","OptionSet":' || CASE WHEN c_acctbal >= 0 THEN '{"Options":[{"Value":1,"Label":{"UserLocalizedLabel":{"Label":"' ||
      c_mktsegment || '"}}},{"Value":2,"Label":null}]}' ELSE '{"Options":[]}' END || ',"GlobalOptionSet":{"Options":[{"Value":7,"Label":{"UserLocalizedLabel":{"Label":"seven"}}}]}}'"""
    docs = a.table(spark, sf_dir, "customer").selectExpr(f"{doc} AS document")
    crm = catalog.crm_options(catalog.read_documents(docs, catalog.CRM_OPTIONS))
    part = a.table(spark, sf_dir, "part")
    entities = catalog.read_documents(part.selectExpr(f"{ERP_DOC} AS document"), catalog.ERP_ENTITY)
    fields = entities.select(F.col("EntitySetName").alias("entity_name"), F.explode("Properties").alias("p")).select(
        "entity_name", F.col("p.Name").alias("field_name"), F.col("p.TypeName").alias("type_name"))
    enums = part.filter("p_type <> 'SMALL'").select(F.to_json(F.struct(
        F.col("p_type").alias("Name"), F.array(*[F.struct(F.lit(m).alias("Name")) for m in ("Yes", "No", "")]).alias("Members"))).alias("document")).distinct()
    erp = catalog.erp_options(fields, catalog.read_documents(enums, catalog.ERP_ENUM))
    return crm.select(F.lit("crm").alias("system"), "field_name", "value", "label").unionByName(
        erp.select(F.lit("erp").alias("system"), F.concat_ws(".", "entity_name", "field_name").alias("field_name"), "value", "label"))
