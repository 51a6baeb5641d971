"""Scalar functions, field mapping, echo checks and write shapes over change events."""

from pyspark.sql import DataFrame, functions as F

from changesync.functions import keys, text, values
from changesync.functions.transforms import Transforms
from changesync.operators import echo, mapping, route, targets, xref as links
from changesync.operators.resolve import lww_discards
from changesync.operators.targets import create_body, update_body
from changesync.sources.maps import parse_maps
from workloads import adapters as a
from workloads.registry import workload

EV = f"WITH {a.EV}"


def ev(spark, sf_dir) -> DataFrame:
    return a.events(spark, sf_dir)


# --- keys and hashes --------------------------------------------------------------------

@workload("fn_payload_hash", f"{EV} SELECT event_id, data_json AS canonical, upper(sha256(data_json)) AS hash FROM evd")
def fn_payload_hash(spark, sf_dir):
    return ev(spark, sf_dir).select(
        "event_id", values.canonical_json("data").alias("canonical"), values.payload_hash("data").alias("hash")
    )


@workload("fn_pair_key", """
  SELECT p_partkey, CASE WHEN upper('ERP:' || p_name) <= upper(p_type || ':' || p_brand)
    THEN lower('ERP:' || p_name || '|' || p_type || ':' || p_brand)
    ELSE lower(p_type || ':' || p_brand || '|' || 'ERP:' || p_name) END AS pair_key FROM part""")
def fn_pair_key(spark, sf_dir):
    part = a.table(spark, sf_dir, "part")
    return part.select("p_partkey", keys.pair_key(F.lit("ERP"), "p_name", "p_type", "p_brand").alias("pair_key"))


@workload("fn_lookup_key", """
  SELECT page_id, regexp_replace(lower('crm:page|erp:page|Web|' || url), '[/\\\\#?]', '-', 'g') AS lookup_key FROM pages""")
def fn_lookup_key(spark, sf_dir):
    pages = a.table(spark, sf_dir, "pages")
    return pages.select("page_id", keys.lookup_key(F.lit("crm:page|erp:page"), F.lit("Web"), "url").alias("lookup_key"))


@workload("fn_session_id", f"{EV} SELECT event_id, source_system || ':' || entity_name || ':' || source_record_id AS session_id FROM ev")
def fn_session_id(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", keys.session_id().alias("session_id"))


MESSAGE_ID = """upper(sha256(source_system || '|' || entity_name || '|' || source_record_id || '|' ||
    CASE operation WHEN 'Create' THEN 0 WHEN 'Update' THEN 1 ELSE 2 END || '|' || ticks || '|' || upper(sha256(data_json))))"""


@workload("fn_message_id", f"{EV} SELECT event_id, {MESSAGE_ID} AS message_id FROM evd")
def fn_message_id(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", keys.message_id().alias("message_id"))


@workload("fn_idempotency_key", f"{EV} SELECT event_id, 'm1:' || source_record_id || ':' || ticks AS idempotency_key FROM evd")
def fn_idempotency_key(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", keys.idempotency_key(F.lit("m1")).alias("idempotency_key"))


@workload("fn_ticks", f"{EV} SELECT event_id, ticks FROM evd")
def fn_ticks(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", keys.utc_ticks("occurred_at").alias("ticks"))


@workload("inverted_ticks", f"{EV} SELECT event_id, lpad(CAST(3155378975999999999 - ticks AS VARCHAR), 19, '0') AS row_key FROM evd")
def inverted_ticks(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", keys.inverted_ticks("occurred_at").alias("row_key"))


@workload("fn_literal", """
  SELECT doc_id, '''' || replace(text, '''', '''''') || '''' AS text_literal, CAST(n_chars AS VARCHAR) AS number_literal,
    CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END AS flag_literal, 'null' AS null_literal FROM documents""")
def fn_literal(spark, sf_dir):
    d = a.table(spark, sf_dir, "documents").withColumns({
        "t": values.json_str("text"), "n": F.col("n_chars").cast("string"), "f": (F.col("n_chars") > 500).cast("string"),
        "z": F.lit(None).cast("string"),
    })
    return d.select(
        "doc_id", keys.literal("t").alias("text_literal"), keys.literal("n").alias("number_literal"),
        keys.literal("f").alias("flag_literal"), keys.literal("z").alias("null_literal"),
    )


@workload("fn_key_segment", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'dataAreaId=''' || l_returnflag || ''',Line=' || l_linenumber || ',Order=' || l_orderkey || ',part_no=''P' || l_partkey || '''' AS segment
  FROM lineitem""")
def fn_key_segment(spark, sf_dir):
    li = a.table(spark, sf_dir, "lineitem")
    parts = F.array(
        F.struct(F.lit("part_no").alias("name"), F.concat(F.lit('"P'), "l_partkey", F.lit('"')).alias("value")),
        F.struct(F.lit("Order").alias("name"), F.col("l_orderkey").cast("string").alias("value")),
        F.struct(F.lit("dataAreaId").alias("name"), F.concat(F.lit('"'), "l_returnflag", F.lit('"')).alias("value")),
        F.struct(F.lit("Line").alias("name"), F.col("l_linenumber").cast("string").alias("value")),
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", keys.key_segment(parts).alias("segment"))


@workload("fn_truncate", """
  SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '…' ELSE text END AS prefix FROM documents""")
def fn_truncate(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", text.truncate("text", 600).alias("prefix"))


@workload("fn_sanitize", "SELECT page_id, regexp_replace(url, '[/\\\\#?]', '_', 'g') AS folder FROM pages")
def fn_sanitize(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", keys.sanitize_partition("url").alias("folder"))


@workload("name_checks", """
  SELECT p_partkey, regexp_matches(replace(p_name, ' ', CASE WHEN p_size > 25 THEN '_' ELSE ' ' END), '^[A-Za-z0-9_]+$') AS erp_ok,
    regexp_matches(lower(p_type), '^[a-z0-9_]+$') AS crm_ok, regexp_matches(p_type, '^[a-z0-9_]+$') AS crm_raw_ok,
    regexp_matches(p_brand, '^[A-Za-z0-9_]+$') AS brand_ok FROM part""")
def name_checks(spark, sf_dir):
    name = F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    return a.table(spark, sf_dir, "part").select(
        "p_partkey", text.is_erp_name(name).alias("erp_ok"), text.is_crm_name(F.lower("p_type")).alias("crm_ok"),
        text.is_crm_name("p_type").alias("crm_raw_ok"), text.is_erp_name("p_brand").alias("brand_ok"),
    )


# --- field mapping ----------------------------------------------------------------------

def _mapped(spark, sf_dir, fields: str) -> DataFrame:
    """All events, of both systems, through a map with the given field list."""
    docs = [
        f'{{"name": "{s}", "sourceSystem": "{s}", "sourceEntity": "{e}", "targetSystem": "t", "targetEntity": "f", "fields": {fields}}}'
        for s, e in (("erp", "accounts"), ("crm", "contact"))
    ]
    maps = parse_maps(spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in docs])).alias("document")))
    return mapping.map_fields(route.route_events(ev(spark, sf_dir), maps))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("event_id", values.canonical_json("mapped").alias("mapped"), F.col("map_error").isNotNull().alias("failed"))


AMOUNT = "CASE WHEN has_amount THEN '\"Amount\":' || coalesce(CAST(amount AS VARCHAR), 'null') || ',' ELSE '' END"


@workload("map_fields", f"""{EV} SELECT event_id, '{{' || {AMOUNT} || '"grade":"g' || k || '","no":"' || ref || '","tag":"  TAG ' || k || ' "}}' AS mapped,
  FALSE AS failed FROM evd""")
def map_fields(spark, sf_dir):
    return _shown(_mapped(spark, sf_dir, """[
      {"source": "ref", "target": "no"}, {"source": "amount", "target": "Amount"}, {"source": "nothing", "target": "gone"},
      {"source": "k", "target": "grade", "valueMap": {"0": "g0", "1": "g1", "2": "g2", "3": "g3"}},
      {"source": "tag", "target": "tag", "transform": "toupper"}]"""))


@workload("map_absent_default", f"""{EV} SELECT event_id, '{{"Amount":' || CASE WHEN NOT has_amount THEN '0' ELSE coalesce(CAST(amount AS VARCHAR), 'null') END
  || ',"kind":"retail"}}' AS mapped, FALSE AS failed FROM evd""")
def map_absent_default(spark, sf_dir):
    return _shown(_mapped(spark, sf_dir, """[{"source": "amount", "target": "Amount", "defaultValue": 0},
      {"source": "missing", "target": "omitted"}, {"source": "Kind", "target": "kind", "defaultValue": "retail", "transform": "toUpper"}]"""))


@workload("map_present_null", f"""{EV} SELECT event_id, CASE WHEN has_amount AND amount IS NULL THEN '{{"Amount":null}}'
  ELSE '{{"Amount":"some"}}' END AS mapped, FALSE AS failed FROM evd""")
def map_present_null(spark, sf_dir):
    return _shown(_mapped(spark, sf_dir, """[{"source": "amount", "target": "Amount", "valueMap": {"x": "y"}, "defaultValue": "some"}]"""))


@workload("map_value_map", f"""{EV} SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE '{{"any":"' || CASE k WHEN 0 THEN 'low' ELSE 'other' END
  || '","grade":"' || CASE k WHEN 0 THEN 'gold "A"' WHEN 1 THEN 'silver' ELSE 'bronze' END || '"}}' END AS mapped,
  k = 3 AS failed FROM evd""".replace('gold "A"', 'gold \\"A\\"'))
def map_value_map(spark, sf_dir):
    return _shown(_mapped(spark, sf_dir, """[
      {"source": "k", "target": "grade", "valueMap": {"0": "gold \\"A\\"", "1": "silver", "2": "bronze"}},
      {"source": "k", "target": "any", "valueMap": {"0": "low"}, "defaultValue": "other"}]"""))


@workload("map_transform", f"""{EV} SELECT event_id, '{{"down":"  tag ' || k || ' ","k":' || k || ',"trimmed":"Tag ' || k || '","up":"  TAG ' || k || ' "}}' AS mapped,
  FALSE AS failed FROM evd""")
def map_transform(spark, sf_dir):
    return _shown(_mapped(spark, sf_dir, """[
      {"source": "tag", "target": "up", "transform": "TOUPPER"}, {"source": "tag", "target": "down", "transform": "toLower"},
      {"source": "tag", "target": "trimmed", "transform": "trim"}, {"source": "k", "target": "k", "transform": "trim"}]"""))


# --- routing, filters, echoes -----------------------------------------------------------

ROUTED = f"WITH {a.EV}, {a.MAPS}, {a.ROUTED}"


def routed(spark, sf_dir) -> DataFrame:
    return route.route_events(a.sync_events(spark, sf_dir), a.maps(spark))


@workload("route_events", f"{ROUTED} SELECT correlation_id, map_name, target_system, target_entity, pair_key FROM routed")
def route_events(spark, sf_dir):
    return routed(spark, sf_dir).select("correlation_id", "map_name", "target_system", "target_entity", "pair_key")


@workload("company_filter", f"{ROUTED} SELECT correlation_id, map_name, company, operation FROM admitted")
def company_filter(spark, sf_dir):
    return route.company_filter(routed(spark, sf_dir)).select("correlation_id", "map_name", "company", "operation")


@workload("echo_identity", f"{EV} SELECT event_id, lower(originating_user_id) IN ('svc-erp', 'svc-crm') AS echo FROM ev")
def echo_identity(spark, sf_dir):
    flagged = echo.flag_identity_echo(ev(spark, sf_dir), a.integration_users(spark))
    return flagged.select("event_id", F.col("identity_echo").alias("echo"))


LOOKED_UP = f"""{ROUTED}, {a.LINKS}, looked AS (
  SELECT r.*, l.u IS NOT NULL AS linked, coalesce(l.has_state, FALSE) AS has_state, l.hash, l.lw_at, l.tomb, l.version,
    CASE WHEN l.u IS NULL THEN NULL WHEN r.source_system = 'erp' THEN l.record_id_b ELSE l.record_id_a END AS other_id
  FROM admitted r LEFT JOIN links l ON r.map_name <> 'm3' AND l.u = r.user_id)"""


def looked_up(spark, sf_dir) -> DataFrame:
    return links.lookup(route.company_filter(routed(spark, sf_dir)), a.xref(spark, sf_dir))


@workload("xref_lookup", f"""{LOOKED_UP} SELECT correlation_id, map_name, lower(pair_key || '|' || source_system || '|' || source_record_id) AS lookup_key,
  linked, has_state, other_id FROM looked""")
def xref_lookup(spark, sf_dir):
    return looked_up(spark, sf_dir).select(
        "correlation_id", "map_name", "lookup_key", F.col("link").isNotNull().alias("linked"),
        F.col("link.state").isNotNull().alias("has_state"), F.col("link_target_id").alias("other_id"),
    )


@workload("echo_content", f"""{LOOKED_UP} SELECT correlation_id, map_name, has_state AND source_system = 'crm' AND
  upper(sha256('{{"k":' || k || ',"ref":"' || ref || '"}}')) = hash AS echo FROM looked""")
def echo_content(spark, sf_dir):
    return looked_up(spark, sf_dir).select("correlation_id", "map_name", echo.is_content_echo("link.state").alias("echo"))


@workload("lww_snapshot", f"""{LOOKED_UP} SELECT correlation_id, map_name, has_state AND occurred_at < lw_at AS discarded FROM looked""")
def lww_snapshot(spark, sf_dir):
    return looked_up(spark, sf_dir).select(
        "correlation_id", "map_name", lww_discards("occurred_at", "link.state.last_writer_at").alias("discarded")
    )


# --- write commands ---------------------------------------------------------------------

def m3_rows(spark, sf_dir) -> DataFrame:
    """Events through map m3, with their key."""
    m3 = a.maps(spark).filter("name = 'm3'")
    compiled = mapping.CompiledMaps.load(route.active_maps(m3), Transforms())
    rows = compiled.map_fields(route.route_events(a.sync_events(spark, sf_dir), m3))
    return targets.with_key_segment(targets.with_mode(rows, a.SYSTEMS), compiled)


M3_BODY = """'{' || CASE WHEN has_amount THEN '"amount":' || coalesce(CAST(amount AS VARCHAR), 'null') || ',' ELSE '' END
  || '"grade":"' || CASE k WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END || '",%s"region":"EMEA","tag":"Tag ' || k || '"}'"""
M3_FULL = M3_BODY % """"ref":"' || ref || '","""
M3 = f"{EV}, m3 AS (SELECT *, k = 3 AS failed, {M3_FULL} AS body FROM evd WHERE source_system = 'erp')"


@workload("write_plan", f"""{M3} SELECT correlation_id, 'dw' AS target_system, 'account' AS target_entity, operation, body AS fields,
  'ref=''' || ref || '''' AS record_id, company, 'm3:' || source_record_id || ':' || ticks AS idempotency_key FROM m3 WHERE NOT failed""")
def write_plan(spark, sf_dir):
    rows = m3_rows(spark, sf_dir).filter(F.col("map_error").isNull() & F.col("key_error").isNull())
    return rows.select(
        "correlation_id", "target_system", "target_entity", "operation", values.canonical_json("mapped").alias("fields"),
        F.col("key_segment").alias("record_id"), "company", keys.idempotency_key().alias("idempotency_key"),
    )


@workload("write_body", f"""{M3} SELECT correlation_id, {M3_BODY % ''} AS update_body,
  CASE WHEN company IS NULL THEN body ELSE replace(body, '"grade":', '"dataAreaId":"' || company || '","grade":') END AS create_body
  FROM m3 WHERE NOT failed""")
def write_body(spark, sf_dir):
    rows = m3_rows(spark, sf_dir).filter(F.col("map_error").isNull())
    bodies = rows.select("correlation_id", update_body().alias("u"), create_body().alias("c"))
    return bodies.select(
        "correlation_id", values.canonical_json("u").alias("update_body"), values.canonical_json("c").alias("create_body")
    )


@workload("key_segment_resolve", f"""{M3} SELECT correlation_id, CASE WHEN NOT failed THEN 'ref=''' || ref || '''' END AS segment,
  CASE WHEN NOT failed THEN c.c_mktsegment = 'AUTOMOBILE' ELSE FALSE END AS found
  FROM m3 JOIN customer c ON c.c_custkey = m3.user_id""")
def key_segment_resolve(spark, sf_dir):
    rows = m3_rows(spark, sf_dir).withColumn("link_target_id", F.lit(None).cast("string"))
    index = targets.target_index(a.target(spark, sf_dir), route.active_maps(a.maps(spark)), a.SYSTEMS)
    found = targets.resolve_targets(rows, index)
    return found.select("correlation_id", F.col("key_segment").alias("segment"), F.col("target_exists").alias("found"))


@workload("state_after_write", f"""{M3} SELECT correlation_id, 'dw' AS written_to, CASE WHEN operation = 'Delete' THEN ''
    ELSE CASE WHEN has_amount THEN 'amount,' ELSE '' END || 'grade,ref,region,tag' END AS written_fields,
  CASE WHEN operation = 'Delete' THEN '' ELSE upper(sha256(body)) END AS hash, epoch_us(occurred_at) AS at_us FROM m3 WHERE NOT failed""")
def state_after_write(spark, sf_dir):
    from changesync.plans.sync import state_after_write as after

    rows = m3_rows(spark, sf_dir).filter(F.col("map_error").isNull())
    rows = rows.withColumn("outcome", F.when(F.col("operation") == "Delete", F.lit("Deleted")).otherwise(F.lit("Updated")))
    state = rows.select("correlation_id", after().alias("s"))
    return state.select(
        "correlation_id", F.col("s.written_to_system").alias("written_to"),
        F.array_join("s.written_fields", ",").alias("written_fields"), F.col("s.written_payload_hash").alias("hash"),
        F.unix_micros("s.last_writer_at").alias("at_us"),
    )
