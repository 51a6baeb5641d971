"""Outcome of every routed event: echo, last-writer-wins, failure, delete or upsert.

Each link is a small state machine over its events in arrival order. Two exact ways, both in JVM
expressions:

* prefix scan — the state a row sees is a running maximum of change times plus a running
  "has a link", both associative, so links of any size split into bounded chunks;
* fold — only for links where a content echo is possible at all (events from both systems,
  or from the system written last). A chunk of at most `fold_rows` rows is folded as one array.

A link longer than a chunk is folded as a scan of state functions. What a chunk does to the state
that enters it depends on that state only by whether the first row that can act takes it for an
echo; the state met must then have been written in one of the link's field sets and hash to what
the row holds there. So a chunk is a function of one class of states per field set and one for
all others. The functions of a link are applied one after the other, which gives the state that enters every
chunk, and then all chunks are folded at once: a fixed number of steps, however long the link is
and whatever it holds. That a late row is discarded is assumed in the functions and checked after:
chunks entered by another state than was assumed are folded again until none is left.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from changesync.functions.values import payload_hash, project_hash
from changesync.operators import prefix
from changesync.operators.targets import BY_KEY
from changesync.schema import CREATED, DELETED, DISCARDED, ECHO, FAILED, UPDATED
from changesync.storage import Scratch

ORDER = ["arrival_seq", "map_name"]
CHUNK = ["link_key", "bucket"]
PIECE = [*CHUNK, "piece"]
UPSERTED = "Upserted"

# Rows of one link folded as one array.
FOLD_ROWS = 4_096

STATE = "STRUCT<has: BOOLEAN, w: STRING, fields: ARRAY<STRING>, hash: STRING, at: BIGINT, row: BIGINT>"


def micros(ts) -> Column:
    return F.unix_micros(ts)


def lww_discards(occurred_at, last_writer_at) -> Column:
    """Strictly older than the last winner loses; ties pass; no state, no conflict."""
    return F.coalesce(F.col(occurred_at) < F.col(last_writer_at), F.lit(False))


def _facts(rows: DataFrame, content_echo: bool, at: str) -> DataFrame:
    """What decides about a row, apart from the state it meets. `at` names the key of its body."""
    sound = ~F.col("identity_echo") & F.col("system_error").isNull() & F.col("map_error").isNull()
    gone = F.col("operation") == "Delete"
    state = F.col("link.state")
    body = []
    if content_echo:
        body = [
            F.col(at).alias("_at"),
            F.when(F.col("link").isNotNull(), F.struct(
                F.lit(True).alias("has"), F.lower(state["written_to_system"]).alias("w"), state["written_fields"].alias("fields"),
                state["written_payload_hash"].alias("hash"), micros(state["last_writer_at"]).alias("at"), F.lit(None).cast("bigint").alias("row"),
            ).cast(STATE)).alias("start"),
        ]
    return rows.select(
        "_row", *CHUNK, *ORDER, F.lower("source_system").alias("source"), F.lower("target_system").alias("target"), F.col("identity_echo").alias("ours"),
        sound.alias("sound"), gone.alias("gone"), F.coalesce("system_error", "map_error").alias("broken"), "key_error",
        (sound & F.col("key_error").isNull() & ~gone).alias("links"), F.col("link").isNotNull().alias("link0"),
        F.lower(state["written_to_system"]).alias("w0"), micros(state["last_writer_at"]).alias("at0"), micros("occurred_at").alias("at"), *body,
    )


def _chunk_summaries(rows: DataFrame) -> DataFrame:
    """Per (link, bucket): the state carried in, and whether the link needs the fold."""
    source = F.when(~F.col("ours"), F.col("source"))
    summary = rows.groupBy(*CHUNK).agg(
        F.max(F.col("links").cast("int")).alias("any_link"),
        F.max(F.when(F.col("sound"), F.col("at"))).alias("max_linked"),
        F.max(F.when(F.col("links") | (F.col("sound") & F.col("_h")), F.col("at"))).alias("max_unlinked"),
        F.max(F.col("link0").cast("int")).alias("link0"),
        F.max("at0").alias("at0"),
        F.min(source).alias("min_source"),
        F.max(source).alias("max_source"),
        F.max((source == F.col("w0")).cast("int")).alias("from_written"),
        F.max((source == F.col("target")).cast("int")).alias("inside"),
    )
    link = Window.partitionBy("link_key")
    along = link.orderBy("bucket").rowsBetween(*prefix.BEFORE)
    carried = summary.withColumns({
        "carry_link": (F.greatest(F.max("link0").over(link), F.coalesce(F.max("any_link").over(along), F.lit(0))) == 1),
        "at0": F.max("at0").over(link),
        "contested": (F.min("min_source").over(link) != F.max("max_source").over(link))
        | (F.max("from_written").over(link) == 1) | (F.max("inside").over(link) == 1),
    })
    reached = F.when(F.col("carry_link"), F.col("max_linked")).otherwise(F.col("max_unlinked"))
    carried = carried.withColumn("_reached", reached)
    return carried.select(
        *CHUNK, "carry_link", F.coalesce("contested", F.lit(False)).alias("contested"),
        F.greatest("at0", F.max("_reached").over(along)).alias("carry_at"),
    )


def verdicts(
    rows: DataFrame, scratch: Scratch, fold_rows: int = FOLD_ROWS, content_echo: bool = True, bodies: DataFrame | None = None,
    slice_rows: int = prefix.SLICE_ROWS,
) -> DataFrame:
    """(_row, verdict, has_link, error) of every row: the verdict is an outcome or `Upserted`, has_link says
    whether the row found a link, error why it failed.

    Needs: _row (distinct), link_key, bucket, arrival_seq, map_name, source/target_system, operation,
    occurred_at, identity_echo, system_error, map_error, key_error, link, and data, mapped, or _at, a key of `bodies`
    (_at, data, mapped) that several rows may share. Bodies are read for the rows of contested links only, those of
    `slice_rows` rows at a time.
    """
    arrival = Window.partitionBy(*CHUNK).orderBy(*ORDER)
    inside = arrival.rowsBetween(*prefix.BEFORE)
    flagged = _facts(rows, content_echo, "_row" if bodies is None else "_at").withColumn("_h", F.coalesce(F.max("links").over(inside), F.lit(False)))
    # What was reached inside the chunk, if the link existed at its start and if it did not.
    chunked = scratch.keep(flagged.withColumns({
        "_linked_at": F.max(F.when(F.col("sound"), F.col("at"))).over(inside),
        "_unlinked_at": F.max(F.when(F.col("links") | (F.col("sound") & F.col("_h")), F.col("at"))).over(inside),
        "piece": F.floor((F.row_number().over(arrival) - 1) / fold_rows).cast("bigint"),
    }), "chunked")
    summaries = scratch.keep(_chunk_summaries(chunked), "summaries")
    reached = F.when(F.col("carry_link"), F.col("_linked_at")).otherwise(F.col("_unlinked_at"))
    scanned = chunked.join(summaries, CHUNK, "inner").withColumns({
        "has_link": F.col("carry_link") | F.col("_h"), "seen_at": F.greatest("carry_at", reached),
    })
    result = ["_row", "verdict", "has_link", "broken", "key_error"]
    quick = scanned if not content_echo else scanned.filter(~F.col("contested"))
    out = quick.withColumn("verdict", _verdict(quick, F.lit(False), F.col("seen_at"), F.col("has_link"))).select(*result)
    if content_echo and summaries.filter("contested").limit(1).count():
        told = rows.withColumn("_at", F.col("_row")) if bodies is None else bodies
        slices = _with_bodies(scanned.filter("contested"), told.select("_at", "data", "mapped"), scratch, slice_rows)
        out = out.unionByName(_fold(reduce(DataFrame.unionByName, slices), scratch).select(*result))
        scratch.free(*slices)
    reason = F.coalesce("broken", F.when(~F.col("has_link"), F.col("key_error")))
    return out.select("_row", "verdict", "has_link", F.when(F.col("verdict") == FAILED, reason).alias("error"))


def _with_bodies(rows: DataFrame, bodies: DataFrame, scratch: Scratch, slice_rows: int) -> list[DataFrame]:
    """`rows` with their bodies, written slice by slice if there is more than one."""
    parts = [rows.filter(s).join(bodies.filter(s), "_at") for s in prefix.slices(bodies, "_at", slice_rows)]
    return parts if len(parts) == 1 else [scratch.keep(p, "contested") for p in parts]


def settle(rows: DataFrame, fold_rows: int = FOLD_ROWS, content_echo: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """`rows` with `verdict`, `has_link` and `error` (see `verdicts`), which need no `_row` here."""
    scratch = scratch or Scratch(rows.sparkSession)
    numbered = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    return numbered.join(verdicts(numbered, scratch, fold_rows, content_echo), "_row").drop("_row")


def _verdict(item, echo: Column, state_at: Column, has_link: Column) -> Column:
    """`item` gives the facts of a row by name: a table, or an element of an array."""
    return (
        F.when(item["ours"] | echo, F.lit(ECHO))
        .when(F.coalesce(item["at"] < state_at, F.lit(False)), F.lit(DISCARDED))
        .when(~item["sound"] | (~has_link & item["key_error"].isNotNull()), F.lit(FAILED))
        .when(item["gone"], F.lit(DELETED))
        .otherwise(F.lit(UPSERTED))
    )


# --- fold -----------------------------------------------------------------------------


def _with(value: Column, use) -> Column:
    """`use` of a value that is computed once: lambdas share nothing else."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _state(has, w, fields, hash_, at, row) -> Column:
    return F.struct(
        has.alias("has"), w.alias("w"), fields.alias("fields"), hash_.alias("hash"), at.cast("bigint").alias("at"), row.cast("bigint").alias("row"),
    ).cast(STATE)


def _met(state: Column, item: Column) -> Column:
    """The verdict on a row that meets a state."""
    same = project_hash(F.map_from_entries(item["data"]), state["fields"]) == state["hash"]
    echo = F.when((state["hash"] != "") & (state["w"] == item["source"]), same)
    return _verdict(item, F.coalesce(echo, F.lit(False)), state["at"], state["has"])


def _after(state: Column, item: Column, verdict: Column) -> Column:
    wrote = (verdict == UPSERTED) | ((verdict == DELETED) & state["has"])
    return F.when(wrote, _state(F.lit(True), item["target"], item["fields"], item["hash"], item["at"], item["_row"])).otherwise(state)


def _final(items: str, start: Column) -> Column:
    """The state that `items` leave."""
    return F.aggregate(items, start, lambda s, i: _with(_met(s, i), lambda v: _after(s, i, v)))


def _walk(items: str, start: Column) -> Column:
    """Every item's row and verdict, and whether it found a link."""
    done = F.expr("CAST(array() AS ARRAY<STRUCT<_row: BIGINT, verdict: STRING, has_link: BOOLEAN, broken: STRING, key_error: STRING>>)")

    def step(a, i):
        return _with(_met(a["s"], i), lambda v: F.struct(
            _after(a["s"], i, v).alias("s"),
            F.concat(a["done"], F.array(F.struct(
                i["_row"].alias("_row"), v.alias("verdict"), a["s"]["has"].alias("has_link"), i["broken"].alias("broken"), i["key_error"].alias("key_error"),
            ))).alias("done"),
        ))

    return F.aggregate(items, F.struct(start.alias("s"), done.alias("done")), step, lambda a: a["done"])


_ITEM = [*ORDER, "_row", "source", "target", "ours", "sound", "gone", "broken", "key_error", "links", "at", "seen_at", "has_link", "data"]


def _written(item) -> list[Column]:
    """The fields an item writes, and their hash: made once the items are gathered, since hashes do not compress."""
    fields = F.when(item["gone"], F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.array_sort(F.transform(item["mapped"], lambda e: e["key"])))
    hash_ = F.when(item["gone"], F.lit("")).otherwise(payload_hash(F.map_from_entries(item["mapped"])))
    return [fields.alias("fields"), hash_.alias("hash")]


def _fold(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(_row, verdict, has_link, broken, key_error) of the rows of contested links."""
    none = F.expr(f"CAST(NULL AS {STATE})")
    told = rows.withColumns({"data": F.when(~F.col("ours"), F.map_entries("data")), "mapped": F.map_entries("mapped")})
    gathered = told.groupBy(*PIECE).agg(
        F.array_sort(F.collect_list(F.struct(*_ITEM, "mapped"))).alias("items"), F.first("start", ignorenulls=True).alias("start"),
    )
    pieces = scratch.keep(gathered.withColumn(
        "items", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in _ITEM], *_written(i)))
    ), "pieces")
    per_link = Window.partitionBy("link_key")
    starts = pieces.groupBy("link_key").agg(F.first("start", ignorenulls=True).alias("start"), F.count("*").alias("parts"))
    fresh = _state(F.lit(False), none["w"], none["fields"], none["hash"], none["at"], none["row"])
    starts = scratch.keep(starts.select("link_key", F.coalesce("start", fresh).alias("start"), "parts"), "starts")
    whole = pieces.drop("start").join(starts, "link_key")
    folded = whole.filter("parts = 1").select(F.explode(_walk("items", F.col("start"))).alias("r")).select("r.*")
    if not starts.filter("parts > 1").limit(1).count():
        return folded
    long = scratch.keep(whole.filter("parts > 1"), "long")  # few, and read several times
    entered = _entered(long.select(*PIECE, "items", "start"), scratch)
    split = long.select(*PIECE, "items").join(entered, PIECE).select(F.explode(_walk("items", F.col("entering"))).alias("r"))
    return folded.unionByName(split.select("r.*"))


def _functions(long: DataFrame) -> DataFrame:
    """Per piece its function: what it makes of a state that its head, the first row that can act,
    takes for an echo, one entry per field set the link was written in, and of any other (an entry
    without hash). An entry whose `out` has no row passes the state on."""
    writes = long.select("link_key", F.explode("items").alias("i")).filter("i.sound AND NOT i.gone")
    sets = writes.select("link_key", F.struct(F.col("i.target").alias("w"), F.col("i.fields").alias("fields")).alias("s"))
    known = long.select("link_key", F.struct("start.w", "start.fields").alias("s")).filter("s.fields IS NOT NULL")
    shapes = sets.unionByName(known).groupBy("link_key").agg(F.collect_set("s").alias("shapes"))
    can_act = F.filter(
        "items", lambda i: i["sound"] & (i["has_link"] | i["links"]) & F.coalesce(i["at"] >= F.get("items", F.lit(0))["seen_at"], F.lit(True))
    )
    ready = long.join(shapes, "link_key", "left").withColumns({"head": F.get(can_act, F.lit(0)), "seen": F.get("items", F.lit(0))["seen_at"]})
    none = F.expr(f"CAST(NULL AS {STATE})")
    other = _state(F.get("items", F.lit(0))["has_link"], none["w"], none["fields"], none["hash"], F.col("seen"), none["row"])
    mine = F.filter(F.coalesce("shapes", F.expr("array()")), lambda s: s["w"] == F.col("head.source"))
    echoed = F.transform(mine, lambda s: _state(
        F.lit(True), s["w"], s["fields"], project_hash(F.map_from_entries(F.col("head.data")), s["fields"]), F.col("seen"), none["row"],
    ))
    classes = ready.select(*PIECE, "items", F.concat(F.array(other), F.coalesce(echoed, F.expr(f"CAST(array() AS ARRAY<{STATE}>)"))).alias("classes"))
    return classes.select(*PIECE, F.transform("classes", lambda c: F.struct(
        c["w"].alias("w"), c["fields"].alias("fields"), c["hash"].alias("hash"), _final("items", c).alias("out"),
    )).alias("does"))


def _entered(long: DataFrame, scratch: Scratch) -> DataFrame:
    """(link_key, bucket, piece, entering): the state that enters each piece of the long links."""
    kind = f"ARRAY<STRUCT<bucket: BIGINT, piece: BIGINT, entering: {STATE}>>"
    does = scratch.keep(_functions(long), "functions")
    start = long.groupBy("link_key").agg(F.first("start").alias("start"))
    lined = does.groupBy("link_key").agg(F.array_sort(F.collect_list(F.struct("bucket", "piece", "does"))).alias("line")).join(start, "link_key")

    def apply(a, p):
        s = a["s"]
        known = F.filter(p["does"], lambda d: (d["hash"] == s["hash"]) & (d["w"] == s["w"]) & (d["fields"] == s["fields"]))
        out = F.coalesce(F.get(known, F.lit(0)), F.get(p["does"], F.lit(0)))["out"]
        return _with(out, lambda o: F.struct(
            F.when(o["row"].isNull(), s).otherwise(o).alias("s"),
            F.concat(a["in"], F.array(F.struct(p["bucket"].alias("bucket"), p["piece"].alias("piece"), s.alias("entering")))).alias("in"),
        ))

    walked = F.aggregate("line", F.struct(F.col("start").alias("s"), F.expr(f"CAST(array() AS {kind})").alias("in")), apply, lambda a: a["in"])
    states = lined.select("link_key", F.explode(walked).alias("p")).select("link_key", "p.*").withColumns({
        "left": F.lit(None).cast(STATE), "stale": F.lit(True),
    })
    states = scratch.keep(states, "entering")
    along = Window.partitionBy("link_key").orderBy("bucket", "piece")
    pieces = long.select(*PIECE, "items", "start")
    while True:
        todo = states.filter("stale").select(*PIECE, "entering")
        done = pieces.drop("start").join(todo, PIECE).select(*PIECE, _final("items", F.col("entering")).alias("made"))
        merged = states.join(done, PIECE, "left").join(start, "link_key").withColumn("left", F.coalesce("made", "left"))
        true = F.coalesce(F.lag("left").over(along), F.col("start"))
        merged = merged.withColumn("true", true).select(
            *PIECE, F.col("true").alias("entering"), "left", (~F.col("true").eqNullSafe(F.col("entering"))).alias("stale"),
        )
        states = scratch.keep(merged, "entering")
        if not states.filter("stale").limit(1).count():
            return states.select(*PIECE, "entering")


# --- created or updated ---------------------------------------------------------------


def outcomes(settled: DataFrame) -> DataFrame:
    """Add `outcome`. Whether a write creates depends on the target record, which several links
    may share: a by_id target reports Updated for every known id, and Created for the first
    write to an unknown one; a by_key target reports Created whenever the record is not there,
    so also after a delete."""
    by_key = F.col("upsert_mode") == BY_KEY
    upserted = F.col("verdict") == UPSERTED
    record = ["target_system", "target_entity", "_record"]
    rows = settled.withColumn("_record", F.coalesce(F.lower("counterpart"), "link_key"))

    def named(rows, present):
        written = F.when(present, F.lit(UPDATED)).otherwise(F.lit(CREATED))
        return rows.withColumn("outcome", F.when(upserted, written).otherwise(F.col("verdict")))

    wrote = F.col("verdict").isin(UPSERTED, DELETED)
    last = F.struct(*ORDER, upserted.alias("present"))
    scanned = prefix.running_before(rows.filter(by_key), record, ORDER, {"_last": ("max", F.when(wrote, last))})
    keyed = named(scanned, F.coalesce("_last.present", "target_exists")).drop("_last")

    by_id = rows.filter(~by_key)
    unknown = upserted & ~F.col("has_link") & ~F.col("target_exists")
    born = by_id.filter(unknown).groupBy(*record).agg(F.min(F.struct(*ORDER)).alias("_born"))
    by_id = by_id.join(born, record, "left")
    by_id = named(by_id, ~unknown | (F.col("_born") < F.struct(*ORDER))).drop("_born")
    return by_id.unionByName(keyed).drop("_record")
