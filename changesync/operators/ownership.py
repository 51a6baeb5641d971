"""Which link a row meets, and which record it then writes.

A link is stored under both of its sides (pair, system, record), and a save overwrites what either
side had. So a side belongs to the link whose save touched it last, and only accepted writes save:
a discarded or failed event moves nothing. A side without a link creates one with the first row
that can, unless another side's write gave it one before.

Most sides can only ever meet one link; their rows follow from a look-up. Where a side may meet
several, the rows of all sides that those links have go round: verdicts from the assumed links, saves
from the verdicts, owners from the saves, until no row changes its link. A row depends on earlier
ones only, so each round settles at least the first wrong row of every side, and what no longer
changes is what one event after the other would have met, wherever batches are cut.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from changesync.operators import prefix
from changesync.operators.resolve import ORDER, UPSERTED
from changesync.operators.targets import BY_KEY, key_probe
from changesync.schema import DELETED
from changesync.storage import Scratch


def _side(system, record_id) -> Column:
    return F.lower(F.concat_ws("|", "pair_key", system, record_id))


def _between(a, b) -> Column:
    """The name of the link between two sides, whichever created it."""
    return F.concat_ws("~", F.least(a, b), F.greatest(a, b))


def _sided(rows: DataFrame) -> DataFrame:
    sound = ~F.col("identity_echo") & F.col("system_error").isNull() & F.col("map_error").isNull() & F.col("key_error").isNull()
    stored = _between(_side("link.system_a", "link.record_id_a"), _side("link.system_b", "link.record_id_b"))
    out = rows.withColumns({
        "side": _side("source_system", "source_record_id"),
        "other": F.when(F.col("resolved_id").isNotNull(), _side("target_system", "resolved_id")),
        "stored": F.when(F.col("link").isNotNull(), stored),
    })
    # Such a row creates a link if it finds none.
    return out.withColumn("claims", F.col("link").isNull() & F.col("other").isNotNull() & sound & (F.col("operation") != "Delete"))


def _ends(key, one, one_id, two, two_id, at) -> Column:
    """A link as seen from both of its sides: `id` is the record on the other one."""
    ends = [F.struct(s.alias("side"), key.alias("key"), i.alias("id"), at.alias("at")) for s, i in ((one, one_id), (two, two_id))]
    return F.explode(F.array(*ends)).alias("e")


def _incident(sided: DataFrame) -> DataFrame:
    """(side, key, id): every link that a side may ever meet."""
    order = F.struct(*[F.col(c) for c in ORDER])
    first = sided.filter("claims").groupBy("side").agg(
        F.min_by(F.struct("other", "resolved_id", "source_record_id"), order).alias("c"), F.min("arrival_seq").alias("at")
    )
    made = first.select(_ends(
        _between("side", "c.other"), F.col("side"), F.col("c.resolved_id"), F.col("c.other"), F.col("c.source_record_id"), F.col("at")
    ))
    kept = sided.filter(F.col("stored").isNotNull()).select(_ends(
        F.col("stored"), F.col("side"), F.col("link_target_id"), F.col("other"), F.col("source_record_id"), F.lit(None).cast("bigint")
    ))
    return made.unionByName(kept).select("e.*").filter(F.col("side").isNotNull()).groupBy("side", "key").agg(
        F.min_by("id", F.struct("at", "id")).alias("id")
    )


def with_links(rows: DataFrame, index: DataFrame, verdicts: Callable[[DataFrame, Scratch], DataFrame], scratch: Scratch) -> DataFrame:
    """`rows` with `link_key`, `counterpart`, and `link` and `target_exists` of the link that is met.

    `rows` have _row, bucket, and the columns of a resolved row; `index` is the target index;
    `verdicts` settles rows that have their `link_key`. Rows without a link are grouped by their side.
    """
    sided = _sided(rows)
    incident = scratch.keep(_incident(sided), "incident")
    several = incident.groupBy("side").agg(F.count("*").alias("n")).filter("n > 1").select("side")
    several = scratch.keep(several.join(sided.select("side").distinct(), "side", "left_semi"), "several")
    plain, shared = sided, None
    if several.limit(1).count():
        keys = incident.join(several, "side", "left_semi").select("key").distinct()
        sides = scratch.keep(incident.join(keys, "key", "left_semi").select("side").distinct(), "sides")
        plain = sided.join(sides, "side", "left_anti")
        shared = _shared(scratch.keep(sided.join(sides, "side", "left_semi"), "shared"), incident, index, verdicts, scratch)
    bound = plain.filter(F.col("link").isNotNull()).withColumns({"link_key": F.col("stored"), "counterpart": F.col("link_target_id")})
    free = plain.filter(F.col("link").isNull()).join(incident, "side", "left").withColumns({
        "link_key": F.coalesce("key", "side"), "counterpart": F.coalesce("id", "resolved_id"),
    })
    columns = [*rows.columns, "link_key", "counterpart"]
    out = bound.select(*columns).unionByName(free.select(*columns))
    return out if shared is None else out.unionByName(shared.select(*columns))


def _shared(rows: DataFrame, incident: DataFrame, index: DataFrame, verdicts, scratch: Scratch) -> DataFrame:
    """The rows of sides that may meet several links, with the link each one meets."""
    stored = rows.filter(F.col("stored").isNotNull()).groupBy(F.col("stored").alias("link_key")).agg(F.first("link").alias("link"))
    guess = incident.groupBy("side").agg(F.min(F.struct("key", "id")).alias("g"))
    own = F.when(F.col("claims"), _between("side", "other"))
    met = assumed = scratch.keep(rows.join(guess, "side", "left").select(
        "_row", F.coalesce("stored", own, "g.key", "side").alias("link_key"),
        F.coalesce("link_target_id", F.when(F.col("claims"), F.col("resolved_id")), "g.id", "resolved_id").alias("counterpart"),
    ), "met")
    while True:
        assigned = rows.drop("link").join(met, "_row").join(stored, "link_key", "left")
        step = Scratch(rows.sparkSession, scratch.codec)
        found = verdicts(assigned, step).select("_row", "verdict", F.col("has_link").alias("found_link"))
        saved = (F.col("verdict") == UPSERTED) | ((F.col("verdict") == DELETED) & F.col("found_link"))
        settled = assigned.join(found, "_row")
        far = _side("target_system", "counterpart")

        def touch(record):
            return F.when(saved, F.struct(*ORDER, F.col("link_key").alias("key"), F.col(record).alias("id")))

        near = settled.select("_row", "side", *ORDER, "bucket", touch("counterpart").alias("touch"))
        across = settled.filter(saved & (far != F.col("side"))).select(
            F.lit(None).cast("bigint").alias("_row"), far.alias("side"), *ORDER, "bucket", touch("source_record_id").alias("touch")
        )
        seen = prefix.running_before(near.unionByName(across), ["side"], ORDER, {"last": ("max", F.col("touch"))})
        seen = seen.filter(F.col("_row").isNotNull()).select("_row", "last")
        after = scratch.keep(assigned.join(seen, "_row").select(
            "_row", F.coalesce("last.key", "stored", own, "side").alias("new_key"), F.coalesce("last.id", "link_target_id", "resolved_id").alias("new_id"),
            (~F.col("link_key").eqNullSafe(F.coalesce("last.key", "stored", own, "side"))).alias("moved"),
            "link_key", "counterpart",
        ), "met")
        step.delete()
        scratch.free(assumed)
        assumed = after
        met = after.select("_row", F.col("new_key").alias("link_key"), F.col("new_id").alias("counterpart"))
        if not after.filter("moved OR NOT counterpart <=> new_id").limit(1).count():
            break
    out = rows.drop("link").join(met, "_row").join(stored, "link_key", "left")
    # A record that a key addresses is there if it is, whichever link led to it.
    elsewhere = (F.col("upsert_mode") == BY_KEY) & F.coalesce(F.col("counterpart") != F.col("resolved_id"), F.lit(False))
    probe = F.when(elsewhere, key_probe("target_system", "target_entity", "counterpart")).otherwise(F.concat_ws("|", F.lit("-"), F.col("_row").cast("string")))
    out = out.withColumn("probe_key", probe).join(index.select("probe_key", "matches"), "probe_key", "left")
    return out.withColumn("target_exists", F.when(elsewhere, F.col("matches").isNotNull()).otherwise(F.col("target_exists")))
