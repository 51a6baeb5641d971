"""The cross-reference: which two records are linked, and the state of their last sync.

Stored as two mirrored rows per link, one per side, so an event finds its link by one key.
"""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.keys import lookup_key
from changesync.functions.values import _col

LINK_COLUMNS = ("pair_key", "system_a", "record_id_a", "system_b", "record_id_b", "state")


def is_tombstone(state="state") -> Column:
    """State left by a delete: nothing written and no hash."""
    state = _col(state)
    return F.coalesce((F.size(state["written_fields"]) == 0) & (state["written_payload_hash"] == ""), F.lit(False))


def record_id_in(system, link: str = "") -> Column:
    """Record id of the link on the side of `system` (ignoring case), or null."""
    wanted = F.lower(_col(system))
    return F.when(wanted == F.lower(f"{link}system_a"), F.col(f"{link}record_id_a")).when(
        wanted == F.lower(f"{link}system_b"), F.col(f"{link}record_id_b")
    )


def mirrors(links: DataFrame) -> DataFrame:
    """One row per side of every link, keyed by `lookup_key`."""
    keys = F.array(
        lookup_key("pair_key", "system_a", "record_id_a"), lookup_key("pair_key", "system_b", "record_id_b")
    )
    return links.select(F.explode(keys).alias("lookup_key"), *[c for c in links.columns if c != "lookup_key"])


def lookup(events: DataFrame, xref: DataFrame) -> DataFrame:
    """Left join of routed events to their link. Adds `lookup_key`, `link` (null when the
    record was never synced) and `link_target_id`.

    The link side is unique per key; a record with very many events skews only the event
    side, which adaptive skew handling splits.
    """
    link = xref.select(
        F.col("lookup_key").alias("_key"),
        F.struct(*[F.col(c) for c in LINK_COLUMNS if c != "pair_key"], "version").alias("link"),
    )
    keyed = events.withColumn("lookup_key", lookup_key("pair_key", "source_system", "source_record_id"))
    joined = keyed.join(link, F.col("lookup_key") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("link_target_id", record_id_in("target_system", "link."))


def save(xref: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """The link table after saving `links`: both mirrors overwritten, the row with the
    highest `order` winning where several links share a side, and versions counted up."""
    rows = mirrors(links)
    payload = F.struct(*LINK_COLUMNS)
    latest = rows.groupBy("lookup_key").agg(F.max_by(payload, order).alias("new"), F.count("*").alias("saves"))
    old = xref.select("lookup_key", F.struct(*LINK_COLUMNS).alias("old"), "version")
    merged = old.join(latest, "lookup_key", "full_outer")
    return merged.select(
        "lookup_key",
        F.coalesce("new", "old").alias("link"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("saves", F.lit(0))).cast("bigint").alias("version"),
    ).select("lookup_key", "link.*", "version")


def conditional_save(xref: DataFrame, saves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optimistic save. `saves` are links with `read_key` (the mirror that was read) and
    `read_version`. Returns (accepted, rejected): a stale version is turned away whole, so
    neither mirror changes; a link never read is accepted."""
    current = xref.select(F.col("lookup_key").alias("_key"), F.col("version").alias("current_version"))
    joined = saves.join(current, F.col("read_key") == F.col("_key"), "left").drop("_key")
    fresh = F.col("read_key").isNull() | F.coalesce(F.col("read_version") == F.col("current_version"), F.lit(False))
    return joined.filter(fresh).drop("current_version"), joined.filter(~fresh)


def links_of_pair(xref: DataFrame, pair=None) -> DataFrame:
    """Every link of a pair once: mirrors and repeats collapse on side A, ignoring case."""
    scoped = xref if pair is None else xref.filter(F.lower("pair_key") == F.lower(F.lit(pair)))
    side_a = F.lower(F.concat_ws("|", "system_a", "record_id_a"))
    return (
        scoped.groupBy(F.lower("pair_key").alias("_pair"), side_a.alias("_side_a"))
        .agg(F.max_by(F.struct(*LINK_COLUMNS), F.struct("version", "lookup_key")).alias("link"))
        .select("link.*")
    )
