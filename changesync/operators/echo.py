"""Recognising our own writes when they come back as change events."""

from pyspark.sql import Column, DataFrame, functions as F

from changesync.functions.values import _col, project_hash


def flag_identity_echo(events: DataFrame, integration_users: DataFrame) -> DataFrame:
    """Add `identity_echo`: the change was made by one of our own accounts (`user_id`,
    ignoring case)."""
    users = integration_users.select(F.lower("user_id").alias("_user")).distinct().withColumn("_ours", F.lit(True))
    joined = events.join(users, F.lower("originating_user_id") == F.col("_user"), "left")
    return joined.withColumn("identity_echo", F.coalesce("_ours", F.lit(False))).drop("_user", "_ours")


def is_content_echo(state="state", source_system="source_system", data="data") -> Column:
    """The event comes from the system we wrote last, and what it holds in the fields we
    wrote hashes to what we wrote. Absent fields count as null."""
    state = _col(state)
    from_written = F.lower(state["written_to_system"]) == F.lower(_col(source_system))
    same = project_hash(data, state["written_fields"]) == state["written_payload_hash"]
    return F.coalesce(from_written & same, F.lit(False))
