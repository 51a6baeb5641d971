"""Progress marks per system and scope. The token is opaque here; an empty one is the start."""

from pyspark.sql import Column, DataFrame, functions as F

START = ""


def scope_of(map_name) -> Column:
    """Progress belongs to a map, not an entity: two maps on one entity advance apart."""
    return F.concat(F.lit("map:"), F.col(map_name) if isinstance(map_name, str) else map_name)


def token_of(ts) -> Column:
    """ISO 8601 round-trip text of an instant, seven fraction digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def get(marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (system, scope) with its `token`, empty where none was saved."""
    stored = marks.select(F.lower("system").alias("_s"), F.lower("scope").alias("_c"), "token", "updated_at")
    on = (F.lower("system") == F.col("_s")) & (F.lower("scope") == F.col("_c"))
    return wanted.join(stored, on, "left").drop("_s", "_c").withColumn("token", F.coalesce("token", F.lit(START)))


def save(marks: DataFrame, updates: DataFrame) -> DataFrame:
    """The table after overwriting by (system, scope), ignoring case."""
    def keyed(df, name):
        return df.select(
            F.lower("system").alias("_s"), F.lower("scope").alias("_c"),
            F.struct("system", "scope", "token", "updated_at").alias(name),
        )

    merged = keyed(marks, "old").join(keyed(updates, "new"), ["_s", "_c"], "full_outer")
    return merged.select(F.coalesce("new", "old").alias("m")).select("m.*")


def advance(events: DataFrame, by: list[str], updated_at: Column) -> DataFrame:
    """Token of each group: its latest change time. A group without events has no row, so its
    mark stays."""
    return events.groupBy(*by).agg(token_of(F.max("occurred_at")).alias("token")).withColumn("updated_at", updated_at)
