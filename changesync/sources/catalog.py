"""Catalogs: entities, fields, companies and option values, from metadata documents."""

from pyspark.sql import DataFrame, functions as F

from changesync.functions.text import type_tail

# Metadata documents as each kind of system publishes them.
CRM_ENTITY = (
    "LogicalName STRING, PrimaryIdAttribute STRING, "
    "Attributes ARRAY<STRUCT<LogicalName: STRING, AttributeType: STRING, AttributeOf: STRING>>"
)
ERP_ENTITY = "EntitySetName STRING, Properties ARRAY<STRUCT<Name: STRING, TypeName: STRING, IsKey: BOOLEAN>>"
_OPTIONS = "ARRAY<STRUCT<Value: INT, Label: STRUCT<UserLocalizedLabel: STRUCT<Label: STRING>>>>"
CRM_OPTIONS = f"LogicalName STRING, OptionSet STRUCT<Options: {_OPTIONS}>, GlobalOptionSet STRUCT<Options: {_OPTIONS}>"
ERP_ENUM = "Name STRING, Members ARRAY<STRUCT<Name: STRING>>"


def read_documents(df: DataFrame, schema: str, column: str = "document") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("d")).select("d.*")


def crm_fields(entities: DataFrame) -> DataFrame:
    """Mappable fields: secondary attributes (those of another attribute) are left out."""
    primary = F.filter("Attributes", lambda a: a["AttributeOf"].isNull())
    return entities.select("LogicalName", "PrimaryIdAttribute", F.explode(primary).alias("a")).select(
        F.col("LogicalName").alias("entity_name"),
        F.col("a.LogicalName").alias("field_name"),
        F.coalesce("a.AttributeType", F.lit("Unknown")).alias("field_type"),
        (F.col("a.LogicalName") == F.col("PrimaryIdAttribute")).alias("is_key"),
    )


def erp_fields(entities: DataFrame) -> DataFrame:
    """Fields with the short name of their type; keys may be composite."""
    return entities.select("EntitySetName", F.explode("Properties").alias("p")).select(
        F.col("EntitySetName").alias("entity_name"),
        F.col("p.Name").alias("field_name"),
        type_tail(F.coalesce("p.TypeName", F.lit("Unknown"))).alias("field_type"),
        F.coalesce("p.IsKey", F.lit(False)).alias("is_key"),
    )


def _distinct_ignoring_case(names: DataFrame, column: str) -> DataFrame:
    spelled = names.filter(F.length(column) > 0)
    return spelled.groupBy(F.lower(column).alias("_fold")).agg(F.min(column).alias(column)).select(column)


def entities(definitions: DataFrame, name: str, listed: str) -> DataFrame:
    """Names of the entities whose flag `listed` is set: no blanks, one spelling each, in
    ordinal order."""
    return _distinct_ignoring_case(definitions.filter(F.col(listed)), name).orderBy(name)


def companies(legal_entities: DataFrame, column: str) -> DataFrame:
    return legal_entities.filter(F.length(column) > 0).select(column).distinct().orderBy(column)


def companies_union(*lists: DataFrame) -> DataFrame:
    """Companies of all systems (column `company`), one spelling each, ignoring case."""
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    return _distinct_ignoring_case(union, "company").orderBy(F.upper("company"))


def crm_options(sets: DataFrame) -> DataFrame:
    """Option value → label: the local set when it has options, else the global one; a value
    without a label labels itself; the last of equal values wins."""
    local = F.col("OptionSet.Options")
    chosen = F.when(F.coalesce(F.size(local), F.lit(0)) > 0, local).otherwise(F.col("GlobalOptionSet.Options"))
    exploded = sets.select(F.col("LogicalName").alias("field_name"), F.posexplode(chosen).alias("pos", "o"))
    value = F.col("o.Value").cast("string")
    return (
        exploded.select("field_name", "pos", value.alias("value"), F.coalesce("o.Label.UserLocalizedLabel.Label", value).alias("label"))
        .groupBy("field_name", "value").agg(F.max_by("label", "pos").alias("label"))
    )


def erp_options(fields: DataFrame, enums: DataFrame) -> DataFrame:
    """Enum members by field: `fields` has entity_name, field_name, type_name; primitives
    (`Edm.…`) and unknown enums give nothing. Members label themselves."""
    typed = fields.filter(~F.startswith("type_name", F.lit("Edm."))).withColumn("_enum", type_tail("type_name"))
    members = enums.select(F.col("Name").alias("_enum"), F.explode("Members.Name").alias("value")).filter(F.length("value") > 0)
    return typed.join(members.distinct(), "_enum").select("entity_name", "field_name", "value", F.col("value").alias("label"))
