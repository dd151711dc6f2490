"""Custom properties: JSON object text, its typed values, and text again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def custom_map(text: Column) -> Column:
    """JSON object text to map<string,variant>; anything else gives null."""
    return F.from_json(text, "map<string,variant>")


def json_kind(value: Column) -> Column:
    """string, number, boolean, object, array or null of a VARIANT value."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.isNull() | (schema == "VOID"), F.lit("null"))
        .when(schema == "STRING", F.lit("string"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("number"))
    )


def is_json_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def json_members(text: Column) -> Column:
    """array<struct<key,value,is_string>> of a JSON object in its order.

    Strings come without quotes, everything else as the text that was sent (2.0 stays
    2.0), null as null.
    """
    sent = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.zip_with(
        sent,
        F.map_values(custom_map(text)),
        lambda m, v: F.struct(
            m["key"].alias("key"),
            m["value"].alias("value"),
            F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)).alias("is_string"),
        ),
    )


def json_string(value: Column) -> Column:
    """A quoted and escaped JSON string."""
    listed = F.to_json(F.array(value))
    escaped = F.substr(listed, F.lit(2), F.length(listed) - 2)
    # most strings need no escapes, and quoting those is much cheaper
    return F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def json_object(members: Column, value: Callable[[Column], Column]) -> Column:
    """JSON object text from members; ``value`` gives the JSON text of one of them."""
    parts = F.transform(members, lambda m: F.concat(json_string(m["key"]), F.lit(":"), value(m)))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
