from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.variants import is_json_null, json_kind

PASS = "PASS"
VIOLATION_MONITOR = "VIOLATION_MONITOR"
VIOLATION_ENFORCE = "VIOLATION_ENFORCE"


def type_matches(declared: Column, value: Column) -> Column:
    """Does a VARIANT value fit a declared type name? Unknown names accept anything."""
    kind = json_kind(value)
    number = F.try_variant_get(value, "$", "double")
    wanted = F.lower(declared)
    return (
        F.when(wanted.isNull(), F.lit(True))
        .when(wanted.isin("string", "boolean", "number", "object", "array"), kind == wanted)
        .when(wanted == "integer", (kind == "number") & F.coalesce(number % 1 == 0, F.lit(False)))
        .otherwise(F.lit(True))
    )


def contract_violations(event_type: Column, custom: Column, contract: Column) -> Column:
    """List of violations of one event.

    ``contract`` is map<event type, struct<fields>> of the event's app, null when
    the app has published none; ``custom`` is map<string,variant> or null.
    """
    none = F.array().cast("array<string>")
    fields = contract[event_type]["fields"]

    def check(field: Column) -> Column:
        value = custom[field["name"]]
        name = field["name"]
        return (
            F.when(
                is_json_null(value),
                F.when(field["required"], F.concat(F.lit("missing required field: "), name)),
            )
            .when(
                ~type_matches(field["type"], value),
                F.concat(
                    F.lit("field '"), name, F.lit("' expected "), field["type"], F.lit(" but got "), json_kind(value)
                ),
            )
        )

    return (
        F.when(contract.isNull(), none)
        .when(
            ~F.map_contains_key(contract, event_type),
            F.array(F.concat(F.lit("unknown event type (schema drift): "), event_type)),
        )
        .when(fields.isNull(), none)
        .otherwise(F.filter(F.transform(fields, check), lambda text: text.isNotNull()))
    )


def contract_outcome(mode: str, violations: Column) -> Column:
    if mode == "off":
        return F.lit(PASS)
    broken = VIOLATION_ENFORCE if mode == "enforce" else VIOLATION_MONITOR
    return F.when(F.size(violations) > 0, F.lit(broken)).otherwise(F.lit(PASS))
