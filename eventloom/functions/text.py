from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(value: Column | str) -> Column:
    """True when the value holds a character that is not white space; null gives false."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.rlike(r"\S"), F.lit(False))


def is_set(value: Column | str) -> Column:
    """True when the value is neither null nor the empty string."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column != "", F.lit(False))


def properties_json(text: Column) -> Column:
    """JSON object text for the properties column; null and blank give '{}'."""
    return F.when(has_text(text), text).otherwise(F.lit("{}"))
