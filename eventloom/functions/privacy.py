from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a whole value. \z because $ would also accept a
# trailing newline.
EMAIL = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
PHONE = r"\A\+?\d[\d\s-]{6,}\z"


def pii_hash(value: Column) -> Column:
    """'h:' and the first 16 hex digits of SHA-256."""
    return F.concat(F.lit("h:"), F.substring(F.sha2(value.cast("string"), 256), 1, 16))


def mask_email(value: Column) -> Column:
    """First character, three stars, then everything from the first @."""
    at = F.instr(value, "@")
    return F.when(at <= 1, value).otherwise(
        F.concat(F.substring(value, 1, 1), F.lit("***"), F.substr(value, at))
    )


def mask_phone(value: Column) -> Column:
    """Three stars and the last four digits, if there are that many."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) < 4, F.lit("***")).otherwise(
        F.concat(F.lit("***"), F.right(digits, F.lit(4)))
    )


def masked_kind(value: Column) -> Column:
    """2 for an e-mail address, 3 for a phone number, else 0."""
    return F.when(value.rlike(EMAIL), 2).when(value.rlike(PHONE), 3).otherwise(0)
