"""Consent, hashing and masking, before anything else reads the user's data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.privacy import EMAIL, PHONE, mask_email, mask_phone, masked_kind, pii_hash
from eventloom.functions.text import has_text
from eventloom.functions.variants import json_members, json_object, json_string
from eventloom.workspace import allow_repeated_keys


def consent_denied(consent: Column, cfg: EngineConfig) -> Column:
    """Only an explicit refusal counts, and only when consent is required."""
    if not cfg.require_consent:
        return F.lit(False)
    return F.coalesce(~consent, F.lit(False))


def _listed(name: Column, cfg: EngineConfig) -> Column:
    return name.isin(*cfg.pii_fields) if cfg.pii_fields else F.lit(False)


def _as_sent(member: Column) -> Column:
    return F.when(member["is_string"], json_string(member["value"])).otherwise(
        F.coalesce(member["value"], F.lit("null"))
    )


def may_not_stay(member: Column, cfg: EngineConfig) -> Column:
    """A listed property that is not null, or a string that is an e-mail address or a phone
    number."""
    masked = (member["is_string"] & (masked_kind(member["value"]) > 0)) if cfg.mask_heuristics else F.lit(False)
    return F.when(_listed(member["key"], cfg), member["value"].isNotNull()).otherwise(masked)


def protected_text(members: Column, cfg: EngineConfig) -> Column:
    """JSON text with the listed properties hashed and, of the others, e-mail addresses and
    phone numbers masked."""

    def quoted(plain: Column) -> Column:
        # without anything that needs an escape
        return F.concat(F.lit('"'), plain, F.lit('"'))

    def new(member: Column) -> Column:
        value = member["value"]
        text = F.when(_listed(member["key"], cfg) & value.isNotNull(), quoted(pii_hash(value)))
        if cfg.mask_heuristics:
            text = text.when(member["is_string"] & value.rlike(EMAIL), json_string(mask_email(value)))
            text = text.when(member["is_string"] & value.rlike(PHONE), quoted(mask_phone(value)))
        return text.otherwise(_as_sent(member))

    return json_object(members, new)


def stripped_text(members: Column, cfg: EngineConfig) -> Column:
    """JSON text without the listed properties."""
    return json_object(F.filter(members, lambda m: ~_listed(m["key"], cfg)), _as_sent)


def _may_change(text: Column, cfg: EngineConfig) -> Column:
    """A cheap look at the text: can a rule apply at all? Only then is it parsed.

    An escape could hide any character, so text with a backslash is always parsed.
    """
    signs = [r"\\"] + [re.escape(f'"{field}"') for field in cfg.pii_fields]
    if cfg.mask_heuristics:
        signs += ["@", r'"\+?\d[\d\s-]{6,}"']
    return text.rlike("|".join(signs))


def apply_privacy(events: DataFrame, cfg: EngineConfig, custom: str = "custom") -> DataFrame:
    """Consent gate, then hashing, then masking.

    Adds the flags ``consent_denied`` and ``pii_masked``. The JSON text in ``custom``
    is rewritten only for events whose properties change. Where rules apply, properties
    that are no JSON object become null: the rules could not be applied to them.
    """
    denied = consent_denied(F.col("consent"), cfg) if "consent" in events.columns else F.lit(False)
    flagged = events.withColumn("consent_denied", denied)
    user = F.col("user_id")
    hash_user = F.lit(cfg.hash_user_id) & has_text(user) & ~F.col("consent_denied")
    new_user = F.when(F.col("consent_denied"), None).when(hash_user, pii_hash(user)).otherwise(user)
    if not (cfg.pii_fields or cfg.mask_heuristics):
        return flagged.withColumns({"pii_masked": hash_user, "user_id": new_user})

    allow_repeated_keys(events.sparkSession)
    text = F.col(custom)
    looks = _may_change(text, cfg)
    parsed = flagged.withColumn("_members", F.when(looks, json_members(text)))
    members = F.col("_members")
    no_object = ~text.rlike(r"^\s*\{") | (members.isNull() & looks)
    touched = ~F.col("consent_denied") & F.exists(members, lambda m: may_not_stay(m, cfg))
    holds_listed = F.exists(members, lambda m: _listed(m["key"], cfg))
    decided = parsed.withColumns(
        {
            "_no_object": no_object,
            "_changes": ~no_object & F.coalesce(touched, F.lit(False)),
            "_strips": F.col("consent_denied") & F.coalesce(holds_listed, F.lit(False)),
        }
    )
    new_text = (
        F.when(F.col("_no_object"), None)
        .when(F.col("_changes"), protected_text(members, cfg))
        .when(F.col("_strips"), stripped_text(members, cfg))
        .otherwise(text)
    )
    return decided.withColumns(
        {"pii_masked": hash_user | F.coalesce("_changes", F.lit(False)), custom: new_text, "user_id": new_user}
    ).drop("_members", "_changes", "_strips", "_no_object")
