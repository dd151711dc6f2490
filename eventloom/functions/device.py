"""User-agent rules. Order matters and is part of the result: an Android agent
reports Linux, an iPhone agent macOS, and Opera agents that carry chrome/ report
Chrome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label, then the lower-case fragments of which one must occur.
DEVICE_TYPES = (
    ("mobile", ("mobile", "android", "iphone")),
    ("tablet", ("tablet", "ipad")),
)
OPERATING_SYSTEMS = (
    ("Windows", ("windows",)),
    ("macOS", ("mac os", "darwin")),
    ("Linux", ("linux",)),
    ("Android", ("android",)),
    ("iOS", ("ios", "iphone", "ipad")),
)
# Label, fragments of which one must occur, fragment that must not.
BROWSERS = (
    ("Edge", ("edg/",), None),
    ("Chrome", ("chrome/",), "chromium/"),
    ("Firefox", ("firefox/",), None),
    ("Safari", ("safari/",), "chrome/"),
    ("Opera", ("opera/", "opr/"), None),
)


def _any_of(agent: Column, fragments: tuple[str, ...]) -> Column:
    hit = agent.contains(fragments[0])
    for fragment in fragments[1:]:
        hit = hit | agent.contains(fragment)
    return hit


def _first_label(lowered: Column, rules, fallback: str) -> Column:
    label = F.when(lowered.isNull(), "unknown")
    for name, present, *absent in rules:
        hit = _any_of(lowered, present)
        if absent and absent[0]:
            hit = hit & ~lowered.contains(absent[0])
        label = label.when(hit, name)
    return label.otherwise(fallback)


def device_columns(lowered: Column) -> dict[str, Column]:
    """device_type, os and browser of a lower-case user agent.

    Pass a column, not an expression: it is read by every rule.
    """
    return {
        "device_type": _first_label(lowered, DEVICE_TYPES, "desktop"),
        "os": _first_label(lowered, OPERATING_SYSTEMS, "unknown"),
        "browser": _first_label(lowered, BROWSERS, "unknown"),
    }


def device_type(agent: Column) -> Column:
    return device_columns(F.lower(agent))["device_type"]


def operating_system(agent: Column) -> Column:
    return device_columns(F.lower(agent))["os"]


def browser(agent: Column) -> Column:
    return device_columns(F.lower(agent))["browser"]
