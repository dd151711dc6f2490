"""Clickstream event analytics as DataFrame-to-DataFrame operators on Spark."""

from eventloom.config import EngineConfig

__all__ = ["EngineConfig"]
