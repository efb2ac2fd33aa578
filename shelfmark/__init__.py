"""Spark-native analysis and organization of very large file inventories."""

from shelfmark.config import JobConfig
from shelfmark.plans.organizer import Organizer

__all__ = ["JobConfig", "Organizer"]
