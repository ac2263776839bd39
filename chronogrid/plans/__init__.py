"""Registered queries over the driver tables."""

from . import expressions, files, history, reading, scheduling, staff, statistics, tracking  # noqa: F401
from .registry import CATALOG

__all__ = ["CATALOG"]
