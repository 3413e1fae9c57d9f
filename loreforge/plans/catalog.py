"""Every query of the library by name, with the SQL that it must agree with."""

from __future__ import annotations

from loreforge.plans import dashboards, learning, relational, retrieval, streams, texts  # noqa: F401
from loreforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
