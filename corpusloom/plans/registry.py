"""Every query of the engine by name, with its SQL oracle where one exists."""

from __future__ import annotations

from corpusloom.plans import audited  # noqa: F401  its queries register themselves
from corpusloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
