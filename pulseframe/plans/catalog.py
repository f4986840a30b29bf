"""Loads every query module so that the registry is complete."""

from __future__ import annotations

from pulseframe.plans import daily, decisions, ingest, learning, reports, state, streams
from pulseframe.plans.registry import ORACLES, QUERIES

MODULES = (ingest, daily, decisions, learning, reports, state, streams)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
