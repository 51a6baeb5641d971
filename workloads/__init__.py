"""Workloads over the test tables; importing this package registers them all."""

from workloads import flows, functions, ingest, stores, sync  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
