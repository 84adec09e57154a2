"""All named queries (``QUERIES``) and the SQL that gives the same rows (``ORACLES``)."""

from driftgrid.catalog import aggregates, decoding, joining, streams  # noqa: F401
from driftgrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
