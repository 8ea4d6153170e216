"""All registered queries, by topic."""

from tidewatch.catalog import cleaning, ingest, learning, lookups, monitoring, scoring, streams, wide  # noqa: F401
from tidewatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
