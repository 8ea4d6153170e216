"""Small table helpers: stored steps, size-checked lookups, names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_root, materialize  # noqa: F401

# A lookup of more rows than this is joined by shuffle.
BROADCAST_ROWS = 100_000


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **parts: Column) -> DataFrame:
    """All columns in one struct ``row``, beside ``parts``: no name can clash."""
    whole = F.struct(*[col(c) for c in docs.columns]) if docs.columns else F.struct()
    return docs.select(whole.alias("row"), *[c.alias(k) for k, c in parts.items()])


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` are few, else leave it to the planner."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small
