"""Publication status as a monotone lattice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which a status may only ever rise.
STATUS_ORDER = ["active", "corrected", "concern", "withdrawn", "retracted"]
# Statuses that make a source unusable, as the reader and the workflow list them.
READER_INACTIVE = ["retracted", "quarantined", "stale", "superseded", "corrected", "excluded"]
WORKFLOW_BLOCKED = ["quarantined", "stale", "retracted", "withdrawn", "concern", "superseded", "corrected"]


def priority(status: Column) -> Column:
    """Rank 0..4; unknown or absent text ranks as active."""
    found = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return F.greatest(F.coalesce(found, F.lit(1)) - 1, F.lit(0)).cast("int")


def from_priority(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_ORDER]), rank + 1)


def higher(previous: Column, incoming: Column) -> Column:
    """The higher of two statuses; a tie keeps the first."""
    return F.when(priority(incoming) > priority(previous), incoming).otherwise(previous)


def max_status(status: Column) -> Column:
    """Aggregate: the highest status of a group."""
    return from_priority(F.max(priority(status)))
