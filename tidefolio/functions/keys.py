"""Surrogate keys that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit separator: does not occur in ids, so two different keys never join to one text.
SEPARATOR = "\x1f"
# Stands for NULL; no id is the file separator alone.
MISSING = "\x1c"


def surrogate_key(*columns: str) -> Column:
    """md5 over the key columns; a retried task gives the same id again."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns]
    return F.md5(F.concat_ws(SEPARATOR, *parts))
