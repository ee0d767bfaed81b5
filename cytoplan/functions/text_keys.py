"""Key normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_key(c: str | Column) -> Column:
    """An id as it is compared: without surrounding blanks and letter case; null stays null."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
