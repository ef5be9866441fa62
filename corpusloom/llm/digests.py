"""Digest columns shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_len(text: Column) -> Column:
    """Bytes of a text in UTF-8; null counts none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
