"""Bring tables of older layouts to a known schema."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(
    df: DataFrame, schema: T.StructType | str, defaults: Mapping[str, Any] | None = None
) -> DataFrame:
    """Add missing columns from ``defaults``, order and cast the known ones, drop others."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    given = defaults or {}
    cols = [
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(given.get(f.name)))
        .cast(f.dataType)
        .alias(f.name)
        for f in fields
    ]
    return df.select(*cols)
