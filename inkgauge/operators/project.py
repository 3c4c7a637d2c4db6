"""Projection helpers (PRJ1, PRJ11-PRJ13): schema checks and profiles.

Checks read only the schema (no job); profiles are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    """PRJ1: fail early (before any job) when required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} must contain columns {columns}; missing {missing}")
    return df


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """PRJ13: the subset of ``columns`` that exist and are numeric (others
    are skipped by summaries, as the evaluated scripts do)."""
    types = dict(df.dtypes)
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    fields = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if c in types and isinstance(fields[c], num)]


def profile(df: DataFrame, name: str) -> DataFrame:
    """PRJ11: one-row profile - name, row count, column count, and the
    ``column:type`` list (the row count is the only job)."""
    schema = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(schema).alias("schema"))


def or_empty(df: DataFrame) -> tuple[DataFrame, bool]:
    """PRJ12: ``(df, is_empty)``; ``isEmpty`` stops at the first row, so the
    guard costs one short job, and callers return the typed empty frame."""
    return df, df.isEmpty()
