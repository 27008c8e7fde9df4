"""Row cleaning (B1-B5) and NaN handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL for floating columns (Spark min/max treat NaN as largest)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    targets = [c for c in (cols or df.columns) if c in fl]
    return df.select(*[F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in targets else F.col(c) for c in df.columns])


def drop_rows_any_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: drop a row when any of ``cols`` is missing."""
    return nan_to_null(df, cols).na.drop("any", subset=list(cols))


def drop_rows_all_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B2: drop only rows where every one of ``cols`` is missing."""
    return nan_to_null(df, cols).na.drop("all", subset=list(cols))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is missing do not train that target's model."""
    return nan_to_null(df, [target]).filter(F.col(target).isNotNull())


def missing_label_count(df: DataFrame, label: str) -> DataFrame:
    """B4 as a query: count of missing labels (one row)."""
    return nan_to_null(df, [label]).agg(
        F.count_if(F.col(label).isNull()).cast("long").alias("n_missing_label"),
        F.count(F.lit(1)).cast("long").alias("n_rows"))


def assert_label_present(df: DataFrame, label: str) -> None:
    """The label may not be missing (raises)."""
    n = missing_label_count(df, label).first()["n_missing_label"]
    if n:
        raise ValueError(f"label {label!r} has {n} missing values")
