"""Projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import TableSpec


def project_drop_columns(df: DataFrame, drop: Sequence[int | str]) -> DataFrame:
    """Drop columns by position or name (ids, extra outcomes)."""
    names = df.columns
    gone = {names[d] if isinstance(d, int) else d for d in drop}
    return df.select(*[c for c in names if c not in gone])


def append_target(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Row id, generated columns in spec order with the target last, then the rest."""
    gen = [c.name for c in spec.generated if c.role != "target"]
    tgt = [c.name for c in spec.generated if c.role == "target"]
    lead = [spec.row_id] if spec.row_id in df.columns else []
    rest = [c for c in df.columns if c not in set(lead + gen + tgt)]
    return df.select(*lead, *gen, *tgt, *rest)


def condition_inputs(xt: Column | None, previous: Sequence[Column]) -> Column:
    """Model inputs for column k: ``[x_t, x_0..x_{k-1}]`` (continuous) or
    ``[x_0..x_{k-1}]`` (categorical, ``xt=None``)."""
    items = ([xt] if xt is not None else []) + list(previous)
    return F.array(*[c.cast("double") for c in items])


def project_result_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the named result columns in the given order."""
    return df.select(*cols)
