"""Dictionaries, scaling, one-hot coding, rounding and clipping.

Statistics (bounds, dictionaries) come from one aggregate job each and are
returned to the driver as a handful of numbers / category values -- their size
is the number of columns / categories of the schema, never the row count.
Everything applied to the rows is a plain column expression (whole-stage
codegen, no Python per row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import nan_to_null
from .prefix import row_numbers

MAX_DICTIONARY = 100_000  # one-hot / decode dictionaries are schema-sized


# ---- dictionaries (A8, A9, A10, A12) ----------------------------------------

def factorize_first_seen(df: DataFrame, col: str, order: str, out: str | None = None) -> DataFrame:
    """code = order of first appearance (by ``order``); missing -> -1."""
    out = out or f"{col}_code"
    first = (df.filter(F.col(col).isNotNull())
             .groupBy(col).agg(F.min(order).alias("__first")))
    dic = row_numbers(first, ["__first", col], name="__rn").select(
        col, (F.col("__rn") - 1).cast("long").alias(out))
    return (df.join(dic, on=col, how="left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("long"))))


def sorted_dictionary(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """A9 dictionary: value -> rank among sorted distinct values (0-based)."""
    vals = df.filter(F.col(col).isNotNull()).select(col).distinct()
    return row_numbers(vals, [col], name="__rn").select(
        col, (F.col("__rn") - 1).cast("long").alias(out))


def label_encode_sorted(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``LabelEncoder`` semantics; inverse = join the dictionary back."""
    out = out or f"{col}_code"
    return df.join(sorted_dictionary(df, col, out), on=col, how="left")


def label_decode(df: DataFrame, code_col: str, dictionary: DataFrame, value_col: str) -> DataFrame:
    """A9 inverse: code -> original value via the dictionary."""
    d = dictionary.withColumnRenamed(dictionary.columns[1], code_col)
    return df.join(d, on=code_col, how="left")


def label_shift(col: Column | str, gap_from: int | None = None) -> Column:
    """A10: 1-based -> 0-based; optionally close a gap: shifted codes >= gap_from
    move down one more (glass labels 1,2,3,5,6,7 -> 0..5 with gap_from=4)."""
    c = F.col(col) if isinstance(col, str) else col
    shifted = c - F.lit(1)
    if gap_from is not None:
        shifted = F.when(shifted >= F.lit(gap_from), shifted - F.lit(1)).otherwise(shifted)
    return shifted


def validate_category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes must be exactly 0..max.  One aggregate pass over all
    columns, then one row per column."""
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(c).cast("long").alias("min_code"),
                            F.max(c).cast("long").alias("max_code"),
                            F.countDistinct(c).cast("long").alias("n_codes")).alias(f"s{i}")
                   for i, c in enumerate(cols)])
    res = row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s")).select("s.*")
    return res.withColumn("valid", (F.col("min_code") == 0) & (F.col("n_codes") == F.col("max_code") + 1))


# ---- bounds and scaling (C1, C2, C3) ----------------------------------------

def data_bounds(df: DataFrame, cols: Sequence[str],
                given: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float]]:
    """Per-column (min, max) ignoring missing values, or the given override."""
    given = dict(given or {})
    need = [c for c in cols if c not in given]
    if need:
        clean = nan_to_null(df.select(*need))
        row = clean.agg(*[F.min(c).cast("double").alias(f"mn_{i}") for i, c in enumerate(need)],
                        *[F.max(c).cast("double").alias(f"mx_{i}") for i, c in enumerate(need)]).first()
        for i, c in enumerate(need):
            given[c] = (row[f"mn_{i}"], row[f"mx_{i}"])
    return {c: given[c] for c in cols}


def bounds_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C3 as a query: one row per column with its min and max (single pass)."""
    clean = nan_to_null(df.select(*cols))
    stacked = clean.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s"))
    return stacked.groupBy("s.column").agg(F.min("s.v").alias("min_value"), F.max("s.v").alias("max_value"))


def _range(mn: float, mx: float) -> float:
    r = (mx - mn) if (mn is not None and mx is not None) else 1.0
    return 1.0 if r == 0 else r


def scale_expr(c: Column | str, mn: float, mx: float, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Min-max to [lo, hi]; a constant column maps to ``lo`` (scikit-learn)."""
    x = F.col(c) if isinstance(c, str) else c
    return (x - F.lit(float(mn))) / F.lit(_range(mn, mx)) * F.lit(hi - lo) + F.lit(lo)


def unscale_expr(c: Column | str, mn: float, mx: float, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Inverse of ``scale_expr``."""
    z = F.col(c) if isinstance(c, str) else c
    return (z - F.lit(lo)) / F.lit(hi - lo) * F.lit(_range(mn, mx)) + F.lit(float(mn))


def minmax_scale(df: DataFrame, bounds: dict[str, tuple[float, float]],
                 lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    return df.select(*[scale_expr(c, *bounds[c], lo, hi).alias(c) if c in bounds else F.col(c)
                       for c in df.columns])


def minmax_unscale(df: DataFrame, bounds: dict[str, tuple[float, float]],
                   lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    return df.select(*[unscale_expr(c, *bounds[c], lo, hi).alias(c) if c in bounds else F.col(c)
                       for c in df.columns])


# ---- one-hot coding (C4-C8) --------------------------------------------------

def category_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-missing values of a categorical column (bounded)."""
    vals = [r[0] for r in df.filter(F.col(col).isNotNull()).select(col).distinct()
            .orderBy(col).limit(MAX_DICTIONARY + 1).collect()]
    if len(vals) > MAX_DICTIONARY:
        raise ValueError(f"{col}: more than {MAX_DICTIONARY} categories; not a categorical column")
    return vals


def dummy_name(col: str, value) -> str:
    v = value
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return f"{col}_{v}"


def onehot(df: DataFrame, dictionaries: dict[str, list], drop_first: bool = False,
           value: float = 1.0) -> DataFrame:
    """Dummies named ``<col>_<value>``; missing -> all zeros.

    Dummies move to the end (C4).
    """
    plain, dummies = [], []
    for c in df.columns:
        if c not in dictionaries:
            plain.append(F.col(c))
            continue
        vals = dictionaries[c][1:] if drop_first else dictionaries[c]
        cols = [F.when(F.col(c) == F.lit(v), F.lit(float(value))).otherwise(F.lit(0.0))
                .alias(dummy_name(c, v)) for v in vals]
        dummies.extend(cols)
    return df.select(*plain, *dummies)


def onehot_decode_expr(dummy_cols: Sequence[str], values: Sequence) -> Column:
    """0.5 in front of the drop-first dummies, first arg-max, category value."""
    arr = F.array(F.lit(0.5), *[F.col(d).cast("double") for d in dummy_cols])
    idx = F.array_position(arr, F.array_max(arr))  # 1-based, first maximum
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def onehot_decode(df: DataFrame, dictionaries: dict[str, list], order: Sequence[str]) -> DataFrame:
    """C7 on a table produced by ``onehot(drop_first=True)``; restores ``order``."""
    exprs = {}
    used = set()
    for c, vals in dictionaries.items():
        ds = [dummy_name(c, v) for v in vals[1:]]
        used.update(ds)
        exprs[c] = onehot_decode_expr(ds, vals).alias(c)
    return df.select(*[exprs.get(c, F.col(c)) for c in order])


def metric_space(train: DataFrame, other: DataFrame, continuous: Sequence[str],
                 categorical: Sequence[str], divide_by: float = 2.0):
    """[0,1] scaling fitted on ``train`` only, dummies over the union / divide_by."""
    bounds = data_bounds(train, continuous)
    dicts = {}
    if categorical:
        both = train.select(*categorical).unionByName(other.select(*categorical))
        dicts = {c: category_values(both, c) for c in categorical}
    value = 1.0 / divide_by if divide_by > 0 else 1.0

    def tx(d):
        d = minmax_scale(d, bounds, 0.0, 1.0)
        return onehot(d, dicts, drop_first=False, value=value)
    return tx(train), tx(other), bounds, dicts


# ---- rounding and clipping (C9, C10) ----------------------------------------

def round_half_even(c: Column | str) -> Column:
    """NumPy ``round`` semantics (half to even), not SQL ``round`` (half up)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.bround(x, 0).cast("double")


def clip_expr(c: Column | str, mn: float, mx: float) -> Column:
    """Clamp to bounds; missing stays missing (least/greatest skip nulls)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(mx))), F.lit(float(mn))))
