"""Dataset registry (A1): name -> projection of the supplied tables + TableSpec.

Each entry names the table, the unique row key and the projected columns with
their kind/role.  Unknown names are refused.  File-based tables (the
reference's CSV / whitespace / zip inputs) are read with ``sources.readers``
and described with a ``TableSpec`` by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ColumnSpec, TableSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def days_since_epoch(c: str):
    return F.datediff(F.to_date(F.col(c)), F.lit("1970-01-01")).cast("long")


@dataclass(frozen=True)
class Dataset:
    table: str
    row_id: str
    exprs: tuple  # (name, column-expression builder)
    spec: TableSpec
    join: tuple | None = None  # (other table, key)


def _orders():
    spec = TableSpec.of(ColumnSpec("o_totalprice", "continuous"),
                        ColumnSpec("o_orderpriority", "categorical"),
                        ColumnSpec("o_orderdate_days", "integer"),
                        ColumnSpec("o_orderstatus", "categorical", "label"))
    exprs = (("row_id", lambda: F.col("o_orderkey").cast("long")),
             ("o_totalprice", lambda: F.col("o_totalprice").cast("double")),
             ("o_orderpriority", lambda: F.col("o_orderpriority")),
             ("o_orderdate_days", lambda: days_since_epoch("o_orderdate")),
             ("o_orderstatus", lambda: F.col("o_orderstatus")))
    return Dataset("orders", "o_orderkey", exprs, spec)


def _customer():
    spec = TableSpec.of(ColumnSpec("c_acctbal", "continuous"),
                        ColumnSpec("c_nationkey", "categorical"),
                        ColumnSpec("c_mktsegment", "categorical", "label"))
    exprs = (("row_id", lambda: F.col("c_custkey").cast("long")),
             ("c_acctbal", lambda: F.col("c_acctbal").cast("double")),
             ("c_nationkey", lambda: F.col("c_nationkey").cast("long")),
             ("c_mktsegment", lambda: F.col("c_mktsegment")))
    return Dataset("customer", "c_custkey", exprs, spec)


def _part():
    spec = TableSpec.of(ColumnSpec("p_size", "integer"),
                        ColumnSpec("p_retailprice", "continuous"),
                        ColumnSpec("p_brand", "categorical"),
                        ColumnSpec("p_type", "categorical", "target"))
    exprs = (("row_id", lambda: F.col("p_partkey").cast("long")),
             ("p_size", lambda: F.col("p_size").cast("long")),
             ("p_retailprice", lambda: F.col("p_retailprice").cast("double")),
             ("p_brand", lambda: F.col("p_brand")),
             ("p_type", lambda: F.col("p_type")))
    return Dataset("part", "p_partkey", exprs, spec)


def _lineitem_flags():
    # all-categorical / many duplicates (auto-k > 2)
    cols = ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax")
    spec = TableSpec.of(*[ColumnSpec(c, "categorical") for c in cols])
    exprs = tuple((c, (lambda c=c: F.col(c))) for c in cols)
    return Dataset("lineitem", None, exprs, spec)


def _embeddings(dim: int = 64):
    spec = TableSpec.of(*[ColumnSpec(f"e{i}", "continuous") for i in range(dim)],
                        ColumnSpec("label", "categorical", "label"))
    exprs = (("row_id", lambda: F.col("vec_id").cast("long")),
             *[(f"e{i}", (lambda i=i: F.element_at("embedding", i + 1).cast("double"))) for i in range(dim)],
             ("label", lambda: F.col("label").cast("long")))
    return Dataset("embeddings", "vec_id", exprs, spec)


def _documents_quality():
    spec = TableSpec.of(ColumnSpec("n_chars", "integer"),
                        ColumnSpec("lang", "categorical"),
                        ColumnSpec("source", "categorical"),
                        ColumnSpec("quality", "categorical", "label"))
    exprs = (("row_id", lambda: F.col("doc_id").cast("long")),
             ("n_chars", lambda: F.col("n_chars").cast("long")),
             ("lang", lambda: F.col("lang")),
             ("source", lambda: F.col("source")),
             ("quality", lambda: F.col("quality").cast("long")))
    return Dataset("documents", "doc_id", exprs, spec, join=("labels", "doc_id"))


REGISTRY = {
    "orders": _orders,
    "customer": _customer,
    "part": _part,
    "lineitem_flags": _lineitem_flags,
    "embeddings": _embeddings,
    "documents_quality": _documents_quality,
}


def dataset_names() -> list[str]:
    return sorted(REGISTRY)


def load_dataset(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, TableSpec]:
    """A1: projected DataFrame (with ``row_id`` where the table has a unique key) and spec."""
    if name not in REGISTRY:
        raise KeyError(f"unknown dataset {name!r}; known: {', '.join(dataset_names())}")
    ds = REGISTRY[name]()
    df = table(spark, sf_dir, ds.table)
    if ds.join:
        other, key = ds.join
        df = df.join(table(spark, sf_dir, other), on=key, how="inner")
    return df.select(*[fn().alias(n) for n, fn in ds.exprs]), ds.spec
