"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m (a null id counts as crc 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % m


def row_hash(id_col: str, text_col: str) -> Column:
    """64-bit key of a row by id and text; rows that agree in it are treated alike."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def n_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
