"""Readers: whitespace, zip, semicolon; registry refuses unknown names."""

import pytest
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from datasets import SF_SMALL
from tabflow.session import scratch_path
from tabflow.sources import readers
from tabflow.sources.registry import load_dataset


def test_whitespace_and_zip_roundtrip(spark, tmp_path):
    p = tmp_path / "ws.txt"
    p.write_text("  1   2.5 x\n3\t4.0   y\n\n")
    schema = StructType([StructField("a", LongType()), StructField("b", DoubleType())])
    rows = readers.read_whitespace(spark, str(p), schema).collect()
    assert [(r.a, r.b) for r in rows] == [(1, 2.5), (3, 4.0)]
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a long, b double")
    path = scratch_path(spark, "zip-test")
    readers.write_zip_csv(df.coalesce(1), path).count()
    lines = readers.read_zip_lines(spark, f"{path}/*.zip", skip_header=True)
    back = readers.parse_delimited(lines, schema).collect()
    assert sorted((r.a, r.b) for r in back) == [(1, 2.5), (2, 3.5)]


def test_unknown_dataset_refused(spark):
    with pytest.raises(KeyError):
        load_dataset(spark, SF_SMALL, "no_such_table")
