"""File readers and writers.

All readers take an explicit schema (no inference on the hot path except for
the published-results reader, which is a few rows).  Whitespace-separated text
is parsed with ``split`` on a regex because the CSV reader's ``sep`` is a
literal.  Zip archives are opened per file in Arrow batches -- one task per
archive, lines streamed out, never the archive as a whole through the driver.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = False,
             sep: str = ",") -> DataFrame:
    """Comma or semicolon files, with or without header; ``.gz`` by suffix."""
    return (spark.read.schema(schema).option("header", str(header).lower())
            .option("sep", sep).option("mode", "PERMISSIVE").csv(path))


def read_whitespace(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A4: runs of blanks as separator; fields are cast to the schema (try_cast)."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return lines.select(*[F.element_at(parts, i + 1).try_cast(f.dataType).alias(f.name)
                          for i, f in enumerate(schema.fields)])


def _zip_lines(batches, member: str | None, skip_header: bool):
    import pandas as pd
    for pdf in batches:
        out = []
        for content in pdf["content"]:
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as zf:
                names = [n for n in zf.namelist() if not n.endswith("/")]
                chosen = [member] if member else names
                for name in chosen:
                    with zf.open(name) as fh:
                        text = io.TextIOWrapper(fh, encoding="utf-8")
                        for i, line in enumerate(text):
                            if skip_header and i == 0:
                                continue
                            line = line.rstrip("\r\n")
                            if line:
                                out.append(line)
                    if len(out) >= 65536:
                        yield pd.DataFrame({"value": out})
                        out = []
        if out:
            yield pd.DataFrame({"value": out})


def read_zip_lines(spark: SparkSession, path_glob: str, member: str | None = None,
                   skip_header: bool = False) -> DataFrame:
    """A5: text lines of a member (or all members) of each zip archive."""
    bins = spark.read.format("binaryFile").load(path_glob).select("content")
    return bins.mapInPandas(lambda it: _zip_lines(it, member, skip_header),
                            schema=StructType([StructField("value", StringType())]))


def parse_delimited(lines: DataFrame, schema: StructType, sep: str = ",") -> DataFrame:
    """Project text lines into typed columns (after A5)."""
    import re
    parts = F.split(F.col("value"), re.escape(sep) if sep != r"\s+" else sep)
    return lines.select(*[F.element_at(parts, i + 1).try_cast(f.dataType).alias(f.name)
                          for i, f in enumerate(schema.fields)])


def write_zip_csv(df: DataFrame, path: str, member: str = "data.csv", header: bool = True) -> DataFrame:
    """Write each partition as one zip archive with one CSV member (tests and
    round trips).  Returns the written file names (one row per archive)."""
    cols = df.columns

    def _write(batches, _cols=cols, _path=path):
        import pandas as pd
        from pyarrow import fs as pafs
        from pyspark import TaskContext
        buf = io.StringIO()
        if header:
            buf.write(",".join(_cols) + "\n")
        n = 0
        for pdf in batches:
            pdf.to_csv(buf, header=False, index=False)
            n += len(pdf)
        if n == 0:
            return
        # shared storage through pyarrow (local, HDFS, S3 ...); the name is the
        # partition id, so a retried task overwrites instead of duplicating
        filesystem, base = pafs.FileSystem.from_uri(_path)
        filesystem.create_dir(base, recursive=True)
        pid = TaskContext.get().partitionId()
        name = f"{base}/part-{pid:05d}.zip"
        tmp = f"{base}/.part-{pid:05d}.zip.inprogress"
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", compression=zipfile.ZIP_DEFLATED) as zf:
            zf.writestr(member, buf.getvalue())
        with filesystem.open_output_stream(tmp) as out:
            out.write(raw.getvalue())
        filesystem.move(tmp, name)  # readers never see a half-written archive
        yield pd.DataFrame({"file": [name], "rows": [n]})

    return df.mapInPandas(_write, schema="file string, rows long")


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Save a result table (header CSV or parquet)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Load a published/saved result table (small; schema inferred)."""
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
