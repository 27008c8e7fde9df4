"""Spark session and shared-storage helpers.

Every job in this package runs on whatever session the caller owns.  The only
place we create a session is for tests / bench (``get_spark``).  Lineage is cut
with reliable ``DataFrame.checkpoint`` into the cluster-wide folder named by
``spark.checkpoint.dir``; a machine-local folder is only ever chosen when the
master is ``local[...]`` and nothing was configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Level of every cache here.  PySpark's MEMORY_AND_DISK keeps serialized blocks in chunks of 1 MB, each of which takes two
#: regions of a 1 MB-region heap: twice the memory that Spark counts, which ends executors once the caches are full.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
#: Level of packed examples: arrays of a MB or more leave parts of regions empty too, and are read in streams anyway.
ON_DISK = StorageLevel.DISK_ONLY


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tabflow") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("TABFLOW_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="tabflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabflow`` importable in Python workers (functions of the package
    used in ``mapInPandas`` / pandas UDFs are pickled by reference): zip the
    package into the shared checkpoint folder and ``addPyFile`` it, once per
    application.  A cluster that installs the package on its nodes needs none
    of this; it is harmless there."""
    import io
    import zipfile

    from pyarrow import fs as pafs
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", compression=zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, top))
    target = scratch_path(spark, "tabflow-code") + ".zip"
    filesystem, path = pafs.FileSystem.from_uri(target if "://" in target or target.startswith("file:")
                                                else "file://" + target)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
