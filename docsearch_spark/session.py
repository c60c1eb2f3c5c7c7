"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Read option for local runs: spread tables of one small file over this many tasks.
SPREAD = "spark.docsearch.read.spread"


def get_spark(app: str = "docsearch_spark", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session; whatever the cluster or spark-submit has set is left as it is.

    Only where nothing names a master (tests, bench on one machine) a local one
    is used, with settings that fit it: shuffle partitions, driver memory, and
    ``spark.docsearch.read.spread`` so that a single small file keeps all cores busy.
    """
    from pyspark import SparkConf
    set_ = SparkConf()
    builder = SparkSession.builder.appName(app)

    def default(key: str, value: str) -> None:
        nonlocal builder
        if not set_.contains(key):
            builder = builder.config(key, value)

    named = master or set_.get("spark.master", None) or os.environ.get("SPARK_MASTER")
    if not named:
        cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
        named = f"local[{cpus}]"
        default("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        default("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
        default("spark.ui.showConsoleProgress", "false")
        default(SPREAD, cpus)
    default("spark.master", named)
    default("spark.ui.enabled", "false")
    default("spark.sql.session.timeZone", "UTC")
    default("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


#: Application id -> private folder, for local sessions without the setting (which
#: cannot be set on a running session).
_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins, and a cluster must have one: a folder of
    one machine would be invisible to the others. Only a local master may go
    without; it gets a private folder under the system temp directory, the same one
    for the life of the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        # local-cluster has executors of its own, with folders of their own
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="docsearch-ckpt-")
            spark.sparkContext.setCheckpointDir(_LOCAL_FOLDERS[app])
        return _LOCAL_FOLDERS[app]
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a stored
    table that several jobs read, survives lost executors, and has a known size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's settings of the rows that an Arrow batch from or to a Python worker holds, and a written file.
ARROW_ROWS, FILE_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxRecordsPerFile"


@contextlib.contextmanager
def at_most(spark: SparkSession, rows: dict[str, int]) -> Iterator[None]:
    """Within, the named settings are at most ``rows`` (0: no bound). For wide rows: executor and
    worker hold an Arrow batch several times over, and Spark's reader takes thousands of
    rows of a file at a time, whatever their width."""
    before = {key: int(spark.conf.get(key)) for key in rows}
    try:
        for key, most in rows.items():
            spark.conf.set(key, str(min(most, before[key]) if before[key] > 0 else most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, str(value))
