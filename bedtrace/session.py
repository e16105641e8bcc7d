"""Session helpers: sizing knobs and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CELL_ROWS_CONF = "spark.bedtrace.cellRows"
DEFAULT_CELL_ROWS = 1 << 20
BATCH_BYTES = 4 << 20
_WRITTEN: dict[str, StructType] = {}


def cell_rows(spark: SparkSession) -> int:
    """Target number of rows of one ordered slice, the largest unit a single task sorts."""
    return int(spark.conf.get(CELL_ROWS_CONF, str(DEFAULT_CELL_ROWS)))


def bounded_batches(spark: SparkSession) -> None:
    """Rows that hold arrays go to Python in batches of bounded size, not by ten thousands."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session that names none, as in tests, gets a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that all machines see and ``release`` leaves alone."""
    return f"{_shared_dir(spark).rstrip('/')}/{name}"


def store(df: DataFrame, by: Sequence[str] = ()) -> str:
    """Write ``df`` to the shared checkpoint folder, in a folder for each value of ``by``; the path of the table."""
    path = f"{_shared_dir(df.sparkSession).rstrip('/')}/bedtrace/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _WRITTEN[path] = df.schema
    return path


def read_stored(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored tables of one schema, as one table."""
    reader = spark.read.schema(_WRITTEN[paths[0]])
    if len(paths) == 1:
        return reader.parquet(paths[0])
    # each table finds its own partition columns
    return reduce(DataFrame.unionByName, [spark.read.schema(_WRITTEN[p]).parquet(p) for p in paths])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Later steps then neither repeat the work before nor depend on the executors that did it. A written table is used
    rather than ``checkpoint()``: it is computed once, read back by column, and its size is known to the planner.
    """
    return read_stored(df.sparkSession, store(df))


def release(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` has written so far, and give their number.

    To be called once the results that were built on them have been written or collected.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.popitem()[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bedtrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
