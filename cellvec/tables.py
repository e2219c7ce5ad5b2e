"""Tables between jobs: written once in the shared checkpoint folder, so plans stay small and nothing is computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session in one local process may go without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = "file://" + tempfile.mkdtemp(prefix="spark-cellvec-")
    return _unset[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``checkpoint_dir``; it goes when the driver ends, as results may read it until then."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table."""
    path = f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
