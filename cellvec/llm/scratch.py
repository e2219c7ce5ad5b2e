"""Tables written in the shared checkpoint folder, to cut lineage and to read results twice."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..tables import new_folder


class Scratch:
    """Parquet tables of one job. A table stays until ``drop`` or the driver's end; results may still read it."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = new_folder(spark, job)
        self.made = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``keep`` that nothing reads any more. The driver then collects its garbage,
        on which Spark frees the shuffle files of plans that are gone; else they stay for the whole job."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()
