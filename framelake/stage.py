"""Where intermediate tables go: Parquet in the shared folder named by spark.checkpoint.dir, so that a lost executor never repeats what came before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in this process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Stages:
    """Tables written on the way to a result. clear() removes them, once the result is written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/framelake-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, but: int = 0) -> None:
        """All but the last `but` tables."""
        last = len(self.paths) - but
        for path in self.paths[:last]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths = self.paths[last:]
