"""Session helpers: where intermediate tables go, small reusable expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs in this process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, **options: int) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from these files, so
    the loss of an executor never repeats the work before, and no stage runs twice. options: of the writer."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/framelake-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop_all() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: the optimiser may copy a column's expression into a
    lambda, where it would run for every element; a lambda's own variable is never copied."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
