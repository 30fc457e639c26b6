"""A frame store that streams write to in transactions.

Frames lie under path/video_id=/batch_index=/ingest=, 300 a batch index, and a micro-batch writes folders of its own number alone. Its manifest,
written last under path/_manifest/ingest=, makes it visible: readers leave out what has none, so a micro-batch that was cut off shows nothing, and when it is run again it
overwrites its own folders. What is stored already is looked up in the folders that the micro-batch touches, by name; a micro-batch costs the same however large the store is.

    query = store.write(ingest.records(spark, "/shared/in"), "/shared/frames", "/shared/checkpoint")
    store.read(spark, "/shared/frames"); store.status(spark, "/shared/frames")
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.readers import FRAMES_PER_BATCH

_MANIFEST = "video_id string, batch_index int, frames bigint, first int, last int, ingest bigint"


def write(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """The streaming query that stores frames, each once, however often it is sent: the first that came stays."""
    started = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, path, number))
    return started.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_batch(batch: DataFrame, path: str, number: int) -> None:
    """One transaction: the frames of batch that the store doesn't have, then the manifest."""
    spark = batch.sparkSession
    new = batch.filter("video_id is not null and frameIndex is not null").dropDuplicates(["video_id", "frameIndex"])
    new = new.withColumn("pos", F.col("frameIndex") - 1).withColumn("batch_index", F.floor(F.col("pos") / FRAMES_PER_BATCH).cast("int")).persist()
    try:
        touched = [(r["video_id"], r["batch_index"]) for r in new.select("video_id", "batch_index").distinct().toLocalIterator()]
        folders = [f for video, index in touched for f in _committed(spark, path, video, index, number)]
        fresh = new
        if folders:
            stored = spark.read.option("basePath", path).parquet(*folders).select(F.col("video_id").cast("string").alias("video_id"), "frameIndex")
            fresh = new.join(stored, ["video_id", "frameIndex"], "left_anti")
        fresh = fresh.withColumn("ingest", F.lit(number).cast("bigint"))
        sorted_ = fresh.repartition("video_id", "batch_index").sortWithinPartitions("video_id", "batch_index", "pos")
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "batch_index", "ingest").parquet(path)
        own = [f"{_folder(path, video, index)}/ingest={number}" for video, index in touched]
        own = [f for f in own if _fs(spark, f)[0].exists(_fs(spark, f)[1])]
        written = spark.read.option("basePath", path).parquet(*own) if own else fresh.limit(0)
        counts = written.groupBy(F.col("video_id").cast("string").alias("video_id"), "batch_index").agg(F.count("*").alias("frames"), F.min("frameIndex").alias("first"), F.max("frameIndex").alias("last"))
        counts.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/ingest={number}")
    finally:
        new.unpersist()


def read(spark: SparkSession, path: str, video_id: str | None = None) -> DataFrame:
    """The frames of all transactions that ended, or one video's."""
    rows = spark.read.parquet(path) if video_id is None else spark.read.option("basePath", path).parquet(f"{path}/video_id={_escaped(video_id)}")
    return rows.join(F.broadcast(manifest(spark, path).select("ingest").distinct()), "ingest", "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, batch_index, frames, first, last, ingest: what each transaction stored; those without a frame have one row of nulls."""
    return spark.read.schema(_MANIFEST).option("basePath", f"{path}/_manifest").json(f"{path}/_manifest/ingest=*")


def status(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """video_id, frames, first, last, state of each video, from the manifests: whole, or with holes, from frame `first` to the last that is stored."""
    m = manifest(spark, path).filter("video_id is not null").groupBy("video_id").agg(F.sum("frames").alias("frames"), F.min("first").alias("first"), F.max("last").alias("last"))
    return m.withColumn("state", F.when(F.col("frames") == F.col("last") - first + 1, "whole").otherwise("holes"))


def _escaped(video_id: str) -> str:
    """A partition folder's form of a value."""
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", video_id)


def _folder(path: str, video_id: str, index: int) -> str:
    return f"{path}/video_id={_escaped(video_id)}/batch_index={index}"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _committed(spark: SparkSession, path: str, video_id: str, index: int, but: int) -> list[str]:
    """The folders of a video's batch index that other transactions wrote and ended."""
    fs, folder = _fs(spark, _folder(path, video_id, index))
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("ingest=") and n != f"ingest={but}" and fs.exists(_fs(spark, f"{path}/_manifest/{n}/_SUCCESS")[1])]
    return [f"{_folder(path, video_id, index)}/{n}" for n in done]
