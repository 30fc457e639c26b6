"""Fingerprint records: one JSON object a line, or one JSON array; stored as Parquet by video."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.ordered import contiguous_prefix

FINGERPRINT = (
    "frameIndex INT, timestamp DOUBLE, variants MAP<STRING, STRUCT<hash: STRING, dhash: STRING, fhash: STRING, fdhash: STRING>>, "
    "signature STRUCT<colorGrid: ARRAY<DOUBLE>, skinScoreGrid: ARRAY<DOUBLE>, detailGrid: ARRAY<DOUBLE>>"
)
FRAMES_PER_BATCH = 300


def read_records(spark: SparkSession, path: str, schema: str | T.StructType = FINGERPRINT) -> DataFrame:
    """Records of a file or folder; malformed and blank lines are skipped. Array files are told by their first character, each file by its own, so a folder may
    hold both; of files of lines the lines are dealt to tasks, an array file is one task's."""
    head = spark.read.format("text").option("lineSep", "\n").load(path).filter(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.substring(F.ltrim("value"), 1, 1).alias("c"))
    first = head.groupBy("file", "at").agg(F.first("c").alias("c")).groupBy("file").agg(F.min_by("c", "at").alias("c"))
    arrays = [r["file"] for r in first.filter("c = '['").collect()]
    reader = lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if not arrays:
        return reader().json(path)
    lines = [r["file"] for r in first.filter("c <> '['").collect()]
    found = reader().option("multiLine", True).json(arrays)
    return found.unionByName(reader().json(lines)) if lines else found


def parse_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column as a struct; malformed records and nulls go."""
    broken = "_framelake_broken"
    parsed = F.from_json(column, f"{schema}, {broken} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    return df.withColumn(column, parsed).filter(F.col(column).isNotNull() & F.col(f"{column}.{broken}").isNull()).withColumn(column, F.col(column).dropFields(broken))


def frame_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Frames from first to last; on files written by write_frames, row groups outside are not read."""
    return df.filter(F.col("pos").between(first, last))


def times_only(df: DataFrame) -> DataFrame:
    return df.select("frameIndex", "timestamp")


def write_frames(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By video and batch of 300 frames, sorted, so a range of frames is a range of files and row groups."""
    out = df.withColumn("batch_index", F.floor(F.col("pos") / FRAMES_PER_BATCH).cast("int"))
    out.repartition("video_id", "batch_index").sortWithinPartitions("video_id", "pos").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "batch_index").parquet(path)


def read_batch(spark: SparkSession, path: str, video_id: str, batch_index: int) -> DataFrame:
    """One batch; none if it isn't there."""
    return spark.read.parquet(path).filter((F.col("video_id") == video_id) & (F.col("batch_index") == batch_index))


def read_video(spark: SparkSession, path: str, video_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("video_id") == video_id).orderBy("pos")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, lines of a file or folder. A last line counts whether or not it is ended."""
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"))


def delete_video(spark: SparkSession, path: str, video_id: str) -> bool:
    """Removes a video's frames from a store written by write_frames: its own folder, nothing is rewritten. False if there was none, and for
    ids other than word characters and hyphens."""
    if not re.fullmatch(r"[\w-]+", video_id, re.ASCII):
        return False
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"video_id={video_id}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_videos(spark: SparkSession, path: str) -> DataFrame:
    """video_id, frames, first, last of a store, from row group statistics where Spark can."""
    return spark.read.parquet(path).groupBy("video_id").agg(F.count("*").alias("frames"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def write_prefix(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores each video's frames up to the first hole; what comes after it waits for the next call."""
    write_frames(contiguous_prefix(df, "video_id"), path, mode)


def write_records(df: DataFrame, path: str) -> None:
    """Ordered JSON lines."""
    df.sort("pos").drop("pos").write.mode("overwrite").json(path)


def export_match(segments: DataFrame, unmatched: DataFrame, parameters: dict) -> DataFrame:
    """One JSON document a match: all of its segments, with their sequences and details, its unmatched ranges, counts and the parameters."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        fields = sorted((c for c in df.columns if c != "match_id"), key=lambda c: c != "shortStart")
        return df.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    both = listed(segments, "segments").join(listed(unmatched, "unmatched"), "match_id", "full_outer")
    full = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)).alias(c)
    given = F.create_map(*[F.lit(str(x)) for kv in parameters.items() for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    sure = F.filter(F.coalesce("segments", F.array().cast(both.schema["segments"].dataType)), lambda s: ~s["isApproximate"])
    stats = F.struct(F.size(full("segments")).alias("segments"), F.size(sure).alias("sure"), F.size(full("unmatched")).alias("unmatched"))
    return both.select("match_id", F.to_json(F.struct(full("segments"), full("unmatched"), stats.alias("matchStats"), given.alias("parameters"))).alias("json"))
