"""The video catalogue: jobs, their states, and how an interrupted one goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rebuild(metas: DataFrame, results: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """name, size, job_id, created: jobs with a result and without a checkpoint, the newest of each name and size."""
    done = metas.join(results, "job_id", "left_semi").join(checkpoints, "job_id", "left_anti")
    return done.groupBy("name", "size").agg(F.max_by("job_id", "created").alias("job_id"), F.max("created").alias("created"))


def lookup(known: DataFrame, wanted: DataFrame) -> DataFrame:
    return known.join(wanted, ["name", "size"], "left_semi")


def find_checkpoint(checkpoints: DataFrame, name: str, size: int) -> DataFrame:
    """The newest checkpoint of a file, if any; corrupt ones (no key) never match."""
    return checkpoints.filter(F.col("checkpointKey") == f"{name}:{size}").orderBy(F.desc("updatedAt")).limit(1)


def remaining(frames: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Frames at or past resume_from; videos without one from the start."""
    return frames.join(done, key, "left").filter(F.col("pos") >= F.coalesce("resume_from", F.lit(0))).drop("resume_from")


def upsert(catalog: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    return catalog.join(changes, key, "left_anti").unionByName(changes)


def delete(catalog: DataFrame, job_id: str) -> DataFrame:
    """Without the job; ids other than word characters and hyphens name none."""
    return catalog.filter(~(F.col("job_id").rlike(r"^[\w-]+$") & (F.col("job_id") == job_id)))


def compare(truth: DataFrame, run: DataFrame, keys: list[str], value: str) -> DataFrame:
    """state (same, different, missing, extra) and n of two runs' rows."""
    a, b = truth.withColumn("_a", F.lit(True)), run.withColumnRenamed(value, "_other").withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col(value).eqNullSafe(F.col("_other")), "same").otherwise("different")
    return a.join(b, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def progress(jobs: DataFrame) -> DataFrame:
    """percent, fps and seconds left of jobs (total, processed, elapsed seconds)."""
    fps = F.col("processed") / F.greatest(F.col("elapsed"), F.lit(0.001))
    return jobs.select("*", F.least(F.lit(100.0), 100 * F.col("processed") / F.greatest(F.col("total"), F.lit(1))).alias("percent"), fps.alias("fps"), ((F.col("total") - F.col("processed")) / F.greatest(fps, F.lit(0.001))).alias("eta"))


def new_id() -> Column:
    """A fresh id of word characters and hyphens for each row."""
    return F.concat(F.unix_millis(F.current_timestamp()).cast("string"), F.lit("-"), F.substring(F.replace(F.expr("uuid()"), F.lit("-")), 1, 7))


def same_hashes(first: DataFrame, second: DataFrame, key: str, size: int = 256) -> DataFrame:
    """key, hash_ok, same, prefix: whether two extractions of the same frames agree (columns key and hash). A frame without a partner differs."""
    other = second.select(key, F.col("hash").alias("_hash"))
    j = first.select(key, "hash").join(other, key, "full_outer")
    return j.select(key, (F.coalesce(F.length("hash"), F.lit(0)) == size).alias("hash_ok"), (F.col("hash").eqNullSafe(F.col("_hash"))).alias("same"), F.substring("hash", 1, 48).alias("prefix"))
