"""Whole matches and extraction, end to end. Walks and pixels have no SQL; tests hold them against planted edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import align, pixels
from framelake.plans import views as V


def _match(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames, pairs = V.footage(spark, sf_dir)
    return align.match_videos(pairs, frames)


def match_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[0]


def match_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir)[1]


def match_in_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw segments by the stages for long references, whatever the references' length."""
    frames, pairs = V.footage(spark, sf_dir)
    return align.find_segments(pairs, frames, in_one_task=0)


def extract_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every frame's picture, with all variants' hashes."""
    found = V.drawn(V.grids(spark, sf_dir), pixels.fingerprinted(), pixels.FINGERPRINT, 64, 48)
    hashes = F.transform(F.array_sort(F.map_entries("variants")), lambda e: F.concat_ws("/", e["key"], e["value"]["hash"], e["value"]["dhash"], e["value"]["fhash"], e["value"]["fdhash"]))
    return found.select("video_id", "frameIndex", "timestamp", F.size("variants").alias("variants"), F.array_join(hashes, ",").alias("hashes"), "signature.*")


def extract_synthetic(spark: SparkSession, frames: int = 24, width: int = 320, height: int = 240) -> DataFrame:
    """Fingerprints of synthetic frames, made where they are hashed: for timing."""

    def make(batches):
        import pandas as pd

        for b in batches:
            ids = b["id"].tolist()
            for a in range(0, len(ids), 8):
                some = ids[a : a + 8]
                yield pd.DataFrame({"video_id": "synthetic", "frameIndex": [k + 1 for k in some], "width": width, "height": height, "rgba": [pixels.synthetic(k, width, height) for k in some]})

    raw = spark.range(0, frames, 1, min(frames, 64)).mapInPandas(make, "video_id string, frameIndex int, width int, height int, rgba binary")
    return pixels.fingerprints(raw).select("video_id", "frameIndex", "timestamp", F.col("variants")["full"]["hash"].alias("hash"), F.size("variants").alias("variants"))


QUERIES = {"match_segments": match_segments, "match_unmatched": match_unmatched, "match_in_bands": match_in_bands, "extract_fingerprints": extract_fingerprints}
ORACLES: dict[str, str] = {}
