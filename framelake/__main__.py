"""Fingerprints of videos into JSON lines:

python -m framelake VIDEOS OUT WIDTH HEIGHT [FPS [DECODER]]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framelake.operators import pixels
from framelake.ship import ship
from framelake.sources import readers, video


def main(args: list[str]) -> int:
    if not 4 <= len(args) <= 6:
        print(__doc__, file=sys.stderr)
        return 2
    path, out, width, height = args[:4]
    spark = SparkSession.builder.appName("framelake export").getOrCreate()
    ship(spark)
    spark.dataSource.register(video.RawVideo)
    frames = spark.read.format("rawvideo").option("width", width).option("height", height).option("fps", args[4] if len(args) > 4 else "25")
    frames = (frames.option("decoder", args[5]) if len(args) > 5 else frames).load(path)
    found = pixels.fingerprints(frames, float(args[4]) if len(args) > 4 else 25.0)
    readers.write_records(found.withColumn("pos", F.struct("video_id", "frameIndex")), out)
    print(f"{spark.read.text(out).count()} fingerprints in {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
