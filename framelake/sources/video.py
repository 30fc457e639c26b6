"""Video as a source of frames: raw RGBA files, or any file that a decoder command turns into a stream of raw RGBA.

    spark.dataSource.register(RawVideo)
    frames = spark.read.format("rawvideo").option("width", 640).option("height", 360).load("/shared/videos")
    pixels.fingerprints(frames)

Options: width, height (of every frame), fps (25), frames_per_task (250), decoder. Without a decoder a file is split into ranges of frames, one
task each; a decoder ("ffmpeg -v error -i {path} -f rawvideo -pix_fmt rgba -") is run once a file, as its stream can't be entered midway.
Bytes after the last whole frame are left out. A file `<name>.pts` beside a video, one time in microseconds a line, gives its frames' own
timestamps; frames past its end, and all without it, get (frameIndex - 1) / fps. Paths are of a file system that all executors mount.

With the option filters ("true"; it needs spark.sql.python.filterPushdown.enabled) filters on video_id and frameIndex are taken to the files: frames outside
are not read (a decoder's stream is, but goes no further). So an extraction that was
cut off goes on by asking for the frames that its store doesn't have: rest(load, store.status(...)), where load() reads the videos.
"""

from __future__ import annotations

import os
import shlex
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video_id string, frameIndex int, timestamp double, width int, height int, rgba binary"


class Part(InputPartition):
    """Frames first to last of a file; last None: to its end."""

    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (FilteringReader if self.options.get("filters", "false").lower() == "true" else Reader)(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.width, self.height = int(options["width"]), int(options["height"])
        self.fps, self.per_task = float(options.get("fps", "25")), int(options.get("frames_per_task", "250"))
        self.decoder = options.get("decoder")
        if self.width < 1 or self.height < 1 or self.per_task < 1:
            raise ValueError("width, height and frames_per_task must be positive")
        self.size = self.width * self.height * 4
        self.videos: set[str] | None = None
        self.low, self.high = 1, 1 << 62  # frameIndex

    def partitions(self) -> list[Part]:
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        files = [n for n in names if os.path.isfile(n) and not n.endswith(".pts") and not os.path.basename(n).startswith((".", "_"))]
        files = [f for f in files if self.videos is None or _video(f) in self.videos]
        if self.decoder:
            return [Part(f, 0, None) for f in files] if self.low <= self.high else []
        ends = ((f, min(os.path.getsize(f) // self.size, self.high)) for f in files)
        return [Part(f, a, min(n, a + self.per_task) - 1) for f, n in ends for a in range(self.low - 1, n, self.per_task)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Batches of about 8 MB."""
        times, video, held = self._times(part.path), _video(part.path), []

        def batch() -> pa.RecordBatch:
            n, index = len(held), [k + 1 for k, _ in held]
            at = [times[k] if k < len(times) else k / self.fps for k, _ in held]
            columns = [pa.array([video] * n), pa.array(index, pa.int32()), pa.array(at, pa.float64()), pa.array([self.width] * n, pa.int32()), pa.array([self.height] * n, pa.int32()), pa.array([x for _, x in held], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["video_id", "frameIndex", "timestamp", "width", "height", "rgba"])

        for k, rgba in enumerate(self._frames(part), part.first):
            if k + 1 < self.low:
                continue
            if k + 1 > self.high:
                break
            held.append((k, rgba))
            if len(held) * self.size >= 8 << 20:
                yield batch()
        if held:
            yield batch()

    def _times(self, path: str) -> list[float]:
        beside = os.path.splitext(path)[0] + ".pts"
        if not os.path.exists(beside):
            return []
        with open(beside) as f:
            return [int(line) / 1e6 for line in f if line.strip()]

    def _frames(self, part: Part) -> Iterator[bytes]:
        if not self.decoder:
            with open(part.path, "rb") as f:
                f.seek(part.first * self.size)
                for _ in range(part.first, part.last + 1):
                    yield f.read(self.size)
            return
        command = [w.replace("{path}", part.path) for w in shlex.split(self.decoder)]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as p:
            done = False
            try:
                while len(rgba := p.stdout.read(self.size)) == self.size:
                    yield rgba
                done = True
            finally:
                if not done:  # nobody asks for more
                    p.kill()
        if p.returncode:
            raise RuntimeError(f"decoder ended with {p.returncode} on {part.path}")


class FilteringReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on video_id (one or several) and bounds of frameIndex are kept here; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "video_id" and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = own if self.videos is None else self.videos & own
            elif column == "frameIndex" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


def _video(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def rest(load: Callable[[], DataFrame], stored: DataFrame) -> DataFrame:
    """The frames, as of load(), that a store doesn't have yet, for an extraction to go on with; stored: video_id, frames, first, last and state of each video, as of
    streaming.store.status. A whole video goes on after its last frame, one with holes starts again. Videos are asked for by what they miss, so that the source reads no
    frame before that; each part is a load of its own, as a reader keeps the filters it was given."""
    at = {r["video_id"]: r["last"] for r in stored.filter("state = 'whole'").select("video_id", "last").collect()}
    groups: dict[int, list[str]] = {}
    for video, last in at.items():
        groups.setdefault(last, []).append(video)
    out = load().filter(~F.col("video_id").isin([*at])) if at else load()
    for last, videos in sorted(groups.items()):
        out = out.unionByName(load().filter(F.col("video_id").isin(videos) & (F.col("frameIndex") > last)))
    return out
