"""Sample tables of MP4 files: where each coded picture of a video lies, when it is shown, and which can be decoded by themselves.

    spark.dataSource.register(SampleTables)
    samples = spark.read.format("mp4samples").load("/shared/videos")
    presentation_times(samples)       # video_id, frameIndex, timestamp: a decoder's own times for fingerprints
    decodable_groups(samples)         # runs from one key picture to the next: what a decoding task can take by itself

A file is one task, which goes from box to box by their sizes and reads only the tables of the first video track (stts, ctts, stsz, stsc, stco or co64, stss, mdhd and the edit list's first
start), never the pictures. Rows come in decoding order: video_id, sample (from 0), offset, size, dts and pts in microseconds, keyframe. Without stss every picture is a key picture. A
file without a video track has no rows; a box that ends beyond its parent, or tables that contradict each other, are an error that names file and box, unless the option corrupt is
"skip": then the file has no rows. Paths are of a file system that all executors mount.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "video_id string, sample bigint, offset bigint, size bigint, dts bigint, pts bigint, keyframe boolean"


class CorruptBox(ValueError):
    pass


class SampleTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.skip = options.get("corrupt", "error") == "skip"

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(self.path, n) for n in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(n) for n in names if os.path.isfile(n) and not os.path.basename(n).startswith((".", "_"))]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        video = os.path.splitext(os.path.basename(part.value))[0]
        try:
            with open(part.value, "rb") as f:
                rows = _samples(f, os.path.getsize(part.value))
        except CorruptBox as e:
            if self.skip:
                return
            raise CorruptBox(f"{part.value}: {e}") from None
        for a in range(0, len(rows["size"]) if rows else 0, 50_000):
            own = {k: v[a : a + 50_000] for k, v in rows.items()}
            n = len(own["size"])
            yield pa.RecordBatch.from_arrays([pa.array([video] * n), pa.array(np.arange(a, a + n)), *[pa.array(own[k]) for k in ("offset", "size", "dts", "pts", "keyframe")]], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _boxes(f: BinaryIO, at: int, end: int, inside: str) -> Iterator[tuple[str, int, int]]:
    """(kind, first byte of its content, end) of the boxes from at to end."""
    while at < end:
        if end - at < 8:
            raise CorruptBox(f"{end - at} bytes after the last box of {inside}")
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        content = at + 8
        if size == 1:
            wide = f.read(8)
            if len(wide) < 8:
                raise CorruptBox(f"a box of {inside} has no size")
            size, content = struct.unpack(">Q", wide)[0], at + 16
        stop = end if size == 0 else at + size
        name = kind.decode("latin-1")
        if stop > end or stop < content:
            raise CorruptBox(f"box {name} of {inside} ends at {stop}, outside {at} to {end}")
        yield name, content, stop
        at = stop


def _children(f: BinaryIO, box: tuple[int, int], inside: str) -> dict[str, tuple[int, int]]:
    """The first box of each kind."""
    out: dict[str, tuple[int, int]] = {}
    for kind, a, z in _boxes(f, *box, inside):
        out.setdefault(kind, (a, z))
    return out


def _table(f: BinaryIO, box: tuple[int, int], kind: str, columns: str) -> np.ndarray:
    """The entries of a table box: flags, a count, and rows of big-endian numbers."""
    row = np.dtype([(f"c{k}", c) for k, c in enumerate(columns.split())])
    a, z = box
    f.seek(a)
    head = f.read(8)
    n = struct.unpack(">I", head[4:])[0] if len(head) == 8 else -1
    if n < 0 or a + 8 + n * row.itemsize > z:
        raise CorruptBox(f"box {kind} says {n} entries and is {z - a} bytes long")
    return np.frombuffer(f.read(n * row.itemsize), row)


def _samples(f: BinaryIO, size: int) -> dict[str, np.ndarray] | None:
    top = _children(f, (0, size), "the file")
    if "moov" not in top:
        return None
    moov_edit = None
    for kind, a, z in _boxes(f, *top["moov"], "moov"):
        if kind != "trak":
            continue
        trak = _children(f, (a, z), "trak")
        media = _children(f, trak["mdia"], "mdia") if "mdia" in trak else {}
        if "hdlr" not in media:
            continue
        f.seek(media["hdlr"][0] + 8)
        if f.read(4) == b"vide":
            moov_edit = trak.get("edts")
            break
    else:
        return None
    for need, box, inside in (("mdhd", media, "mdia"), ("minf", media, "mdia")):
        if need not in box:
            raise CorruptBox(f"no {need} in {inside}")
    f.seek(media["mdhd"][0])
    version = f.read(1)[0]
    f.seek(media["mdhd"][0] + (20 if version == 1 else 12))
    scale = struct.unpack(">I", f.read(4))[0]
    minf = _children(f, media["minf"], "minf")
    table = _children(f, minf["stbl"], "stbl") if "stbl" in minf else {}
    if missing := [k for k in ("stts", "stsz", "stsc") if k not in table] + ["stco"] * ("stco" not in table and "co64" not in table):
        raise CorruptBox(f"no {missing[0]} in stbl")
    if not scale:
        raise CorruptBox("box mdhd has a time scale of 0")

    f.seek(table["stsz"][0] + 4)
    one, n = struct.unpack(">II", f.read(8))
    if not one and table["stsz"][0] + 12 + 4 * n > table["stsz"][1]:
        raise CorruptBox(f"box stsz says {n} samples and is {table['stsz'][1] - table['stsz'][0]} bytes long")
    sizes = np.full(n, one, np.int64) if one else np.frombuffer(f.read(4 * n), ">u4").astype(np.int64)
    stts = _table(f, table["stts"], "stts", ">u4 >u4")
    dts = np.cumsum(np.concatenate([[0], np.repeat(stts["c1"].astype(np.int64), stts["c0"])]))[:-1]
    shift = np.zeros(n, np.int64)
    if "ctts" in table:
        ctts = _table(f, table["ctts"], "ctts", ">u4 >i4")
        shift = np.repeat(ctts["c1"].astype(np.int64), ctts["c0"])
    chunks = _table(f, table["co64"], "co64", ">u8")["c0"] if "co64" in table else _table(f, table["stco"], "stco", ">u4")["c0"]
    stsc = _table(f, table["stsc"], "stsc", ">u4 >u4 >u4")
    first = stsc["c0"].astype(np.int64) - 1
    per = np.repeat(stsc["c1"].astype(np.int64), np.diff(np.append(first, len(chunks)))) if len(first) and (np.diff(np.append(first, len(chunks))) >= 0).all() and first[0] == 0 else np.zeros(0, np.int64)
    for name, got in (("stts", len(dts)), ("ctts", len(shift)), ("stsc", int(per.sum()))):
        if got != n:
            raise CorruptBox(f"box {name} tells of {got} samples, stsz of {n}")
    before = np.cumsum(sizes) - sizes
    start = np.cumsum(per) - per
    some = per > 0
    offset = np.repeat(chunks[some].astype(np.int64), per[some]) + before - np.repeat(before[start[some]], per[some])
    if n and int((offset + sizes).max()) > size:
        raise CorruptBox(f"a sample ends at {int((offset + sizes).max())}, the file at {size}")
    key = np.ones(n, bool)
    if "stss" in table:
        at = _table(f, table["stss"], "stss", ">u4")["c0"].astype(np.int64) - 1
        if len(at) and (at.min() < 0 or at.max() >= n):
            raise CorruptBox("box stss names a sample that isn't there")
        key[:] = False
        key[at] = True
    begin = _edit_start(f, moov_edit)
    micro = lambda t: (t * 1_000_000 + scale // 2) // scale
    return {"offset": offset, "size": sizes, "dts": micro(dts), "pts": micro(dts + shift - begin), "keyframe": key}


def _edit_start(f: BinaryIO, edts: tuple[int, int] | None) -> int:
    """Where in the media the shown part begins: the first edit that isn't empty."""
    if edts is None or "elst" not in (inside := _children(f, edts, "edts")):
        return 0
    f.seek(inside["elst"][0])
    wide = f.read(1)[0] == 1
    entries = _table(f, inside["elst"], "elst", ">u8 >i8 >u4" if wide else ">u4 >i4 >u4")
    return next((int(e["c1"]) for e in entries if e["c1"] >= 0), 0)


def presentation_times(samples: DataFrame, first: int = 1) -> DataFrame:
    """video_id, frameIndex (in the order shown, from `first`), timestamp in seconds: to be joined to frames or fingerprints."""
    at = F.row_number().over(Window.partitionBy("video_id").orderBy("pts", "sample")) - 1 + first
    return samples.select("video_id", at.cast("int").alias("frameIndex"), (F.col("pts") / 1_000_000).alias("timestamp"))


def decodable_groups(samples: DataFrame) -> DataFrame:
    """video_id, group, first and last sample, samples, from and to (bytes), starts (pts of the first shown): runs from a key picture to the next. What comes before the first key picture
    is group 0."""
    number = F.sum(F.col("keyframe").cast("bigint")).over(Window.partitionBy("video_id").orderBy("sample"))
    return samples.withColumn("group", number).groupBy("video_id", "group").agg(
        F.min("sample").alias("first"), F.max("sample").alias("last"), F.count("*").alias("samples"), F.min("offset").alias("from"), F.max(F.col("offset") + F.col("size")).alias("to"), F.min("pts").alias("starts")
    )
