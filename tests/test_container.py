"""Sample tables against files built box by box."""

import struct

import numpy as np
import pytest

from framelake.operators import pixels
from framelake.sources import container


def box(kind, *content, wide=False):
    body = b"".join(content)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def table(kind, rows, form):
    return box(kind, bytes(4), struct.pack(">I", len(rows)), b"".join(struct.pack(form, *r) for r in rows))


def build(rng, n, wide=False, ctts=True, stss=True, one_size=0, edit=0, scale=24000, sound=True, moov_first=False):
    """(file, rows as they must be): random sizes, chunks and decoding orders."""
    sizes = [one_size or int(s) for s in rng.integers(1, 40, n)]
    per = []
    while sum(per) < n:
        per.append(min(int(rng.integers(1, 6)), n - sum(per)))
    durations = [1001] * n if n % 2 else [int(d) for d in rng.integers(500, 1500, n)]
    shifts = [int(s) for s in rng.integers(0, 4, n) * 1001] if ctts else [0] * n
    keys = sorted({0, *(int(k) for k in rng.integers(0, n, max(1, n // 9)))}) if stss else list(range(n))
    runs = lambda values: [(len([*g]), v) for v, g in __import__("itertools").groupby(values)]
    stsc = [(i + 1, p, 1) for i, p in enumerate(per) if not i or per[i - 1] != p]

    def movie(chunks):
        stbl = [table(b"stts", runs(durations), ">II"), box(b"stsz", bytes(4), struct.pack(">II", one_size, n), b"" if one_size else struct.pack(f">{n}I", *sizes)), table(b"stsc", stsc, ">III")]
        stbl += [table(b"co64" if wide else b"stco", [(c,) for c in chunks], ">Q" if wide else ">I")]
        stbl += [table(b"ctts", runs(shifts), ">Ii")] * ctts + [table(b"stss", [(k + 1,) for k in keys], ">I")] * stss
        mdhd = box(b"mdhd", bytes([1, 0, 0, 0]) + bytes(16) + struct.pack(">IQI", scale, 0, 0) if wide else bytes(12) + struct.pack(">III", scale, 0, 0))
        media = box(b"mdia", mdhd, box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", box(b"stbl", *stbl, wide=wide)))
        edts = [box(b"edts", table(b"elst", [(5, -1, 65536), (0, edit, 65536)], ">IiI"))] if edit else []
        voice = [box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(12))))] * sound
        return box(b"moov", box(b"mvhd", bytes(20)), *voice, box(b"trak", box(b"tkhd", bytes(9)), *edts, media), wide=wide)

    head = box(b"ftyp", b"isom", bytes(4))
    data = bytes(int(x) for x in rng.integers(0, 256, sum(sizes) + 3 * len(per)))
    at = len(head) + (len(movie([0] * len(per))) if moov_first else 0) + (16 if wide else 8)
    chunks, offsets, k = [], [], 0
    for p in per:
        at += int(rng.integers(0, 3)) if at - len(head) < len(data) else 0
        chunks.append(at)
        for _ in range(p):
            offsets.append(at)
            at += sizes[k]
            k += 1
    mdat = box(b"mdat", data, bytes(8), wide=wide)
    file = head + (movie(chunks) + mdat if moov_first else mdat + movie(chunks))
    dts = np.cumsum([0, *durations])[:-1]
    micro = lambda t: (int(t) * 1_000_000 + scale // 2) // scale
    return file, [(k, offsets[k], sizes[k], micro(dts[k]), micro(dts[k] + shifts[k] - edit), k in keys) for k in range(n)]


@pytest.fixture(scope="module")
def films(tmp_path_factory):
    rng, folder, want = np.random.default_rng(4), tmp_path_factory.mktemp("mp4"), {}
    for name, options in {"plain": {"n": 61}, "wide": {"n": 40, "wide": True, "moov_first": True}, "simple": {"n": 12, "ctts": False, "stss": False, "one_size": 7}, "cut": {"n": 33, "edit": 2002, "scale": 30000, "sound": False}}.items():
        file, want[name] = build(rng, **options)
        (folder / f"{name}.mp4").write_bytes(file)
    (folder / "sound.mp4").write_bytes(box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun")))))
    (folder / "none.mp4").write_bytes(b"")
    return folder, want


def read(spark, path, **options):
    spark.dataSource.register(container.SampleTables)
    return spark.read.format("mp4samples").options(**options).load(str(path))


def test_every_sample_is_where_it_was_put(spark, films):
    folder, want = films
    got = {}
    for r in read(spark, folder).orderBy("video_id", "sample").collect():
        got.setdefault(r["video_id"], []).append(tuple(r)[1:])
    assert got == want


def test_times_and_groups(spark, films):
    folder, want = films
    samples = read(spark, folder)
    times = {(r["video_id"], r["frameIndex"]): r["timestamp"] for r in container.presentation_times(samples).collect()}
    for video, rows in want.items():
        assert [times[video, k + 1] for k in range(len(rows))] == [p / 1e6 for _, p in sorted((r[4], r[4]) for r in rows)]
    groups = container.decodable_groups(samples).collect()
    for video, rows in want.items():
        own = sorted((g for g in groups if g["video_id"] == video), key=lambda g: g["group"])
        assert [g["first"] for g in own] == [r[0] for r in rows if r[5]] and sum(g["samples"] for g in own) == len(rows)
        assert [g["starts"] for g in own] == [min(r[4] for r in rows[g["first"] : g["last"] + 1]) for g in own]
    # A decoder's frames take their own times.
    frames = spark.createDataFrame([("simple", k, 32, 24, bytearray(pixels.synthetic(k, 32, 24))) for k in range(1, 5)], "video_id string, frameIndex int, width int, height int, rgba binary")
    found = pixels.fingerprints(frames.join(container.presentation_times(samples), ["video_id", "frameIndex"])).collect()
    assert {r["frameIndex"]: r["timestamp"] for r in found} == {k: times["simple", k] for k in range(1, 5)}


@pytest.mark.parametrize("harm", ["cut", "count", "samples", "key"])
def test_broken_tables_are_errors_that_name_the_box(spark, tmp_path, harm):
    file, _ = build(np.random.default_rng(1), 20, moov_first=True)
    at = {"count": file.index(b"stts") + 8, "samples": file.index(b"stsz") + 12, "key": file.index(b"stss") + 12}
    broken = file[: file.index(b"stsc")] if harm == "cut" else file[: at[harm]] + struct.pack(">I", 19 if harm == "samples" else 9999) + file[at[harm] + 4 :]
    (tmp_path / "a.mp4").write_bytes(broken)
    (tmp_path / "b.mp4").write_bytes(file)
    name = {"cut": "moov", "count": "stts", "samples": "tells of", "key": "stss"}[harm]
    with pytest.raises(Exception, match=name):
        read(spark, tmp_path).collect()
    assert {r["video_id"] for r in read(spark, tmp_path, corrupt="skip").collect()} == {"b"}
