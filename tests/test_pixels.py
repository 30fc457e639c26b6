import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry
from framelake.operators import pixels


@pytest.mark.parametrize("size", [(1920, 1080), (1080, 1920), (1000, 1000)])
def test_crops(spark, size):
    got = pixels.crops(*size)
    assert len(got) == 13 and got[0][0] == "full"
    for _, x, y, w, h in got:
        assert 0 <= x and 0 <= y and x + w <= size[0] and y + h <= size[1]
    row = spark.range(1).select(F.inline(geometry.crop_rects(F.lit(size[0]), F.lit(size[1])))).collect()
    assert [tuple(r) for r in row] == got


def test_same_frame_same_hashes():
    a = pixels.fingerprint(pixels.synthetic(3), 320, 240)
    assert a == pixels.fingerprint(pixels.synthetic(3), 320, 240)
    assert all(len(v["hash"]) == 256 and len(v["dhash"]) == 480 for v in a[0].values())


def test_flat_frame_has_zero_hashes():
    flat = np.full((90, 160, 4), 40, np.uint8).tobytes()
    assert set("".join("".join(v.values()) for v in pixels.fingerprint(flat, 160, 90)[0].values())) == {"0"}


def test_mirrored_frame_swaps_hashes():
    rgb = np.frombuffer(pixels.synthetic(1), np.uint8).reshape(240, 320, 4).astype(float)
    small = pixels.shrink(rgb, 0, 0, 320, 240)
    a, b = pixels.hashes(small), pixels.hashes(small[:, ::-1])
    assert a["fhash"] == b["hash"] and a["fdhash"] == b["dhash"]


def test_no_subtitles_below_the_limit():
    rng = np.random.default_rng(0)
    for _ in range(10):
        assert pixels.subtitle_mask(rng.integers(0, 180, (90, 160, 3)).astype(float)) is None


def test_subtitles_are_painted_over():
    rgb = np.full((120, 160, 3), 50.0)
    rgb[100:104, 60:100] = 255
    mask = pixels.subtitle_mask(rgb)
    assert (pixels.inpaint(rgb, mask) == 50).all()


def test_broken_frames_are_left_out(spark):
    rows = [("v", 1, 32, 24, bytearray(pixels.synthetic(0, 32, 24))), ("v", 2, 32, 24, bytearray(b"short")), ("v", 3, 32, 24, None)]
    out = pixels.fingerprints(spark.createDataFrame(rows, "video_id string, frameIndex int, width int, height int, rgba binary")).collect()
    assert [r["frameIndex"] for r in out] == [1] and out[0]["timestamp"] == 0.0


def test_pictures_are_made_and_used_a_few_at_a_time(spark):
    """Of a batch as Spark sends it, 10,000 rows, no more than FEW pictures or fingerprints are held."""
    import pandas as pd

    from framelake.operators import pixels
    from framelake.plans import views as V

    grids = spark.range(0, 300, 1, 1).selectExpr("id AS pos", "transform(sequence(0, 63), k -> (k * 37 + id * 11) % 900 - 400) AS q")
    size = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    assert [r["n"] for r in V.drawn(grids, size, "n bigint").collect()] == [64] * 4 + [44]
    frames = pd.concat(pd.DataFrame({"video_id": ["v"] * 150, "frameIndex": range(1, 151), "width": 16, "height": 16, "rgba": [bytes(1024)] * 150}) for _ in range(1))
    assert [len(b) for b in pixels.fingerprinted()([frames])] == [64, 64, 22]
    whole, drawn = pixels.fingerprints(V.drawn(grids)), V.drawn(grids, pixels.fingerprinted(), pixels.FINGERPRINT)
    rows = lambda df: sorted((r["frameIndex"], str(r)) for r in df.limit(40).collect())
    assert rows(whole) == rows(drawn)
