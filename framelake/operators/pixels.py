"""Fingerprints of raw frames: crops, hashes and signatures, for whole Arrow batches of frames at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FINGERPRINT = (
    "video_id string, frameIndex int, timestamp double, variants map<string, struct<hash: string, dhash: string, fhash: string, fdhash: string>>, "
    "signature struct<colorGrid: array<double>, skinScoreGrid: array<double>, detailGrid: array<double>>"
)
SIDE, SMALL_HEIGHT = 16, 120
#: Frames whose results are held at a time: 13 variants of one are about 20 KB of text.
FEW = 64


def _even(x: float) -> int:
    return int(x) // 2 * 2


def crops(w: int, h: int) -> list[tuple[str, int, int, int, int]]:
    half_up = lambda x: int(np.floor(x + 0.5))
    out = [("full", 0, 0, w, h)]
    tall = _even(half_up(h * 9 / 16))
    for i in range(5):
        out.append((f"crop_9_16_{i}", _even(half_up(i * (w - tall) / 4)), 0, tall, h) if tall <= w else (f"crop_9_16_{i}", 0, 0, w, h))
    for zoom, name, places in ((1.25, "zoom_1_25", ("center", "left", "right")), (1.5, "zoom_1_5", ("center", "left", "right")), (2.0, "zoom_2_0", ("center",))):
        zw, zh = _even(half_up(w / zoom)), _even(half_up(h / zoom))
        sx = {"center": _even(half_up((w - zw) / 2)), "left": 0, "right": _even(w - zw)}
        out += [(f"{name}_{p}", sx[p], _even(half_up((h - zh) / 2)), zw, zh) for p in places]
    return out


def subtitle_mask(rgb: np.ndarray, force: bool = False) -> np.ndarray | None:
    """Bright pixels of the lowest quarter, widened by two; none if under 8 or over a quarter of it, unless forced."""
    low = int(0.75 * len(rgb))
    bright = np.zeros(rgb.shape[:2], bool)
    bright[low:] = (rgb[low:, :, 0] > 180) & (rgb[low:, :, 1] > 180)
    n = int(bright.sum())
    if not force and (n < 8 or n > 0.25 * bright[low:].size):
        return None
    out = bright.copy()
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            a = bright[max(0, -dy) : len(bright) - max(0, dy), max(0, -dx) : bright.shape[1] - max(0, dx)]
            out[max(0, dy) : len(bright) + min(0, dy), max(0, dx) : bright.shape[1] + min(0, dx)] |= a
    return out


def inpaint(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels take the nearest unmasked one above, where there is one."""
    rows = np.where(mask, -1, np.arange(len(rgb))[:, None])
    source = np.maximum.accumulate(rows, axis=0)
    picked = np.take_along_axis(rgb, np.maximum(source, 0)[:, :, None], axis=0)
    return np.where((source >= 0)[:, :, None], picked, rgb)


def process_subtitles(rgb: np.ndarray, force: bool = False) -> tuple[np.ndarray, bool]:
    """(picture without subtitles, whether it was gone over). Where too few or too many pixels are bright the picture stays as it is, unless
    forced: then whatever is bright goes."""
    mask = subtitle_mask(rgb, force)
    return (rgb, False) if mask is None else (inpaint(rgb, mask), True)


class Sums:
    """A picture's running sums down its columns, made once; area averages of its rectangles follow from them exactly."""

    def __init__(self, rgb: np.ndarray):
        self.down = np.zeros((len(rgb) + 1, rgb.shape[1], rgb.shape[2]))
        np.cumsum(rgb, axis=0, out=self.down[1:])

    def shrink(self, x: float, y: float, w: float, h: float, out_w: int = SIDE, out_h: int = SIDE) -> np.ndarray:
        """Area average of a rectangle, (out_h, out_w, channels)."""

        def at(edges: np.ndarray, t: np.ndarray) -> np.ndarray:
            low = np.minimum(edges.astype(int), len(t) - 2)
            part = (edges - low).reshape(-1, *[1] * (t.ndim - 1))
            return t[low] * (1 - part) + t[low + 1] * part

        rows = np.diff(at(y + h * np.arange(out_h + 1) / out_h, self.down), axis=0)
        across = np.zeros((rows.shape[1] + 1, out_h, rows.shape[2]))
        np.cumsum(rows.swapaxes(0, 1), axis=0, out=across[1:])
        cells = np.diff(at(x + w * np.arange(out_w + 1) / out_w, across), axis=0)
        return cells.swapaxes(0, 1) / ((w / out_w) * (h / out_h))


def shrink(rgb: np.ndarray, x: float, y: float, w: float, h: float, out_w: int = SIDE, out_h: int = SIDE) -> np.ndarray:
    """Area average of one rectangle of a picture."""
    return Sums(rgb).shrink(x, y, w, h, out_w, out_h)


def _strings(bits: np.ndarray) -> list[str]:
    flat = (bits.reshape(len(bits), -1).astype(np.uint8) + 48).tobytes().decode()
    n = len(flat) // max(1, len(bits))
    return [flat[k * n : (k + 1) * n] for k in range(len(bits))]


def _differences(g: np.ndarray) -> list[str]:
    n = len(g)
    return _strings(np.hstack([(g[:, :, 1:] > g[:, :, :-1]).reshape(n, -1), (g[:, 1:] > g[:, :-1]).reshape(n, -1)]))


_SIZES = np.pad(np.ones((SIDE, SIDE)), 1)


def _box(g: np.ndarray) -> np.ndarray:
    """Sums of 3 x 3 neighbourhoods of padded pictures, rows first."""
    rows = g[..., :-2, :] + g[..., 1:-1, :] + g[..., 2:, :]
    return rows[..., :-2] + rows[..., 1:-1] + rows[..., 2:]


def hashes_of(small: np.ndarray) -> list[dict[str, str]]:
    """Average and difference hashes of 16 x 16 pictures (n, 16, 16, channels), and of their mirror images; all zeros for flat ones."""
    gray = 0.299 * small[..., 0] + 0.587 * small[..., 1] + 0.114 * small[..., 2]
    flat = gray.var(axis=(1, 2)) < 1
    blurred = gray.astype(np.float32)
    for _ in range(3):
        blurred = (_box(np.pad(blurred.astype(np.float64), ((0, 0), (1, 1), (1, 1)))) / _box(_SIZES)).astype(np.float32)
    mean, mirrored = gray.mean(axis=(1, 2), keepdims=True), blurred[:, :, ::-1]
    columns = (_strings(blurred >= mean), _differences(blurred), _strings(mirrored >= mean), _differences(mirrored))
    return [{name: "0" * len(x) if zero else x for name, x in zip(("hash", "dhash", "fhash", "fdhash"), row, strict=True)} for *row, zero in zip(*columns, flat.tolist(), strict=True)]


def hashes(small: np.ndarray) -> dict[str, str]:
    """Those of one picture."""
    return hashes_of(small[None])[0]


def signature(small: np.ndarray) -> dict[str, list[float]]:
    cells = small.reshape(4, 4, 4, 4, -1).transpose(0, 2, 1, 3, 4).reshape(16, 16, -1)[:, :, :3]
    r, g, b = cells[:, :, 0], cells[:, :, 1], cells[:, :, 2]
    skin = (r > 80) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - b > 20)
    gray = 0.299 * r + 0.587 * g + 0.114 * b
    return {"colorGrid": cells.mean(axis=1).ravel().tolist(), "skinScoreGrid": skin.mean(axis=1).tolist(), "detailGrid": np.abs(gray - gray.mean(axis=1, keepdims=True)).mean(axis=1).tolist()}


def fingerprint(rgba: bytes, w: int, h: int) -> tuple[dict, dict]:
    """(variants, signature) of one frame. Subtitles are looked for at 120 lines; if some are removed, crops come from that picture."""
    rgb = np.frombuffer(rgba, np.uint8).reshape(h, w, -1)[:, :, :3]
    low_w = int(np.floor(w * SMALL_HEIGHT / h + 0.5))
    sums = Sums(rgb)
    low = sums.shrink(0, 0, w, h, low_w, SMALL_HEIGHT)
    mask = subtitle_mask(low)
    sums, fx, fy = (sums, 1.0, 1.0) if mask is None else (Sums(inpaint(low, mask)), low_w / w, SMALL_HEIGHT / h)
    places = crops(w, h)
    small = np.stack([sums.shrink(x * fx, y * fy, cw * fx, ch * fy) for _, x, y, cw, ch in places])
    return dict(zip([p[0] for p in places], hashes_of(small), strict=True)), signature(small[0])


def few(batches: Iterator[pd.DataFrame], rows: int = FEW) -> Iterator[pd.DataFrame]:
    """The same rows, a few at a time: what is made of a picture is large."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def fingerprinted(timed: bool = False, fps: float = 25.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What fingerprints() does to batches of frames, FEW rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few(batches):
            rows = []
            for r in b.itertuples(index=False):
                if r.rgba is None or len(r.rgba) != r.width * r.height * 4:
                    continue
                variants, sig = fingerprint(r.rgba, r.width, r.height)
                given = timed and not pd.isna(r.timestamp)
                rows.append((r.video_id, r.frameIndex, float(r.timestamp) if given else (r.frameIndex - 1) / fps, variants, sig))
            yield pd.DataFrame(rows, columns=["video_id", "frameIndex", "timestamp", "variants", "signature"])

    return run


def fingerprints(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    """Fingerprints of frames (video_id, frameIndex from 1, width, height, rgba); frames that can't be read are left out. A column
    `timestamp` (a decoder's own times, in seconds) is kept where it has a value; else times follow from the index."""
    return frames.mapInPandas(fingerprinted("timestamp" in frames.columns, fps), FINGERPRINT)


def synthetic(f: int, w: int = 320, h: int = 240) -> bytes:
    """A frame of whole-number formulas, for tests."""
    x, y = np.arange(w, dtype=np.uint32)[None, :], np.arange(h, dtype=np.uint32)[:, None]
    out = np.full((h, w, 4), 255, np.uint8)  # only the lowest eight bits count
    out[..., 0] = (x * np.uint32((f + 1) * 31) + y * np.uint32(97)) ^ np.uint32(f * 53)
    out[..., 1] = (y * np.uint32((f + 1) * 67) + x * np.uint32(41)) ^ np.uint32(f * 29)
    out[..., 2] = (x * y * np.uint32(7) + np.uint32(f * 113)) ^ np.uint32(128)
    return out.tobytes()
