"""Alignment of clips with reference videos: which stretches of a clip come from where.

Frames of the videos that are matched are packed once, about 3 KB a frame with 13 variants, and written in order. Matches whose reference is short (`in_one_task` frames)
run side by side, one task each; all others go through the stages of operators.bands, whose tasks hold a block or a band of the reference whatever its length. Both give
the same segments. Frames without variants are left out; a match without a segment has no rows. Segments of a match, a few each,
are then merged, de-duplicated and validated by the ordered operators.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.display import match_parameters
from framelake.operators import ordered
from framelake.stage import Stages

# Fixed values of the matching rules (survey P1-P8, A2-A9, W2).
LOOK_AHEAD, LOOK_AHEAD_MAX, MAX_MISSES = 7, 18, 12
WALK_MIN, WALK_FLOOR, WALK_STEP = 50, 40, 25
SLOPE_MIN, SLOPE_MAX = 0.1, 8.0
SEED_SEPARATION, SEED_CANDIDATES = 50, 8
FORCED_FRAMES, FORCED_MEAN, FORCED_JUMP = 10, 65, 50
#: Frames of a reference that all pairs of variants are compared with at a time.
SLICE = 512
#: Frames of a run, which is held by its first frame and how far the others are from that.
RUN = 16
#: The longest reference, in frames, that a match takes into one task: about 120 MB with 13 variants.
IN_ONE_TASK = 40_000
#: About so many frames of clips go to a task, which has their reference once.
CLIP_FRAMES = 2048
#: Scores of frames near walks are made so many positions at a time, or of all at hand up to WHOLE where a frame has few variants; at most KEPT are held.
NEAR, WHOLE, FEW_PAIRS, KEPT = 128, 1024, 16, 4_000_000

DETAIL = "struct<cropRegion: string, structureSim: double, colorSim: double, skinSim: double, detailSim: double, movieHash: string, shortHash: string>"
SEGMENT = (
    "match_id string, emit_seq int, shortStart double, shortEnd double, movieStart double, movieEnd double, confidence double, frameCount int, isApproximate boolean, gapCount int, "
    f"speedRatio double, matchSequence array<struct<shortTime: double, movieTime: double, similarity: double>>, bestFrameDetail {DETAIL}"
)
_COLUMNS = ["match_id", "emit_seq", "shortStart", "shortEnd", "movieStart", "movieEnd", "confidence", "frameCount", "isApproximate", "gapCount", "speedRatio", "matchSequence", "bestFrameDetail"]


def _round(x):
    return np.floor(np.asarray(x) + 0.5).astype(np.int64)


_KINDS = ("hash", "dhash", "fhash", "fdhash")
PACKED = (
    "video_id string, frameIndex int, timestamp double, layout string, words binary, colour array<double>, skin array<double>, detail array<double>"
)


def _pack_frame(variants) -> tuple[str, bytes] | None:
    """(names and sizes of a frame's hashes as JSON, their bits in whole words one after another); None without any hash. Maps keep no
    order: the variant named full is the first, then by name, so ties go to it."""
    v = {} if variants is None else dict(variants)
    names = sorted(v, key=lambda n: (n != "full", n))
    bits = [[(_field(v[n], key) if v[n] is not None else None) or "" for key in _KINDS] for n in names]
    if not any(b[0] for b in bits):
        return None
    text = "".join(x.ljust(-(-len(x) // 64) * 64, "0") for b in bits for x in b)
    layout = json.dumps([names, [[len(x) for x in b] for b in bits]])
    return layout, np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()


def packed(frames: DataFrame) -> DataFrame:
    """Fingerprint records with their hashes as bits, before they are shuffled: about an eighth of the size. Frames without variants go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_pack_frame(v) for v in b["variants"]]
            some = np.array([g is not None for g in got], bool)
            if some.any():
                out = b.loc[some].drop(columns="variants").astype({"video_id": object})
                yield out.assign(layout=[g[0] for g in got if g], words=[g[1] for g in got if g])

    grids = (F.col(f"signature.{c}").alias(n) for c, n in (("colorGrid", "colour"), ("skinScoreGrid", "skin"), ("detailGrid", "detail")))
    return frames.select("video_id", "frameIndex", "timestamp", "variants", *grids).mapInPandas(run, PACKED)


def flip_cells(grid: np.ndarray, values: int) -> np.ndarray:
    return grid.reshape(*grid.shape[:-1], 4, 4, values)[..., ::-1, :].reshape(grid.shape)


@dataclass
class Video:
    """A video's frames in order, packed: all of them, or those from position `start` on of a video of `total` frames. Positions count from the video's first frame."""

    time: np.ndarray
    names: list[str]
    a: np.ndarray
    a_bits: int
    fa: np.ndarray | None = None
    d: np.ndarray | None = None
    d_bits: int = 0
    fd: np.ndarray | None = None
    has_signature: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    colour: np.ndarray | None = None
    skin: np.ndarray | None = None
    detail: np.ndarray | None = None
    delta: np.ndarray | None = None
    mag: np.ndarray | None = None
    start: int = 0
    total: int = 0
    far: dict = field(default_factory=dict)  # what Scores finds out about runs of these frames, once for all clips

    @staticmethod
    def of(rows: pd.DataFrame, first: str | None = None, total: int | None = None, coloured: bool | None = None) -> Video | None:
        """From packed records; None if there are none. The first frame says which variants there are and how long hashes are; what other
        frames lack, or have in another length, counts as zeros. Of a part (records with neighbouring `pos`): first, total, coloured say the layout of the video's
        first frame, its frames, and whether all have colours; the part's own first frame is only there for the change from it."""
        if not len(rows):
            return None
        rows = rows.sort_values("frameIndex" if total is None else "pos", kind="stable")
        n, layouts, words = len(rows), rows["layout"].tolist(), rows["words"].tolist()
        names, sizes = json.loads(layouts[0] if first is None else first)
        k, want = len(names), [next((s[j] for s in sizes if s[j]), 0) for j in range(len(_KINDS))]
        start = np.cumsum([0, *(-(-w // 64) for w in want)])
        whole, first = all(s == want for s in sizes), layouts[0] if first is None else first
        alike = whole and all(x == first for x in layouts)
        table = np.frombuffer(b"".join(words), np.uint64).reshape(n, k, -1) if alike else np.zeros((n, k, start[-1]), np.uint64)
        place, read = {name: i for i, name in enumerate(names)}, {}
        for f in range(0 if alike else n):
            got = np.frombuffer(words[f], np.uint64)
            if whole and layouts[f] == first:
                table[f] = got.reshape(k, -1)
                continue
            if layouts[f] not in read:
                read[layouts[f]] = json.loads(layouts[f])
            own, lengths = read[layouts[f]]
            at = 0
            for name, length in zip(own, lengths, strict=True):
                for j, size in enumerate(length):
                    m = -(-size // 64)
                    if size and size == want[j] and name in place:
                        table[f, place[name], start[j] : start[j + 1]] = got[at : at + m]
                    at += m
        a, d, fa, fd = (np.ascontiguousarray(table[:, :, start[j] : start[j + 1]]) if want[j] else None for j in range(len(_KINDS)))
        out = Video(rows["timestamp"].to_numpy(float), names, a, want[0], fa, d, want[1], fd)
        out.start, out.total = (0, n) if total is None else (int(rows["pos"].iloc[0]), total)
        ok = np.array([_length(c) == 48 for c in rows["colour"]])
        out.has_signature = ok
        grid = lambda key, size: np.stack([np.asarray(x, float) if good else np.zeros(size) for x, good in zip(rows[key], ok, strict=True)])
        raw = grid("colour", 48)
        channels = raw.reshape(n, 16, 3)
        out.colour = ((channels - channels.mean(axis=1, keepdims=True)) / np.maximum(channels.std(axis=1, keepdims=True), 8)).reshape(n, 48)
        out.skin, out.detail = grid("skin", 16), grid("detail", 16)
        if (ok.all() if coloured is None else coloured) and out.total > 1:  # one frame without colours turns the channel off
            out.delta = np.diff(raw, axis=0, prepend=raw[:1])
            out.mag = np.sqrt((out.delta**2).sum(axis=1))
        return out

    def __len__(self) -> int:
        return self.total

    def holds(self, low: int, high: int) -> bool:
        """Whether the frames from low to high are here, with the one before, if there is any, for the change from it."""
        return self.start <= max(0, low - 1) and high < self.start + len(self.time)

    def hash_of(self, k: int) -> str:
        """Bits of a frame's first variant."""
        return "".join(map(str, np.unpackbits(self.a[k - self.start, 0].view(np.uint8))[: self.a_bits]))


def _field(x, key: str):
    return x.get(key) if isinstance(x, dict) else getattr(x, key, None)


def _length(x) -> int:
    return 0 if x is None else len(x)


class LeftBand(Exception):
    """A comparison asks for frames that are not in the part of the video at hand."""


class Scores:
    """Similarities in percent between frames of a clip and of a reference, by their positions."""

    def __init__(self, clip: Video, movie: Video):
        self.s, self.m = clip, movie
        self.use_d = clip.d is not None and movie.d is not None and clip.d_bits == movie.d_bits
        self.use_flip = movie.fa is not None and clip.a_bits == movie.a_bits
        self.seen = self.opened = 0  # frames asked for in long scans, and those of them that were compared
        self._near: dict[tuple[int, int], np.ndarray] = {}
        self._held = 0

    @property
    def far(self) -> np.ndarray:
        """Of each run of the reference's frames at hand: the greatest distance, over all variants, between its first frame and another, in the measure of pairs (a weighted sum of
        shares of differing bits, so the triangle inequality holds: no frame of the run is more like any frame than its first is, plus this)."""
        key = self.use_d, self.use_flip
        if key not in self.m.far:
            m, n = self.m, len(self.m.time)
            first = np.arange(n) // RUN * RUN
            kinds = [(m.a, m.d)] + [(m.fa, m.fd)] * self.use_flip
            off = np.zeros(n)
            for a, d in kinds:
                for part in range(0, n, 16 * SLICE):
                    own = slice(part, part + 16 * SLICE)
                    x = np.bitwise_count(a[own] ^ a[first[own]]).sum(axis=2, dtype=np.int64) / m.a_bits
                    if self.use_d and d is not None:
                        x = 0.55 * x + 0.45 * np.bitwise_count(d[own] ^ d[first[own]]).sum(axis=2, dtype=np.int64) / m.d_bits
                    off[own] = np.maximum(off[own], x.max(axis=1))
            m.far[key] = np.maximum.reduceat(off, np.arange(0, n, RUN)) + 1e-9 if n else off
        return self.m.far[key]

    def pairs(self, si: int, mi: np.ndarray, every: bool) -> np.ndarray:
        """(positions, clip variants, movie variants): each pair of variants, the better of normal and mirrored. Clip variants: all, or the one
        named full (the first, without one)."""
        full = self.s.names.index("full") if "full" in self.s.names else 0
        own = slice(None) if every else slice(full, full + 1)
        si, mi = si - self.s.start, mi - self.m.start

        def share(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
            one, other = a[si, own], b[mi]
            off = np.zeros((len(mi), len(one), other.shape[1]), np.uint16)
            for w in range(a.shape[2]):
                off += np.bitwise_count(one[None, :, None, w] ^ other[:, None, :, w])
            return 1 - off.astype(float) / bits

        def pair(a: np.ndarray, d: np.ndarray | None) -> np.ndarray:
            out = share(self.s.a, a, self.s.a_bits)
            return 0.55 * out + 0.45 * share(self.s.d, d, self.s.d_bits) if self.use_d and d is not None else out

        best = pair(self.m.a, self.m.d)
        if self.use_flip:
            best = np.maximum(best, pair(self.m.fa, self.m.fd))
        return best

    def structure(self, si: int, mi: np.ndarray, every: bool) -> np.ndarray:
        """Percent: the best pair of variants."""
        step = SLICE if every else 16 * SLICE
        return np.concatenate([self.pairs(si, mi[a : a + step], every).reshape(len(mi[a : a + step]), -1).max(axis=1) for a in range(0, len(mi), step)]) * 100

    def fast(self, si: int, floor: float = 0.0) -> np.ndarray:
        """Of all frames of the reference that are here. Runs of which none can reach the floor are 0."""
        n = len(self.m.time)
        may = (self.structure(si, np.arange(0, n, RUN) + self.m.start, every=False) / 100 + self.far) * 100 >= floor
        at = np.flatnonzero(np.repeat(may, RUN)[:n])
        self.seen, self.opened = self.seen + n, self.opened + len(at)
        out = np.zeros(n)
        out[at] = self.structure(si, at + self.m.start, every=False)
        return out

    def signature(self, si: int, mi: np.ndarray) -> np.ndarray:
        s, m = self.s, self.m
        si, mi = si - s.start, mi - m.start

        def raw(colour: np.ndarray, skin: np.ndarray, detail: np.ndarray) -> np.ndarray:
            c = np.maximum(0, 1 - np.abs(s.colour[si] - colour).mean(axis=1) / 2)
            k = 1 - np.abs(s.skin[si] - skin).mean(axis=1)
            top = np.maximum(1, np.maximum(s.detail[si].max(), detail.max(axis=1)))
            return (c + k + 1 - np.abs(s.detail[si] - detail).mean(axis=1) / top) / 3 * 100

        return np.maximum(raw(m.colour[mi], m.skin[mi], m.detail[mi]), raw(flip_cells(m.colour[mi], 3), flip_cells(m.skin[mi], 1), flip_cells(m.detail[mi], 1)))

    def temporal(self, si: int, mi: np.ndarray) -> np.ndarray:
        if self.s.delta is None or self.m.delta is None or si == 0:
            return np.full(len(mi), -1.0)
        own, at = si - self.s.start, mi - self.m.start
        a, b = self.s.mag[own], self.m.mag[at]
        cosine = (self.m.delta[at] * self.s.delta[own]).sum(axis=1) / np.maximum(a * b, 1e-12)  # row by row: a product's last bits would depend on its neighbours
        out = np.where((a < 6) & (b < 6), 78.0, np.where((a < 6) | (b < 6), 38.0, (cosine + 1) / 2 * 100))
        return np.where(mi == 0, -1.0, out)

    def frame(self, si: int, mi: np.ndarray) -> np.ndarray:
        h = self.structure(si, mi, every=True)
        if not self.s.has_signature[si - self.s.start]:
            return h
        g, t = self.signature(si, mi), self.temporal(si, mi)
        both = np.where(t >= 0, 0.70 * h + 0.14 * g + 0.16 * t, 0.84 * h + 0.16 * g)
        return np.where(self.m.has_signature[mi - self.m.start], both, h)

    def best(self, si: int, mi: np.ndarray) -> tuple[float, int]:
        """The best score and its place, the first on ties; a score of 0 is none."""
        if not (self.s.holds(si, si) and self.m.holds(int(mi[0]), int(mi[-1]))):
            raise LeftBand
        if len(mi) > 8 * RUN:
            return self._best_of_runs(si, int(mi[0]), int(mi[-1]))
        s = self.near(si, int(mi[0]), int(mi[-1]))
        k = int(s.argmax())
        return (float(s[k]), int(mi[k])) if s[k] > 0 else (0.0, -1)

    def near(self, si: int, low: int, high: int) -> np.ndarray:
        """frame() of the positions from low to high, made a block at a time and kept: walks from other candidates ask for the same frames again."""
        n, start = len(self.m.time), self.m.start
        step = n if n <= WHOLE and len(self.s.names) * len(self.m.names) <= FEW_PAIRS else NEAR
        first, parts = (low - start) // step, []
        for k in range(first, (high - start) // step + 1):
            if (si, k) not in self._near:
                if self._held > KEPT:
                    self._near.clear()
                    self._held = 0
                self._near[si, k] = self.frame(si, np.arange(k * step, min(n, (k + 1) * step)) + start)
                self._held += step
            parts.append(self._near[si, k])
        s = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = start + first * step
        return s[low - at : high + 1 - at]

    def _best_of_runs(self, si: int, low: int, high: int) -> tuple[float, int]:
        """best() of the frames from low to high: runs by what they can reach at most, until that is less than the best so far."""
        start = self.m.start
        runs = np.arange((low - start) // RUN, (high - start) // RUN + 1)
        h = np.minimum(1.0, self.structure(si, runs * RUN + start, every=True) / 100 + self.far[runs]) * 100
        most = np.maximum(h, np.maximum(0.84 * h + 16, 0.70 * h + 30)) if self.s.has_signature[si - self.s.start] else h
        order = np.argsort(-most, kind="stable")
        best, at = 0.0, -1
        self.seen += high - low + 1
        k, step = 0, 2
        while k < len(order) and most[order[k]] >= best:
            some = order[k : k + step]
            some = some[most[some] >= best]
            k, step = k + step, min(2 * step, SLICE // RUN)
            mi = np.sort((runs[some][:, None] * RUN + np.arange(RUN)).ravel()) + start
            mi = mi[(mi >= low) & (mi <= high)]
            self.opened += len(mi)
            s = self.frame(si, mi)
            top = int(s.argmax())
            if s[top] > best or (at >= 0 and s[top] == best and mi[top] < at):
                best, at = float(s[top]), int(mi[top])
        return best, at


def cuts_of(v: Video) -> np.ndarray:
    """Where the picture changes, of the frames at hand: little structure in common with the frame before, or a large change of colour."""
    out = np.zeros(len(v.time), bool)
    if len(out) > 1:
        a = 1 - np.bitwise_count(v.a[1:, 0] ^ v.a[:-1, 0]).sum(axis=1, dtype=np.int64) / v.a_bits
        out[1:] = a * 100 < 25
        if v.d is not None:
            out[1:] |= (1 - np.bitwise_count(v.d[1:, 0] ^ v.d[:-1, 0]).sum(axis=1, dtype=np.int64) / v.d_bits) * 100 < 28
        if v.mag is not None:
            out[1:] |= v.mag[1:] > 100
    return out


def _clamp(x: float) -> float:
    return min(SLOPE_MAX, max(SLOPE_MIN, x))


def recent_slope(path: list[tuple], seed: tuple) -> float:
    points = [seed, *path[-25:]]
    low, high = min(points, key=lambda p: p[0]), max(points, key=lambda p: p[0])
    if len(points) < 4 or high[0] - low[0] < 3:
        return 1.0
    return _clamp((high[1] - low[1]) / (high[0] - low[0]))


def regression_slope(path: list[tuple]) -> float:
    x, y = np.array([p[0] for p in path], float), np.array([p[1] for p in path], float)
    if len(x) < 2 or x.min() == x.max():
        return 1.0
    x = x - x.mean()
    return _clamp(float((x * (y - y.mean())).sum() / (x * x).sum()))


def walk(score: Scores, seed: tuple[int, int], used: set[int] | frozenset[int], step: int, drift: int, first: int, last: int) -> list[tuple]:
    """Hits (si, mi, sim) from the seed in one direction, inside the chunk. used: positions of the clip that are taken."""
    hits: list[tuple] = []
    at, misses, slope = seed, 0, 1.0
    n = len(score.m)
    si = seed[0] + step
    while first <= si <= last and si not in used:
        centre = at[1] + int(_round(slope * (si - at[0])))
        half = min(LOOK_AHEAD_MAX, LOOK_AHEAD + drift + misses)
        low, high = max(0, centre - half), min(n - 1, centre + half)
        if low > high:
            break
        sim, mi = score.best(si, np.arange(low, high + 1))
        if mi >= 0 and sim >= max(WALK_FLOOR, WALK_MIN - len(hits) // WALK_STEP):
            hits.append((si, mi, sim))
            at, misses = (si, mi), 0
            slope = recent_slope(hits, seed)
        else:
            misses += 1
            if misses >= MAX_MISSES:
                break
        si += step
    return hits


def fill_gaps(path: list[tuple], most: int = 2) -> list[tuple]:
    out = path[:1]
    for p, q in zip(path, path[1:], strict=False):
        span = q[0] - p[0]
        if 1 < span <= most + 1:
            out += [(p[0] + k, int(_round(p[1] + k * (q[1] - p[1]) / span)), (p[2] + q[2]) / 2) for k in range(1, span)]
        out.append(q)
    return out


class Clusters:
    """Candidates of a seed, from scores in order of position: one nearer than SEED_SEPARATION to the present cluster's representative replaces it if better, and so
    moves it. Only the present one and the best so far are held."""

    def __init__(self):
        self.now: tuple[int, float] | None = None
        self.past: list[tuple[int, float]] = []

    def add(self, at: np.ndarray, sim: np.ndarray) -> None:
        i = 0
        while i < len(at):
            if self.now is None or at[i] - self.now[0] >= SEED_SEPARATION:
                self._close()
                self.now = (int(at[i]), float(sim[i]))
                i += 1
                continue
            j = int(np.searchsorted(at, self.now[0] + SEED_SEPARATION))
            better = np.flatnonzero(sim[i:j] > self.now[1])
            if len(better):
                i += int(better[0])
                self.now = (int(at[i]), float(sim[i]))
                i += 1
            else:
                i = j

    def _close(self) -> None:
        if self.now is not None:
            self.past.append(self.now)
        if len(self.past) > 16 * SEED_CANDIDATES:
            self.past = sorted(self.past, key=lambda c: (-c[1], c[0]))[:SEED_CANDIDATES]

    def best(self) -> list[tuple[int, float]]:
        """Best first, eight at most; the lower position on ties."""
        self._close()
        self.now = None
        return sorted(self.past, key=lambda c: (-c[1], c[0]))[:SEED_CANDIDATES]


def candidates(s: np.ndarray, floor: float) -> list[tuple[int, float]]:
    """The best of each cluster of positions that reach the floor."""
    at, found = np.flatnonzero(s >= floor), Clusters()
    found.add(at, s[at])
    return found.best()


def seeds_of(first: int, last: int, used: set[int] | frozenset[int]) -> list[int]:
    """Positions at 0, 25, 50, 75 and 100 % of a chunk, each once, moved to the nearest free one, the later on ties."""
    free = [k for k in range(first, last + 1) if k not in used]
    spots = dict.fromkeys(first + int(_round(k * (last - first) / 4)) for k in range(5))
    return [min(free, key=lambda x: (abs(x - seed), x < seed)) for seed in spots] if free else []


def trace(score: Scores, seed: tuple[int, int], used: set[int] | frozenset[int], drift: int, first: int, last: int, floor: float) -> list[tuple] | None:
    """The path through a candidate, both ways and gaps filled; None if the pair itself doesn't reach the floor."""
    sim, _ = score.best(seed[0], np.array([seed[1]]))
    if sim < floor:
        return None
    back = walk(score, seed, used, -1, drift, first, last)
    return fill_gaps([*back[::-1], (*seed, sim), *walk(score, seed, used, 1, drift, first, last)])


def enough(first: int, last: int, min_frames: int) -> int:
    """Frames that a path in this chunk needs."""
    return min(min_frames, max(3, int((last - first + 1) * 0.4)))


def align(clip: Video, movie: Video, min_similarity: float, min_frames: int, drift: int) -> list[dict]:
    """Segments of one match, in the order found."""
    score, found = Scores(clip, movie), []
    cut = cuts_of(clip)
    starts = np.flatnonzero(np.append(True, cut[1:])) if len(clip) else []
    chunks = [(int(a), int(b) - 1) for a, b in zip(starts, np.append(starts[1:], len(clip)), strict=True)]
    used: set[int] = set()

    def keep(path: list[tuple], approximate: bool) -> None:
        used.update(p[0] for p in path)
        found.append(_segment(score, path, approximate))

    for approximate, floor in ((False, min_similarity), (True, 40)):
        for first, last in chunks:
            best, best_key = None, (0, 0.0)
            for si in seeds_of(first, last, used):
                top = candidates(score.fast(si, floor - 20), floor - 20)
                if not top or top[0][1] < floor - 18:
                    continue
                for mi, _ in top:
                    path = trace(score, (si, mi), used, drift, first, last, floor)
                    key = (len(path), float(np.mean([p[2] for p in path]))) if path else (0, 0.0)
                    if path and len(path) >= enough(first, last, min_frames) and (best is None or key > best_key):
                        best, best_key = path, key
            if best:
                keep(best, approximate)
    everywhere = np.arange(len(movie))
    for first, last in chunks:
        free = [k for k in range(first, last + 1) if k not in used]
        if len(free) < FORCED_FRAMES:
            continue
        hits = [(si, *score.best(si, everywhere)[::-1]) for si in free]
        hits = [h for h in hits if h[1] >= 0]
        if len(hits) < FORCED_FRAMES or np.mean([h[2] for h in hits]) < FORCED_MEAN:
            continue
        group = [hits[0]]
        for p, q in zip(hits, hits[1:], strict=False):
            if abs(q[1] - (p[1] + q[0] - p[0])) > FORCED_JUMP:
                keep(group, True)
                group = []
            group.append(q)
        keep(group, True)
    return found


def path_end(path: list[tuple], frames: int) -> tuple[float, int]:
    """(speed, position of the last frame in the reference): by the slope, unless that is where the path ends anyway."""
    first, last = path[0], path[-1]
    ratio = regression_slope(path)
    end = first[1] + int(_round(ratio * (last[0] - first[0])))
    return ratio, min(max(end, 0), frames - 1) if abs(end - last[1]) > 1 else last[1]


def _segment(score: Scores, path: list[tuple], approximate: bool) -> dict:
    clip, movie = score.s, score.m
    first, last = path[0], path[-1]
    ratio, end = path_end(path, len(movie))
    top = max(path, key=lambda p: p[2])
    return {
        "shortStart": clip.time[first[0]],
        "shortEnd": clip.time[last[0]],
        "movieStart": movie.time[first[1]],
        "movieEnd": movie.time[end],
        "confidence": float(np.mean([p[2] for p in path])),
        "frameCount": len(path),
        "isApproximate": approximate,
        "gapCount": last[0] - first[0] + 1 - len({p[0] for p in path}),
        "speedRatio": ratio,
        "matchSequence": [{"shortTime": clip.time[s], "movieTime": movie.time[m], "similarity": float(v)} for s, m, v in path],
        "bestFrameDetail": detail_of(score, top[0], top[1]),
    }


def detail_of(score: Scores, si: int, mi: int) -> dict:
    """Similarities of one pair of frames by channel (50 where a frame has no signature), and the crop of the reference that fits best."""
    s, m, place = score.s, score.m, np.array([mi])
    pairs = score.pairs(si, place, every=True)[0]
    name = m.names[int(pairs.argmax()) % pairs.shape[1]] if pairs.max() > 0 else "full"
    colour = skin = detail = 50.0
    own, at = si - s.start, mi - m.start
    if s.has_signature[own] and m.has_signature[at]:
        gap = lambda a, b: float(np.abs(a - b).mean())
        top = max(1.0, float(s.detail[own].max()), float(m.detail[at].max()))
        colour, skin, detail = (100 * min(1.0, max(0.0, 1 - x)) for x in (gap(s.colour[own], m.colour[at]) / 2, gap(s.skin[own], m.skin[at]), gap(s.detail[own], m.detail[at]) / top))
    return {
        "cropRegion": crop_name(name), "structureSim": float(pairs.max()) * 100, "colorSim": colour, "skinSim": skin, "detailSim": detail, "movieHash": m.hash_of(mi), "shortHash": s.hash_of(si),
    }


def crop_name(name: str) -> str:
    """What people read for a variant's name."""
    kind, *rest = name.split("_")
    if kind == "crop" and len(rest) == 3:
        return f"{rest[0]}:{rest[1]} Crop {int(rest[2]) + 1}"
    if kind == "zoom" and len(rest) == 3:
        return f"Zoom {rest[0]}.{rest[1]}x {rest[2].capitalize()}"
    return "Full Frame" if name == "full" else name


@dataclass
class Index:
    """Packed records with `pos` from 0 in each video, and a row for each video: video_id, total, first (the first frame's layout), coloured (whether all frames are)."""

    frames: DataFrame
    videos: DataFrame


def index_frames(frames: DataFrame, videos: DataFrame | None, stages: Stages) -> Index:
    """Of the videos listed (video_id), or of all: packed once and written in order. A long video lies in many partitions; positions come from the partitions' counts."""
    wanted = packed(frames if videos is None else frames.join(videos.select("video_id").distinct(), "video_id", "left_semi"))
    at = F.monotonically_increasing_id()
    rows = stages.written(wanted.repartitionByRange("video_id", "frameIndex").sortWithinPartitions("video_id", "frameIndex").withColumn("at", at))
    part = F.shiftright("at", 33).alias("part")
    runs = rows.groupBy("video_id", part).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("video_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stages.written(runs.select("video_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")))
    index = rows.withColumn("part", part).join(runs, ["video_id", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    about = rows.groupBy("video_id").agg(F.count("*").alias("total"), F.min_by("layout", "at").alias("first"), F.bool_and(F.coalesce(F.size("colour") == 48, F.lit(False))).alias("coloured"))
    return Index(index, stages.written(about))


def save_index(frames: DataFrame, name: str, buckets: int = 64) -> None:
    """Packs the frames of all videos once, for any number of matches: tables name_frames, bucketed and sorted by video, and name_videos."""
    stages = Stages(frames.sparkSession)
    made = index_frames(frames, None, stages)
    made.frames.repartition(buckets, "video_id").write.mode("overwrite").bucketBy(buckets, "video_id").sortBy("video_id", "pos").saveAsTable(f"{name}_frames")
    made.videos.write.mode("overwrite").saveAsTable(f"{name}_videos")
    stages.clear()


def load_index(spark: SparkSession, name: str, pairs: DataFrame, most: int = 1000) -> Index:
    """A saved index, for these pairs: with at most `most` videos among them, only their buckets are read; a join by video doesn't shuffle the frames in any case."""
    listed = pairs.select(F.explode(F.array("clip_id", "movie_id")).alias("video_id")).distinct()
    few = [r["video_id"] for r in listed.limit(most + 1).collect()]
    frames = spark.table(f"{name}_frames")
    frames = frames.filter(F.col("video_id").isin(few)) if len(few) <= most else frames.join(listed, "video_id", "left_semi")
    return Index(frames, spark.table(f"{name}_videos").join(listed, "video_id", "left_semi"))


def find_segments(pairs: DataFrame, frames: DataFrame | Index, min_similarity: float = 82, min_frames: int = 9, drift: int = 3, in_one_task: int = IN_ONE_TASK, stages: Stages | None = None) -> DataFrame:
    """Raw segments of each pair (match_id, clip_id, movie_id), written; frames: video_id and the fingerprint columns, or a loaded index."""
    from framelake.operators import bands

    limits = match_parameters(min_similarity, min_frames, drift)
    stages = stages or Stages(pairs.sparkSession)
    index = frames if isinstance(frames, Index) else index_frames(frames, pairs.select(F.explode(F.array("clip_id", "movie_id")).alias("video_id")), stages)
    total = index.videos.select(F.col("video_id").alias("movie_id"), "total")
    own = index.videos.select(F.col("video_id").alias("clip_id"), F.col("total").alias("clip_total"))
    sized = stages.written(pairs.select("match_id", "clip_id", "movie_id").join(total, "movie_id").join(own, "clip_id"))
    short, long = sized.filter(F.col("total") <= in_one_task), sized.filter(F.col("total") > in_one_task)
    found = stages.written(_in_one_task(short, index.frames, limits))
    return found if long.isEmpty() else found.unionByName(bands.find_segments(long, index.frames, index.videos, limits, stages))


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows by key, in as many partitions as shuffles have: a group's work, not its size, is what counts, so small groups are not packed together."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *key)


def _in_one_task(pairs: DataFrame, index: DataFrame, limits: tuple) -> DataFrame:
    """A task has a reference, unpacked once, and the clips of up to about CLIP_FRAMES frames that are matched with it."""
    shares = pairs.groupBy("movie_id").agg(F.ceil(F.sum("clip_total") / CLIP_FRAMES).cast("int").alias("shares"))
    asked = pairs.join(shares, "movie_id").select("match_id", "movie_id", F.col("clip_id").alias("video_id"), F.pmod(F.xxhash64("match_id"), F.col("shares")).cast("int").alias("share"))
    asked = asked.join(index, "video_id")
    movies = index.withColumnRenamed("video_id", "movie_id").join(shares, "movie_id").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    key, kept = ["movie_id", "share"], ["frameIndex", "timestamp", "layout", "words", "colour", "skin", "detail"]
    anew = lambda rows, *columns: spread(rows.select(*[F.col(c).alias(c) for c in columns]), *key).groupBy(*key)

    def run(clips: pd.DataFrame, movie: pd.DataFrame) -> pd.DataFrame:
        rows, reference = [], Video.of(movie)
        for match, clip in clips.groupby("match_id", sort=False, dropna=False) if reference is not None else ():
            rows += [{"match_id": match, "emit_seq": k, **r} for k, r in enumerate(align(Video.of(clip), reference, *limits))]
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"match_id": object})

    return anew(asked, "match_id", *key, *kept).cogroup(anew(movies, *key, *kept)).applyInPandas(run, SEGMENT)


def match_videos(pairs: DataFrame, frames: DataFrame | Index, min_similarity: float = 82, min_frames: int = 9, drift: int = 3, in_one_task: int = IN_ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(segments, unmatched): final segments of each match, and the clip's stretches that none of them uses. The raw segments are found, and written, here. Of a loaded index
    frames without hashes are not known, so they are in no unmatched stretch."""
    raw = find_segments(pairs, frames, min_similarity, min_frames, drift, in_one_task).filter("frameCount > 0")
    us = lambda c: F.floor(F.col(c) * 1_000_000 + 0.5).cast("bigint")  # noqa: E731  times come in whole microseconds
    base = raw.select(
        "match_id", F.col("emit_seq").cast("bigint").alias("seg_id"), us("shortStart").alias("ss"), us("shortEnd").alias("se"), us("movieStart").alias("ms"), us("movieEnd").alias("me"),
        F.col("confidence").alias("conf"), F.col("frameCount").cast("bigint").alias("frames"), F.col("gapCount").cast("bigint").alias("gaps"), F.col("speedRatio").alias("ratio"), F.col("isApproximate").alias("approx"), "matchSequence", "bestFrameDetail",
    )
    merged = ordered.merge_adjacent(base, "match_id", per_ms=1000).withColumn("seg_id", F.col("group").cast("bigint"))
    final = ordered.validate_context(ordered.drop_overlaps(merged, "match_id", most=150_000), "match_id", per_ms=1000)
    seconds = lambda c, name: (F.col(c) / 1_000_000).alias(name)
    out = final.select(
        "match_id",
        seconds("ss", "shortStart"),
        seconds("se", "shortEnd"),
        seconds("ms", "movieStart"),
        seconds("me", "movieEnd"),
        F.col("conf").alias("confidence"),
        F.col("frames").alias("frameCount"),
        F.col("approx").alias("isApproximate"),
        F.col("gaps").alias("gapCount"),
        F.col("ratio").alias("speedRatio"),
        "matchSequence",
        "bestFrameDetail",
    )
    # A clip frame is used if a final segment's sequence holds its time, to four digits.
    key = lambda c: F.format_string("%.4f", c)
    used = final.select("match_id", F.explode("matchSequence").alias("q")).select("match_id", key(F.col("q.shortTime")).alias("k")).distinct()
    clip = pairs.select("match_id", F.col("clip_id").alias("video_id")).join((frames.frames if isinstance(frames, Index) else frames).select("video_id", "frameIndex", "timestamp"), "video_id")
    clip = ordered.with_position(clip, "match_id", "frameIndex").withColumn("k", key(F.col("timestamp")))
    rest = ordered.runs_of(clip.join(used, ["match_id", "k"], "left_anti"), "match_id", "timestamp")
    return out, rest.select("match_id", F.col("start").alias("shortStart"), F.col("end").alias("shortEnd"))
