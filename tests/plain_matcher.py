"""The matching rules once more, frame by frame with whole numbers as bit sets: what the engine's segments are held against."""

import math

KINDS = ("hash", "dhash", "fhash", "fdhash")


def half_up(x):
    return math.floor(x + 0.5)


class Plain:
    def __init__(self, frames):
        """frames: (timestamp, variants, signature) in order."""
        self.times = [f[0] for f in frames]
        self.names = sorted(frames[0][1], key=lambda n: (n != "full", n))
        self.size = {k: next((len(v[k]) for n in self.names for v in [frames[0][1][n]] if v.get(k)), 0) for k in KINDS}
        self.bits = [[{k: int(f[1][n][k], 2) if f[1].get(n) and f[1][n].get(k) else 0 for k in KINDS} for n in self.names] for f in frames]
        self.colour, self.skin, self.detail = ([None if f[2] is None else f[2][c] for f in frames] for c in ("colorGrid", "skinScoreGrid", "detailGrid"))
        self.moving = len(frames) > 1 and all(c is not None and len(c) == 48 for c in self.colour)

    def __len__(self):
        return len(self.times)

    def change(self, k):
        d = [0.0] * 48 if k == 0 else [a - b for a, b in zip(self.colour[k], self.colour[k - 1], strict=True)]
        return d, math.sqrt(sum(x * x for x in d))


def pair(x, y, a_bits, d_bits, flip):
    def one(a, d):
        share = 1 - (x["hash"] ^ y[a]).bit_count() / a_bits
        return 0.55 * share + 0.45 * (1 - (x["dhash"] ^ y[d]).bit_count() / d_bits) if d_bits else share

    return max(one("hash", "dhash"), one("fhash", "fdhash")) if flip else one("hash", "dhash")


def standard(colour):
    out = [0.0] * 48
    for c in range(3):
        v = colour[c::3]
        mean = sum(v) / 16
        sd = math.sqrt(sum((x - mean) ** 2 for x in v) / 16)
        for i, x in enumerate(v):
            out[3 * i + c] = (x - mean) / max(sd, 8)
    return out


def mirrored(grid, width):
    return [grid[(r * 4 + 3 - c) * width + k] for r in range(4) for c in range(4) for k in range(width)]


def signature(s, i, m, j):
    a = (standard(s.colour[i]), s.skin[i], s.detail[i])

    def raw(colour, skin, detail):
        gap = lambda x, y: sum(abs(p - q) for p, q in zip(x, y, strict=True)) / len(x)
        top = max(1, max(a[2]), max(detail))
        return (max(0, 1 - gap(a[0], colour) / 2) + 1 - gap(a[1], skin) + 1 - gap(a[2], detail) / top) / 3 * 100

    b = (standard(m.colour[j]), m.skin[j], m.detail[j])
    return max(raw(*b), raw(mirrored(b[0], 3), mirrored(b[1], 1), mirrored(b[2], 1)))


class Match:
    def __init__(self, s, m, floor=82, least=9, drift=3):
        self.s, self.m, self.floor, self.least, self.drift = s, m, floor, least, drift
        self.d = s.size["dhash"] if s.size["dhash"] == m.size["dhash"] else 0
        self.flip = m.size["fhash"] > 0 and s.size["hash"] == m.size["hash"]
        self.fast_of, self.frame_of = {}, {}

    def pair(self, x, y):
        return pair(x, y, self.s.size["hash"], self.d, self.flip) * 100

    def fast(self, i, j):
        if (i, j) not in self.fast_of:
            self.fast_of[i, j] = max(self.pair(self.s.bits[i][0], y) for y in self.m.bits[j])
        return self.fast_of[i, j]

    def frame(self, i, j):
        if (i, j) not in self.frame_of:
            h = max(self.pair(x, y) for x in self.s.bits[i] for y in self.m.bits[j])
            if self.s.colour[i] is not None and self.m.colour[j] is not None:
                g, t = signature(self.s, i, self.m, j), -1
                if self.s.moving and self.m.moving and i and j:
                    (a, x), (b, y) = self.s.change(i), self.m.change(j)
                    t = 78 if x < 6 and y < 6 else 38 if x < 6 or y < 6 else (sum(p * q for p, q in zip(a, b, strict=True)) / (x * y) + 1) / 2 * 100
                h = 0.70 * h + 0.14 * g + 0.16 * t if t >= 0 else 0.84 * h + 0.16 * g
            self.frame_of[i, j] = h
        return self.frame_of[i, j]

    def chunks(self):
        s, cut = self.s, [0]
        for k in range(1, len(s)):
            x, y = s.bits[k][0], s.bits[k - 1][0]
            alike = lambda kind: (1 - (x[kind] ^ y[kind]).bit_count() / s.size[kind]) * 100  # noqa: B023, E731
            if alike("hash") < 25 or (s.size["dhash"] and alike("dhash") < 28) or (s.moving and s.change(k)[1] > 100):
                cut.append(k)
        return [(a, b - 1) for a, b in zip(cut, [*cut[1:], len(s)], strict=True)]

    def walk(self, si, mi, used, step, first, last):
        hits, at, misses, slope, i = [], (si, mi), 0, 1.0, si + step
        while first <= i <= last and i not in used:
            centre, half = at[1] + half_up(slope * (i - at[0])), min(18, 7 + self.drift + misses)
            window = range(max(0, centre - half), min(len(self.m) - 1, centre + half) + 1)
            if not window:
                break
            best = max(window, key=lambda j: (self.frame(i, j), -j))  # noqa: B023
            if self.frame(i, best) >= max(40, 50 - len(hits) // 25):
                hits.append((i, best, self.frame(i, best)))
                at, misses = (i, best), 0
                points = [(si, mi), *[h[:2] for h in hits[-25:]]]
                low, high = min(points), max(points)
                slope = 1.0 if len(points) < 4 or high[0] - low[0] < 3 else min(8, max(0.1, (high[1] - low[1]) / (high[0] - low[0])))
            else:
                misses += 1
                if misses >= 12:
                    break
            i += step
        return hits

    def path(self, si, mi, used, first, last):
        hits = [*self.walk(si, mi, used, -1, first, last)[::-1], (si, mi, self.frame(si, mi)), *self.walk(si, mi, used, 1, first, last)]
        out = hits[:1]
        for p, q in zip(hits, hits[1:], strict=False):
            if q[0] - p[0] in (2, 3):
                n = q[0] - p[0]
                out += [(p[0] + k, half_up(p[1] + k * (q[1] - p[1]) / n), (p[2] + q[2]) / 2) for k in range(1, n)]
            out.append(q)
        return out

    def candidates(self, si, floor):
        found = []
        for j in range(len(self.m)):
            v = self.fast(si, j)
            if v >= floor:
                if found and j - found[-1][0] < 50:
                    if v > found[-1][1]:
                        found[-1] = (j, v)
                else:
                    found.append((j, v))
        return sorted(found, key=lambda c: -c[1])[:8]

    def segments(self):
        """(approximate, path) in the order found."""
        used, out = set(), []
        for rough, floor in ((False, self.floor), (True, 40)):
            for first, last in self.chunks():
                free = [k for k in range(first, last + 1) if k not in used]
                best = None
                for spot in dict.fromkeys(first + half_up(k * (last - first) / 4) for k in range(5)) if free else ():
                    si = min(free, key=lambda x: (abs(x - spot), x < spot))  # noqa: B023
                    top = self.candidates(si, floor - 20)
                    if not top or top[0][1] < floor - 18:
                        continue
                    for mi, _ in top:
                        if self.frame(si, mi) >= floor:
                            p = self.path(si, mi, used, first, last)
                            key = (len(p), round(sum(x[2] for x in p) / len(p), 9))
                            if len(p) >= min(self.least, max(3, int((last - first + 1) * 0.4))) and (best is None or key > best[0]):
                                best = (key, p)
                if best:
                    used |= {p[0] for p in best[1]}
                    out.append((rough, best[1]))
        for first, last in self.chunks():
            free = [k for k in range(first, last + 1) if k not in used]
            if len(free) < 10:
                continue
            hits = [(i, *max(((j, self.frame(i, j)) for j in range(len(self.m))), key=lambda x: (x[1], -x[0]))) for i in free]
            if sum(h[2] for h in hits) / len(hits) < 65:
                continue
            groups = [[hits[0]]]
            for p, q in zip(hits, hits[1:], strict=False):
                if abs(q[1] - (p[1] + q[0] - p[0])) > 50:
                    groups.append([])
                groups[-1].append(q)
            out += [(True, g) for g in groups]
        return out
