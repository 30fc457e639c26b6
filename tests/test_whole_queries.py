"""Queries over whole tables against brute force, beside their SQL."""

from collections import defaultdict

from framelake.plans import catalogue
from framelake.plans import views as V


def _by_match(spark, sf):
    groups = defaultdict(list)
    for r in V.segments(spark, sf).collect():
        groups[r["match_id"]].append(r)
    return groups


def test_every_segment_is_deduplicated(spark, sf):
    want = set()
    for match, rows in _by_match(spark, sf).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["conf"], r["ss"], r["seg_id"])):
            if all(min(k["se"], r["se"]) - max(k["ss"], r["ss"]) <= 150 for k in kept):
                kept.append(r)
        want |= {(match, r["seg_id"], r["conf"]) for r in kept}
    got = [tuple(r) for r in catalogue.QUERIES["dedup_segments"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_every_segment_meets_its_context(spark, sf):
    near = lambda gap: -1000 <= gap <= 10000
    want = set()
    for match, rows in _by_match(spark, sf).items():
        rows.sort(key=lambda r: (r["ss"], r["seg_id"]))
        last = None
        for r, after in zip(rows, [*rows[1:], None], strict=True):
            sure = not r["approx"] or r["conf"] >= 80 or r["frames"] >= 20 or len(rows) <= 1
            beside = after is not None and after["conf"] >= 85 and near(after["ms"] - r["me"])
            behind = last is not None and last["conf"] >= 85 and near(r["ms"] - last["me"])
            if sure or beside or behind:
                want.add((match, r["seg_id"]))
                last = r
    got = [tuple(r) for r in catalogue.QUERIES["context_validate"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) < sum(map(len, _by_match(spark, sf).values()))


def test_searches_take_every_hundredth_frame(spark, sf):
    run = lambda name: catalogue.QUERIES[name](spark, sf)
    a = {r["pos"]: r["a"] for r in V.frames(spark, sf).collect()}
    asked = [p for p in a if p % 100 == 0]
    assert len(asked) == len(a) // 100
    agree = {p // 100: {r: sum(x == y for x, y in zip(a[p], a[r], strict=True)) for r in a} for p in asked}
    best = lambda s, of: max(((s[r], -r) for r in of if s[r] > 0), default=None)
    rows = lambda name: sorted((r["si"], r["pos"], r["agree"]) for r in run(name).collect())
    found = lambda of: sorted((i, -b[1], b[0]) for i, s in agree.items() if (b := best(s, of(s))))
    assert rows("nn_top1") == found(lambda s: [r for r in s if s[r] >= 40])
    assert rows("nn_stride5") == found(lambda s: [r for r in s if r % 5 == 0])
    centre = {i: -best(s, [r for r in s if r % 10 == 0])[1] for i, s in agree.items()}
    assert rows("nn_coarse_fine") == sorted((i, -b[1], b[0]) for i, s in agree.items() if (b := best(s, [r for r in s if abs(r - centre[i]) <= 30])))
    lo, hi = min(agree), max(agree)
    seeds = {int(lo + k * (hi - lo) / 4 + 0.5) for k in range(5)}
    scored = sorted((i, r, n) for i in seeds for r, n in agree[i].items() if n >= 36)
    assert rows("seed_scores") == scored
    kept = []
    for i, r, n in scored:
        if not kept or kept[-1][0] != i or r - kept[-1][1] >= 50:
            kept.append((i, r, n))
        elif n > kept[-1][2]:
            kept[-1] = (i, r, n)
    assert rows("seed_candidates") == kept
    assert rows("seed_top8") == sorted(x for i in seeds for x in sorted((k for k in kept if k[0] == i), key=lambda k: (-k[2], k[1]))[:8])
    mean = sum(max(s.values()) for s in agree.values()) / len(agree) / 64 * 100
    assert [tuple(r) for r in run("forced_best").collect()] == [(len(asked), round(mean, 6))]


def test_every_row_is_aligned(spark, sf):
    levels = {(r["video_id"], r["pos"]): r["level"] for r in V.timeline(spark, sf).collect()}
    want = {}
    for (video, pos), level in levels.items():
        near = [(abs(level - levels[video, q]), q) for q in range(pos - 3, pos + 4) if q != pos and (video, q) in levels]
        if near:
            want[video, pos] = min(near)
    got = catalogue.QUERIES["local_align"](spark, sf).collect()
    assert {(r["video_id"], r["pos"]): (r["difference"], r["at"]) for r in got} == want and len(got) == len(want)


def test_forced_gate_compares_searches_with_all_frames(spark):
    """At sf0.1: twelve searches that pass, and eight that are too few."""
    from helpers import oracle, rows_of

    sf = "/root/testdata/sf0.1"
    got = catalogue.QUERIES["forced_gate"](spark, sf).toPandas()
    assert rows_of(got) == rows_of(oracle(sf, catalogue.ORACLES["forced_gate"])) and got[["group", "frames"]].values.tolist() == [[0, 12]]


def test_coverage_meets_equal_intervals_once(spark, sf, tmp_path):
    """Copies of all orders, some with repeated keys: as the SQL counts them, without a shuffle of pairs."""
    import duckdb
    from helpers import TABLES, oracle, rows_of

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey + k % 2 * 280000 AS o_orderkey) FROM '{sf}/orders.parquet', range(3) r(k)) TO '{tmp_path}/orders.parquet'")
    found = catalogue.QUERIES["gt_coverage"](spark, str(tmp_path))
    assert rows_of(found.toPandas()) == rows_of(oracle(str(tmp_path), catalogue.ORACLES["gt_coverage"]))
