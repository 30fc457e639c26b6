"""Every registered query of the engine against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from framelake.plans import catalogue
from helpers import oracle, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    got = rows_of(catalogue.QUERIES[name](spark, sf).toPandas())
    assert got == rows_of(oracle(sf, catalogue.ORACLES[name]))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_scans_the_reference_where_it_lies(spark, sf):
    """No pair join and no shuffle of the reference, whose unused columns aren't read."""
    for name in ("nn_top1", "seed_scores", "forced_best", "global_best_mean"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "label" not in plan, name


@pytest.mark.parametrize("words", [1, 3])
def test_runs_give_what_all_pairs_give(spark, monkeypatch, words):
    import numpy as np

    from framelake.operators import search

    rng = np.random.default_rng(words)
    now, rows = rng.integers(0, 1 << 62, words), []
    for pos in range(3000):
        now = rng.integers(0, 1 << 62, words) if pos % 200 == 0 else now ^ (1 << rng.integers(0, 62, words))
        rows.append((pos, *map(int, now)))
    rows += [(3000 + k, *rows[k][1:]) for k in range(0, 400, 7)]  # ties
    asked = [(k, *(int(x) ^ (1 << k) for x in rows[k * 71 % 3000][1:])) for k in range(40)]
    cols = ", ".join(f"w{k} bigint" for k in range(words))
    ref, q = spark.createDataFrame(rows, f"pos bigint, {cols}").repartition(3).sortWithinPartitions("pos"), spark.createDataFrame(asked, f"si bigint, {cols}")
    size = 64 * words
    agree = {(si, pos): size - sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) for si, *x in asked for pos, *y in rows}
    best = {si: max((n, -pos) for (s, pos), n in agree.items() if s == si) for si, *_ in asked}
    count = spark.sparkContext.accumulator(0)
    got = search.best_of(q, ref, size, words, opened=count).collect()
    assert {r["si"]: (r["agree"], -r["pos"]) for r in got} == best
    assert count.value < 0.5 * len(asked) * len(rows)
    floor = size * 0.8
    monkeypatch.setattr(search, "BLOCK_ROWS", 15)
    pairs = {(r["si"], r["pos"]): r["agree"] for r in search.scores(q, ref, size, words, floor).collect()}
    assert pairs == {k: n for k, n in agree.items() if n >= floor}
    assert {r["si"]: (r["agree"], -r["pos"]) for r in search.best_of(q, ref, size, words, floor=floor).collect()} == {s: b for s, b in best.items() if b[0] >= floor}
    assert search.best_of(q.limit(0), ref, size, words).count() == 0 and search.scores(q, ref.limit(0), size, words).count() == 0
