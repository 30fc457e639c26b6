"""Queries of nearest-frame search and seeding: every frame whose id is divisible by 100, against all frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import display
from framelake.operators import search
from framelake.plans import views as V


def nn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_of(V.searches(spark, sf_dir), V.frames(spark, sf_dir), 64, 1, floor=40)


def nn_stride5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against each fifth frame, as the feature has it."""
    return search.best_of(V.searches(spark, sf_dir), V.frames(spark, sf_dir).filter("pos % 5 = 0"), 64, 1)


def nn_coarse_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.coarse_to_fine(V.searches(spark, sf_dir), V.frames(spark, sf_dir), 64, 1)


def seed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds at 0, 25, 50, 75 and 100 % of the searches as one chunk."""
    q = V.searches(spark, sf_dir)
    chunk = q.agg(F.min("si").alias("start"), F.max("si").alias("end")).filter("start is not null")
    seeds = search.seed_positions(chunk).select(F.col("seed").cast("bigint").alias("si"))
    return search.scores(q.join(seeds, "si", "left_semi"), V.frames(spark, sf_dir), 64, 1, floor=36)


def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suppressed(seed_scores(spark, sf_dir))


def seed_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(seed_candidates(spark, sf_dir)).select("si", "pos", "agree", "rank")


def forced_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_of(V.searches(spark, sf_dir), V.frames(spark, sf_dir), 64, 1)
    return best.groupBy().agg(F.count("*").alias("frames"), display.rounded(F.avg(F.col("agree") / 64 * 100), 6).alias("mean_best"))


_BEST = "SELECT si, arg_max(pos, agree * 1000000 - pos) AS pos, CAST(max(agree) AS INTEGER) AS agree FROM {rows} GROUP BY si"
_WITH = f"WITH RECURSIVE {V.SEARCHES}, seeds AS (SELECT DISTINCT CAST(floor(lo + k * (hi - lo) / 4 + 0.5) AS BIGINT) AS si FROM (SELECT min(si) AS lo, max(si) AS hi FROM searches), range(5) AS r(k))"
#: Ordered suppression, one candidate at a time.
_KEPT = """, numbered AS (SELECT si, pos, agree, row_number() OVER (PARTITION BY si ORDER BY pos) AS n FROM agree WHERE si IN (SELECT si FROM seeds) AND agree >= 36),
walk AS (SELECT si, n, pos, agree, 1 AS cluster FROM numbered WHERE n = 1 UNION ALL
  SELECT w.si, x.n, CASE WHEN x.pos - w.pos >= 50 OR x.agree > w.agree THEN x.pos ELSE w.pos END, CASE WHEN x.pos - w.pos >= 50 OR x.agree > w.agree THEN x.agree ELSE w.agree END,
         CASE WHEN x.pos - w.pos >= 50 THEN w.cluster + 1 ELSE w.cluster END
  FROM walk w JOIN numbered x ON x.si = w.si AND x.n = w.n + 1),
kept AS (SELECT si, arg_max(pos, n) AS pos, CAST(arg_max(agree, n) AS INTEGER) AS agree FROM walk GROUP BY si, cluster)"""

QUERIES = {
    "nn_top1": nn_top1,
    "nn_stride5": nn_stride5,
    "nn_coarse_fine": nn_coarse_fine,
    "seed_scores": seed_scores,
    "seed_candidates": seed_candidates,
    "seed_top8": seed_top8,
    "forced_best": forced_best,
}
ORACLES = {
    "nn_top1": f"{_WITH} " + _BEST.format(rows="agree WHERE agree >= 40"),
    "nn_stride5": f"{_WITH} " + _BEST.format(rows="agree WHERE pos % 5 = 0"),
    "nn_coarse_fine": f"{_WITH}, coarse AS (" + _BEST.format(rows="agree WHERE pos % 10 = 0") + ") SELECT a.si, arg_max(a.pos, a.agree * 1000000 - a.pos) AS pos, CAST(max(a.agree) AS INTEGER) AS agree"
    " FROM agree a JOIN coarse c ON a.si = c.si AND abs(a.pos - c.pos) <= 30 GROUP BY a.si",
    "seed_scores": f"{_WITH} SELECT si, pos, CAST(agree AS INTEGER) AS agree FROM agree WHERE si IN (SELECT si FROM seeds) AND agree >= 36",
    "seed_candidates": f"{_WITH}{_KEPT} SELECT si, pos, agree FROM kept",
    "seed_top8": f"{_WITH}{_KEPT} SELECT * FROM (SELECT si, pos, agree, CAST(row_number() OVER (PARTITION BY si ORDER BY agree DESC, pos) AS INTEGER) AS rank FROM kept) WHERE rank <= 8",
    "forced_best": f"{_WITH}, best AS (" + _BEST.format(rows="agree WHERE agree > 0") + ") SELECT count(*) AS frames, round(avg(agree / 64.0 * 100), 6) AS mean_best FROM best",
}
