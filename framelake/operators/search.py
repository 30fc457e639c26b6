"""Nearest-frame searches: a stated set of query frames against a reference, by packed hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.bits import hamming
from framelake.functions.variants import compare_fingerprints

#: Query rows that go to every task at once, as whole numbers; more go in as many passes as it takes.
BLOCK_ROWS = 100_000
#: Neighbouring reference frames that are held by their first and by how far the others are from it.
RUN = 16


def _query_blocks(queries: DataFrame, words: int, apart: str | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(si, words) of at most about BLOCK_ROWS queries at a time, and the column `apart`, where one is named."""
    q = queries.select(F.col("si").cast("bigint").alias("si"), *[F.col(f"w{k}") for k in range(words)], *([F.col(apart).cast("bigint").alias("apart")] if apart else []))
    n = max(1, -(-q.count() // BLOCK_ROWS))
    for k in range(n):
        t = (q if n == 1 else q.filter(F.pmod(F.xxhash64("si"), F.lit(n)) == k)).toArrow()
        if t.num_rows:
            yield t["si"].to_numpy(), np.stack([t[f"w{j}"].to_numpy().view(np.uint64) for j in range(words)], axis=1), *([t["apart"].to_numpy()] if apart else [])


def _off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of packed hashes, summed over the words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class Runs:
    """A batch of reference frames by position, in runs of neighbours. As distances keep the triangle inequality, no frame of a run has more bits in common with a query than the
    run's first frame has, plus the run's radius: runs that can't reach what is asked for are never opened, and nothing is lost."""

    def __init__(self, batch: pa.RecordBatch, words: int, size: int):
        pos = batch.column("pos").to_numpy(zero_copy_only=False)
        order = np.argsort(pos, kind="stable")
        self.pos, self.size = pos[order], size
        self.w = np.stack([batch.column(f"w{k}").to_numpy(zero_copy_only=False).view(np.uint64)[order] for k in range(words)], axis=1)
        self.first = np.arange(0, len(pos), RUN)
        self.radius = np.maximum.reduceat(_off(self.w, self.w[np.arange(len(pos)) // RUN * RUN]), self.first)

    def most(self, q: np.ndarray) -> np.ndarray:
        """(run, query): the most bits that any frame of the run can have in common with a query."""
        return self.size - _off(self.w[self.first][:, None], q[None]) + self.radius[:, None]

    def opened(self, run: np.ndarray, query: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(frame, query, bits in common) of the frames of these pairs of runs and queries."""
        at = run[:, None] * RUN + np.arange(RUN)
        here = at < len(self.pos)
        frame, query = at[here], np.broadcast_to(query[:, None], at.shape)[here]
        return frame, query, self.size - _off(self.w[frame], q[query])


def _each(reference: DataFrame, words: int, scan, kind: str) -> DataFrame:
    return reference.select(F.col("pos").cast("bigint").alias("pos"), *[f"w{k}" for k in range(words)]).mapInArrow(scan, kind)


def scores(queries: DataFrame, reference: DataFrame, size: int, words: int, floor: float | None = None) -> DataFrame:
    """si, pos, agree: equal bits of each query and reference frame (columns si, w0.. and pos, w0..), at least `floor`. The reference is scanned where it lies, run by run."""
    spark, out = reference.sparkSession, None
    for si, q in _query_blocks(queries, words):
        sent = spark.sparkContext.broadcast((si, q))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            si, q = sent.value
            for b in batches:
                for at in range(0, b.num_rows, 64 * RUN):
                    runs = Runs(b.slice(at, 64 * RUN), words, size)
                    for k in range(0, len(q), 512):
                        own = q[k : k + 512]
                        run, query = np.nonzero(runs.most(own) >= (0 if floor is None else floor))
                        frame, query, agree = runs.opened(run, query, own)
                        keep = agree >= (0 if floor is None else floor)
                        yield pa.RecordBatch.from_arrays([pa.array(si[k : k + 512][query[keep]]), pa.array(runs.pos[frame[keep]]), pa.array(agree[keep])], names=["si", "pos", "agree"])

        part = _each(reference, words, scan, "si bigint, pos bigint, agree int")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "si bigint, pos bigint, agree int") if out is None else out


def best_of(queries: DataFrame, reference: DataFrame, size: int, words: int, floor: float = 1, opened=None, apart: str | None = None) -> DataFrame:
    """nearest() of scores(), without its pairs: si, pos, agree. A task takes runs by what they can reach and opens those that can still beat its best so far. opened: an
    accumulator for the number of frames compared. apart: the queries' column with a position that each may not take."""
    spark, out = reference.sparkSession, None
    for si, q, *no in _query_blocks(queries, words, apart):
        sent = spark.sparkContext.broadcast((si, q, *no))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            si, q, *no = sent.value
            best, place = np.full(len(q), -1, np.int64), np.zeros(len(q), np.int64)
            least = max(1, floor)
            for b in batches:
                for start in range(0, b.num_rows, 64 * RUN):
                    runs = Runs(b.slice(start, 64 * RUN), words, size)
                    for k in range(0, len(q), 512):
                        most = runs.most(q[k : k + 512])
                        order = np.argsort(-most, axis=0, kind="stable")
                        for turn in range(len(order)):
                            run = order[turn]
                            ok = np.flatnonzero(most[run, np.arange(len(run))] >= np.maximum(best[k : k + 512], least))
                            if not len(ok):
                                break
                            frame, query, agree = runs.opened(run[ok], ok, q[k : k + 512])
                            if opened is not None:
                                opened.add(len(frame))
                            if no:
                                other = runs.pos[frame] != no[0][query + k]
                                frame, query, agree = frame[other], query[other], agree[other]
                                if not len(frame):
                                    continue
                            by = np.lexsort((runs.pos[frame], -agree, query))
                            top = by[np.append(True, query[by][1:] != query[by][:-1])]
                            to = query[top] + k
                            better = (agree[top] >= least) & ((agree[top] > best[to]) | ((agree[top] == best[to]) & (runs.pos[frame[top]] < place[to])))
                            best[to[better]], place[to[better]] = agree[top][better], runs.pos[frame[top]][better]
            some = np.flatnonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(si[some]), pa.array(place[some]), pa.array(best[some].astype(np.int32))], names=["si", "pos", "agree"])

        part = _each(reference, words, scan, "si bigint, pos bigint, agree int")
        out = part if out is None else out.unionByName(part)
    return nearest(spark.createDataFrame([], "si bigint, pos bigint, agree int") if out is None else out)


def nearest(found: DataFrame) -> DataFrame:
    """The best of each query, the lowest position on ties; a score of 0 never matches."""
    best = found.filter("agree > 0").groupBy("si").agg(F.max(F.struct("agree", (-F.col("pos")).alias("n"))).alias("b"))
    return best.select("si", (-F.col("b.n")).alias("pos"), F.col("b.agree").alias("agree"))


def coarse_to_fine(queries: DataFrame, reference: DataFrame, size: int, words: int, step: int = 10, reach: int = 30) -> DataFrame:
    """Nearest among every step-th position, then nearest within reach of it."""
    coarse = best_of(queries, reference.filter(F.col("pos") % step == 0), size, words).select("si", F.col("pos").alias("centre"))
    return nearest(around(queries.join(coarse, "si"), reference, size, words, reach))


def within(centres: DataFrame, reference: DataFrame, reach: int) -> DataFrame:
    """Each row of centres (a position `centre` among its columns) with the reference rows at most `reach` from it: a band join by buckets of
    `reach` positions, in which a centre meets three buckets, not the reference."""
    q = centres.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("centre") - reach) / reach), F.floor((F.col("centre") + reach) / reach))))
    r = reference.withColumn("bucket", F.floor(F.col("pos") / reach))
    return q.join(r, "bucket").filter(F.abs(F.col("pos") - F.col("centre")) <= reach).drop("bucket")


def around(queries: DataFrame, reference: DataFrame, size: int, words: int, reach: int) -> DataFrame:
    """si, pos, agree as in scores, for reference frames at most `reach` from each query's `centre`. With the words of many variants side by
    side, and all their bits as size, agree is the mean over the variants times size."""
    q = queries.select("si", "centre", *[F.col(f"w{k}").alias(f"q{k}") for k in range(words)])
    r = reference.select("pos", *[f"w{k}" for k in range(words)])
    agree = size - hamming([F.col(f"q{k}") for k in range(words)], [F.col(f"w{k}") for k in range(words)])
    return within(q, r, reach).select("si", "pos", agree.alias("agree"))


def rough_match(clip: DataFrame, reference: DataFrame, size: int = 256, step: int = 5) -> DataFrame:
    """One row: where a clip's first frame fits best among every step-th reference frame, by its variants' first hashes, and the reference
    frame as many frames later as the clip has (the last, if that is past the end). Both: pos, timestamp, variants (packed, in order).
    What fits with 0 fits nowhere: the reference's first frame."""
    ends = lambda df, n: df.agg(F.min_by("timestamp", "pos").alias(f"{n}Start"), F.max_by("timestamp", "pos").alias(f"{n}End"), F.count("*").alias(f"{n}Count"), F.max("pos").alias(f"{n}Last"))
    first = clip.orderBy("pos").limit(1).select(F.col("variants").alias("own"))
    sim = compare_fingerprints(F.col("own"), F.col("variants"), size)
    scored = reference.filter(F.col("pos") % step == 0).join(F.broadcast(first)).select("pos", "timestamp", sim.alias("sim"))
    best = scored.filter("sim > 0").agg(F.max_by(F.struct("pos", "timestamp", "sim"), F.struct("sim", -F.col("pos"))).alias("b"))
    one = best.join(F.broadcast(ends(clip, "short"))).join(F.broadcast(ends(reference, "movie")))
    at = F.least(F.col("movieLast"), F.coalesce("b.pos", F.lit(0)) + F.col("shortCount"))
    end = one.withColumn("at", at).join(reference.select(F.col("pos").alias("at"), F.col("timestamp").alias("movieAt")), "at", "left")
    return end.select(
        "shortStart", "shortEnd", F.coalesce("b.timestamp", "movieStart").alias("movieStart"), F.col("movieAt").alias("movieEnd"),
        F.coalesce("b.sim", F.lit(0.0)).alias("confidence"), F.col("shortCount").alias("frameCount"),
    )


def forced_gate(best: DataFrame, key: str, frames: int = 10, mean: float = 65.0) -> DataFrame:
    """key, frames, mean_best of the groups of best scores (sim in percent) that count: at least so many, and good enough on average."""
    return best.groupBy(key).agg(F.count("*").alias("frames"), F.avg("sim").alias("mean_best")).filter((F.col("frames") >= frames) & (F.col("mean_best") >= mean))


def seed_positions(chunks: DataFrame) -> DataFrame:
    """Positions at 0, 25, 50, 75 and 100 % of each chunk, rounded half up, each once."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(F.col("start") + k * (F.col("end") - F.col("start")) / 4 + 0.5).cast("int")))
    return chunks.select("*", at.alias("seed")).distinct()


def suppressed(found: DataFrame, distance: int = 50) -> DataFrame:
    """One candidate for each cluster of a seed's candidates: in order of position, one nearer than `distance` to the cluster's
    present representative replaces it if better, and so moves it."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, agree, kept = rows["pos"].to_numpy(), rows["agree"].to_numpy(), []
        for k in range(len(rows)):
            if not kept or pos[k] - pos[kept[-1]] >= distance:
                kept.append(k)
            elif agree[k] > agree[kept[-1]]:
                kept[-1] = k
        return rows.iloc[kept]

    typed = found.select(F.col("si").cast("bigint").alias("si"), F.col("pos").cast("bigint").alias("pos"), F.col("agree").cast("int").alias("agree"))
    return typed.groupBy("si").applyInPandas(fold, "si bigint, pos bigint, agree int")


def top(found: DataFrame, n: int = 8) -> DataFrame:
    """rank 1 to n of each query by score, lower position first on ties."""
    w = Window.partitionBy("si").orderBy(F.desc("agree"), "pos")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def asof_nearest(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each left row's right row of nearest t, before or after, the lower pos on ties: two ordered scans of one union, no pair join."""
    both = left.select(key, "t", F.col("pos").alias("lpos"), F.lit(None).cast("struct<t:bigint,pos:bigint>").alias("r")).unionByName(
        right.select(key, "t", F.lit(None).cast("bigint").alias("lpos"), F.struct(F.col("t").cast("bigint").alias("t"), F.col("pos").cast("bigint").alias("pos")).alias("r"))
    )
    back = Window.partitionBy(key).orderBy("t", F.col("lpos").isNotNull(), F.desc("r.pos"))
    ahead = Window.partitionBy(key).orderBy(F.desc("t"), F.col("lpos").isNotNull(), F.desc("r.pos"))
    near = both.withColumns({"b": F.last("r", True).over(back), "a": F.last("r", True).over(ahead)}).filter("lpos is not null")
    gap = lambda x: F.when(x.isNotNull(), F.struct(F.abs(F.col("t") - x["t"]).alias("d"), x["pos"].alias("pos")))
    best = F.least(gap(F.col("b")), gap(F.col("a")))
    return near.select(key, F.col("lpos").alias("pos"), best["pos"].alias("match_pos"), best["d"].alias("distance"))
