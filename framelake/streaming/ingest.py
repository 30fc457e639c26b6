"""Structured Streaming: fingerprint records as they arrive, put in order, and cuts found online."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from framelake.sources.readers import FINGERPRINT


def records(spark: SparkSession, path: str, schema: str = "video_id STRING, " + FINGERPRINT, files_per_trigger: int = 64, bytes_per_trigger: int | None = None) -> DataFrame:
    """New JSON-lines files of a folder. A micro-batch is bounded by files_per_trigger, or by bytes_per_trigger instead."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    bound = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else ("maxBytesPerTrigger", bytes_per_trigger)
    return reader.option(*bound).json(path)


class Progress(StreamingQueryListener):
    """Calls report(query name, rows so far, rows a second) after each micro-batch: spark.streams.addListener(Progress(print))."""

    def __init__(self, report):
        self.report, self.rows = report, {}

    def onQueryStarted(self, event) -> None:
        self.rows[event.runId] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.runId] = self.rows.get(p.runId, 0) + p.numInputRows
        self.report(p.name, self.rows[p.runId], p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(event.runId, None)


def in_order(stream: DataFrame, first: int = 1, patience: str | None = None, limit: int = 192) -> DataFrame:
    """The frames of each video from index `first` on, each once and in order, whatever order and micro-batch they come in: video_id, frameIndex, record (the whole row as JSON), is_cut
    (as in align.cuts_of, against the frame released before; a frame without dhash or colours skips that test) and missing (how many frames before it were given up).

    State of a video: the index awaited, and a map of the frames that came early, which holds no more than what lies behind a hole. A hole that lasts longer than `patience` ("10 minutes", in
    processing time) is given up when its timer runs out; without it the frames behind it wait. With timers a query goes on looking at them, so it takes a trigger of processing time, not availableNow; after a restart they run from the first batch with data on. A frame that comes after its turn, or again, is left out. Needs the RocksDB state store."""
    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)

    class Order(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "frame int")
            self.early = handle.getMapState("early", "frame int", "record string, hash string, dhash string, colour array<double>")
            self.last = handle.getValueState("last", "hash string, dhash string, colour array<double>")
            self.timer = handle.getValueState("timer", "at bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            due = self._due()
            for batch in rows:
                for r in batch.itertuples(index=False):
                    if r.frameIndex >= due and not self.early.containsKey((int(r.frameIndex),)):
                        colour = [float(x) for x in r.colour] if r.colour is not None and len(r.colour) == 48 else None
                        self.early.updateValue((int(r.frameIndex),), (r.record, r.hash, r.dhash, colour))
            yield self._released(key[0], due, 0)
            self._watch(timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.timer.clear()
            due = self._due()
            waiting = [k[0] for k in self.early.keys()]
            if waiting:
                yield self._released(key[0], min(waiting), min(waiting) - due)
            self._watch(timerValues)

        def close(self) -> None:
            pass

        def _due(self) -> int:
            return self.next.get()[0] if self.next.exists() else first

        def _released(self, video: str, due: int, missing: int) -> pd.DataFrame:
            """The frames from `due` on that are there without a hole."""
            out, last = [], tuple(self.last.get()) if self.last.exists() else None
            while self.early.containsKey((due,)):
                record, *now = self.early.getValue((due,))
                self.early.removeKey((due,))
                now = (now[0] or "", now[1] or "", list(now[2]) if now[2] is not None else [])
                out.append((video, due, record, bool(now[0]) and last is not None and _changed(last, now, limit), missing))
                last, due, missing = now if now[0] else last, due + 1, 0
            if out:
                self.next.update((due,))
            if last is not None:
                self.last.update((last[0], last[1], list(last[2])))
            return pd.DataFrame(out, columns=["video_id", "frameIndex", "record", "is_cut", "missing"])

        def _watch(self, timerValues) -> None:
            """A timer while a hole keeps frames waiting."""
            if wait is None:
                return
            waiting = bool([*self.early.keys()])
            if not waiting and self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
                self.timer.clear()
            elif waiting and not self.timer.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + wait
                self.handle.registerTimer(at)
                self.timer.update((at,))

    full = F.col("variants")["full"]
    frames = stream.filter("video_id is not null and frameIndex is not null").select(
        "video_id", "frameIndex", F.to_json(F.struct("*")).alias("record"), full["hash"].alias("hash"), full["dhash"].alias("dhash"), F.col("signature.colorGrid").alias("colour")
    )
    return frames.groupBy("video_id").transformWithStateInPandas(Order(), "video_id string, frameIndex int, record string, is_cut boolean, missing int", "Append", "None" if wait is None else "ProcessingTime")


def online_cuts(stream: DataFrame, first: int = 1, patience: str | None = None, limit: int = 192) -> DataFrame:
    """video_id, frameIndex of frames that differ from the one before: in more than `limit` bits of the hash, in more than 72 % of the dhash, or by more than 100 in
    colour. Frames are taken in order, so a late one is compared with its own neighbours."""
    return in_order(stream, first, patience, limit).filter("is_cut").select("video_id", "frameIndex")


def _changed(last: tuple, now: tuple, limit: int) -> bool:
    if (int(now[0], 2) ^ int(last[0], 2)).bit_count() > limit:
        return True
    if now[1] and len(now[1]) == len(last[1]) and (1 - (int(now[1], 2) ^ int(last[1], 2)).bit_count() / len(now[1])) * 100 < 28:
        return True
    return bool(len(now[2]) and len(last[2])) and math.dist(now[2], last[2]) > 100
