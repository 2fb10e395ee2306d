"""Runs that fall silent: an active run without a sign of life for longer than a limit is interrupted, once.

Rows are signs of life: (run_id, at, ended), ended marking the one with which a run ends by itself. Times count in whole
milliseconds. A run is interrupted a limit after the last sign before its first longer pause; a run that has ended, or was
interrupted, stays so whatever comes after.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "run_id bigint, at_ms bigint"


def interrupted(signs: DataFrame, limit_s: int, now_ms: int) -> DataFrame:
    """(run_id, at_ms) of each run that is interrupted as of now_ms; signs after now count as unseen."""
    rows = signs.select("run_id", F.unix_millis("at").alias("ms"), F.coalesce("ended", F.lit(False)).alias("ended")).where(F.col("ms") <= now_ms)
    ends = F.min(F.when(F.col("ended"), F.col("ms"))).over(Window.partitionBy("run_id"))
    rows = rows.withColumn("ends", ends).where(F.col("ends").isNull() | (F.col("ms") <= F.col("ends")))
    following = F.lead("ms").over(Window.partitionBy("run_id").orderBy("ms", "ended"))
    silent = F.coalesce(following, F.when(F.col("ends").isNull(), F.lit(now_ms))) - F.col("ms") > limit_s * 1000
    return rows.withColumn("silent", silent).where("silent").groupBy("run_id").agg((F.min("ms") + limit_s * 1000).alias("at_ms"))


class _Watch(StatefulProcessor):
    """The last sign that the watermark has passed, the signs beyond it, and whether the run is over."""

    def __init__(self, limit_ms: int, forget_ms: int):
        self.limit, self.forget = limit_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("watch", "last bigint, over boolean, ahead string, timer bigint")

    def _look(self, key, last: int | None, ahead: list, timer: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Go through the signs that the watermark has passed; no earlier one can come any more."""
        over, at, ahead = False, None, sorted(ahead)
        while ahead and ahead[0][0] <= now and not over:
            ms, ended = ahead.pop(0)
            if last is not None and ms - last > self.limit:
                over, at = True, last + self.limit
            else:
                over, last = bool(ended), ms
        if not over and last is not None and now - last > self.limit:
            over, at = True, last + self.limit
        first = last if last is not None else ahead[0][0] if ahead else now
        wakes = max(now, 0) + self.forget if over else max(first + self.limit, now) + 1
        if timer != wakes:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wakes)
        self.saved.update((last, over, "[]" if over else json.dumps(ahead), wakes))
        yield pd.DataFrame({"run_id": [int(key[0])], "at_ms": [at]} if at is not None else {"run_id": pd.Series([], dtype="int64"), "at_ms": pd.Series([], dtype="int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, over, ahead, timer = self.saved.get() or (None, False, "[]", None)
        if over:
            return
        signs = json.loads(ahead)
        for pdf in rows:
            signs += [[int(ms), int(bool(e))] for ms, e in zip(pdf["ms"].tolist(), pdf["ended"].tolist())]
        yield from self._look(key, last, signs, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, over, ahead, _ = self.saved.get() or (None, True, "[]", None)
        if over:
            self.saved.clear()
            yield pd.DataFrame({"run_id": pd.Series([], dtype="int64"), "at_ms": pd.Series([], dtype="int64")})
        else:
            yield from self._look(key, last, json.loads(ahead), None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def watch(signs: DataFrame, limit_s: int, late: str, forget_s: int = 86_400) -> DataFrame:
    """interrupted() as a stream: a run is told once, when the watermark (`late` behind the newest sign) is past its
    limit. A timer for each run wakes it; signs are kept until the watermark has passed them. A run that is over is
    remembered for forget_s, so that what still comes of it does nothing; then all of its state goes. Needs the RocksDB state
    store."""
    rows = signs.withWatermark("at", late).select("run_id", "at", F.unix_millis("at").alias("ms"), F.coalesce("ended", F.lit(False)).alias("ended"))
    watcher = _Watch(limit_s * 1000, forget_s * 1000)
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=watcher, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")
