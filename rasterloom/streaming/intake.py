"""Streaming intake of artwork files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.rasters import is_artwork

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Files as they arrive: (path, modified, length, content); others than artwork are passed over."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.where(is_artwork(F.col("path"))).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def stable(observations: DataFrame, needed: int = 2, attempts: int = 5) -> DataFrame:
    """Of a stream of observed sizes (path, length): each path once, when its size was the same and not zero ``needed`` times in a row.

    A path that is not stable after ``attempts`` observations comes with ``ready`` false.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, same, seen, done = state.get if state.exists else (-1, 0, 0, False)
        out = []
        for frame in frames:
            for length in frame["length"]:
                if done:
                    continue
                same = same + 1 if length == size and length > 0 else int(length > 0)
                size, seen = int(length), seen + 1
                if same >= needed or seen >= attempts:
                    done = True
                    out.append((key[0], size, same >= needed))
        state.update((size, same, seen, done))
        yield pd.DataFrame(out, columns=["path", "length", "ready"])

    return observations.select("path", "length").groupBy("path").applyInPandasWithState(watch, "path string, length long, ready boolean", "size long, same int, seen int, done boolean", "append", GroupStateTimeout.NoTimeout)


def process(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs the batch plan ``job`` on every micro-batch; results and progress survive a restart.

    Each batch has a folder ``batch=number``, so a batch that is tried again replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Polls(DataSource):
    """Streaming source "folder_polls": each micro-batch lists the folder anew, so a file is observed as long as it is there.

    Rows are (path, length, poll); offsets count the polls, and the trigger's interval is the
    time between them.  Option ``path``: a folder that the driver sees, not looked into further
    down.  A poll that is repeated after a restart observes what is there then.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return "path string, length long, poll long"

    def simpleStreamReader(self, schema):
        return _PollReader(self.options["path"])


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _seen(self, poll: int) -> list[tuple]:
        import os

        if not os.path.isdir(self.folder):
            return []
        with os.scandir(self.folder) as entries:
            return sorted((e.path, e.stat().st_size, poll) for e in entries if e.is_file())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter(self._seen(start["poll"])), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._seen(start["poll"]))

    def commit(self, end: dict) -> None:
        pass


def polls(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, poll, artwork): every file of ``folder`` at every poll; others than artwork are marked, not dropped."""
    spark.dataSource.register(Polls)
    return spark.readStream.format("folder_polls").option("path", folder).load().withColumn("artwork", is_artwork(F.col("path")))


class Gate(StatefulProcessor):
    """Per path: its last size, how often that repeated, and how often it was seen; a timer ends what is seen no more."""

    SCHEMA = "path string, length long, ready boolean, warning string"

    def __init__(self, repeats: int = 2, attempts: int = 5, expiry_ms: int = 60_000):
        self.repeats, self.attempts, self.expiry_ms = repeats, attempts, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "size long, same int, seen int, done boolean")

    def _timer(self, now: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, same, seen, done = self.state.get() if self.state.exists() else (-1, 0, 0, False)
        out = []
        for frame in rows:
            for length, artwork in zip(frame["length"], frame["artwork"], strict=True):
                if done:
                    continue
                if not artwork:
                    done = True
                    out.append((key[0], int(length), False, "no artwork: passed over"))
                    continue
                same = same + 1 if length == size and length > 0 else 0
                size, seen = int(length), seen + 1
                if same >= self.repeats:
                    done = True
                    out.append((key[0], size, True, None))
                elif seen >= self.attempts:
                    done = True
                    out.append((key[0], size, False, f"still changing after {seen} looks"))
        self.state.update((size, same, seen, done))
        self._timer(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["path", "length", "ready", "warning"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, _, _, done = self.state.get() if self.state.exists() else (-1, 0, 0, True)
        self.state.clear()
        yield pd.DataFrame([] if done else [(key[0], size, False, "seen no more")], columns=["path", "length", "ready", "warning"])

    def close(self) -> None:
        pass


def gated(observations: DataFrame, repeats: int = 2, attempts: int = 5, expiry_seconds: float = 60.0) -> DataFrame:
    """Each path once: ready when its size, not zero, repeated ``repeats`` times in a row; else not ready, with a warning.

    A path that is observed no more for ``expiry_seconds`` ends not ready if it was not told of yet, and
    its state goes; if it comes back later it is watched anew.  Needs the RocksDB state store.
    """
    processor = Gate(repeats, attempts, int(expiry_seconds * 1000))
    grouped = observations.select("path", "length", "artwork").groupBy("path")
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=Gate.SCHEMA, outputMode="append", timeMode="processingTime")
