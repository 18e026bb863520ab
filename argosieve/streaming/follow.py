"""Scans of streams, with indicators that are reloaded when a new version of them is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from argosieve.plans.indicators import IndicatorSet, current_version
from argosieve.plans.scan import scan
from argosieve.plans.shared import discard, shared_dir, stored
from argosieve.streaming.tail import TailSource


class Reloading:
    """The current version of a saved set.

    ``get`` looks at the pointer first and loads the version that it names, if that is another. The new set is in place
    before ``generation`` tells of it. If loading fails, the old set stays. ``on_reload`` gets (version, generation, error).
    """

    def __init__(self, spark: SparkSession, path: str, on_reload: Callable[[str, int, Exception | None], None] | None = None):
        self.spark, self.path, self.on_reload = spark, path, on_reload
        self.version = current_version(spark, path)
        self.failed: str | None = None
        self.set = IndicatorSet.load(spark, path, self.version)
        self.generation = 1

    def get(self) -> IndicatorSet:
        version = current_version(self.spark, self.path)
        if version not in (None, self.version, self.failed):
            try:
                new = IndicatorSet.load(self.spark, self.path, version)
            except Exception as e:
                self.failed = version
                if self.on_reload:
                    self.on_reload(version, self.generation, e)
            else:
                self.set, self.version, self.failed = new, version, None
                self.generation += 1
                if self.on_reload:
                    self.on_reload(version, self.generation, None)
        return self.set


def tail(spark: SparkSession, pattern: str, chunk_bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("chunkbytes", str(chunk_bytes)).load(pattern)


def follow(lines: DataFrame, sets: list[IndicatorSet | Reloading], sink: Callable[[DataFrame, int], None], checkpoint: str, text_col: str = "text", available_now: bool = False, types: tuple[str, ...] | None = None) -> StreamingQuery:
    """Starts the scan of a stream of lines; every batch's matches go to ``sink``, with the batch's number.

    A batch's items are in the shared folder while it runs, so lost executors lose nothing of it.
    """

    def batch(df: DataFrame, number: int) -> None:
        now = [s.get() if isinstance(s, Reloading) else s for s in sets]
        held: list[str] = []

        def keep(items: DataFrame, tag: str) -> DataFrame:
            held.append(shared_dir(items.sparkSession, tag))
            return stored(items, held[-1])

        try:
            sink(scan(df, text_col, now, types, keep=keep), number)
        finally:
            for path in held:
                discard(df.sparkSession, path)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
