"""Chunk results that come late, twice or out of order, settled by keyed state.

A chunk's key is (source, variable, chunk).  Its state is the highest version that was let through; a result passes if its version is higher than
that, so after any order of arrivals the last row of a key is its newest result, and repeats make no row.  Results carry the time at
which they were asked for: what is more than ``late`` behind the newest is dropped by the watermark, and a key that the watermark has passed is forgotten by a
timer, so the state holds the keys of that stretch of time and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Lets a key's result through if it is newer than all before it."""

    def __init__(self, names: list[str], version: str, time: str):
        self.names, self.version, self.time = names, version, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", T.StructType([T.StructField("version", T.LongType()), T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, latest = None, None
        for r in rows:
            asked = int(r[self.time].timestamp() * 1000)
            latest = asked if latest is None else max(latest, asked)
            if best is None or r[self.version] > best[self.version]:
                best = r
        held = self.passed.get() if self.passed.exists() else None
        until = latest if held is None else max(latest, held[1])
        newer = held is None or best[self.version] > held[0]
        if held is None or newer or until != held[1]:
            if held is not None and until != held[1]:
                self.handle.deleteTimer(held[1] + 1)
            if held is None or until != held[1]:
                self.handle.registerTimer(until + 1)
            self.passed.update((best[self.version] if newer else held[0], until))
        if newer:
            yield Row(**{n: best[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.passed.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_chunks(stream: DataFrame, keys: list[str], version: str = "version", time: str = "asked", late: str = "1 hour") -> DataFrame:
    """Rows of ``stream`` that are newer than all rows of their key before them; at most one a key and micro-batch.  A streaming DataFrame for the
    update mode.  Rows without a version or a time are left out.  The session's state store has to be ``PROVIDER``."""
    marked = stream.where(F.col(version).isNotNull() & F.col(time).isNotNull()).withColumn(version, F.col(version).cast("long")).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    fields = T.StructType([T.StructField(f.name, f.dataType) for f in marked.schema.fields])
    return marked.groupBy(*keys).transformWithState(statefulProcessor=Newest(marked.columns, version, time), outputStructType=fields, outputMode="Update", timeMode="EventTime")


def keep_newest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str = "version", **how):
    """Write what passes ``newest_chunks`` to a folder a batch; a batch that runs again replaces itself.  ``read_newest`` reads the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    passed = newest_chunks(stream, keys, version, **how)
    return passed.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(write).start()


def read_newest(spark, path: str, keys: list[str], version: str = "version") -> DataFrame:
    """One row a key: of the batches' rows, the one with the highest version."""
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c != "batch"]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(version)).alias("_r")).select("_r.*")
