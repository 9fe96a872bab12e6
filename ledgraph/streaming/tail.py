"""Following the log: micro-batches through Structured Streaming, or pulled by cursor."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.clock import clock
from ..functions.numbering import numbered
from ..functions.schema import OPLOG
from ..functions.scratch import written
from ..operators.oplog import OpLog

POLL_S = 0.2
EVENT = ["hash", "author", "physical_ms", "logical", "op", "node_id", "node_type", "subtype", "label", "edge_id", "edge_type", "source_id", "target_id", "entity_id", "key", "value", "properties"]


def entry_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New entries of a stored log; the stream's checkpoint is the cursor."""
    reader = spark.readStream.schema(StructType.fromDDL(OPLOG))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def events(entries: DataFrame, instance_id: str | None = None) -> DataFrame:
    """Entries as event rows."""
    return entries.select(*EVENT, (F.col("author") == instance_id).alias("local") if instance_id else F.lit(False).alias("local"))


def subscribe(spark: SparkSession, path: str, callback: Callable[[DataFrame, int], None], checkpoint: str, *, instance_id: str | None = None, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Call back for each batch of new entries; restarting on the same checkpoint goes on where it ended."""
    writer = events(entry_stream(spark, path), instance_id).writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def latest_values(entries: DataFrame) -> DataFrame:
    """A running table of each property's last write, for an update-mode sink: late writes lose by their clock."""
    writes = entries.where("op = 'update_property'").select("entity_id", "key", "value", clock().alias("at"))
    return writes.groupBy("entity_id", "key").agg(F.max_by("value", "at").alias("value"))


def observations_per_window(observations: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream of observations per source and window; state is dropped behind the watermark."""
    timed = observations.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "source").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class TailSubscription:
    """Pull entries after a cursor (a set of heads), in clock order.

    A delivery that takes several batches goes on over the log as it was when it began, so entries
    that arrive meanwhile, with whatever clock, belong to the next one.  It is sorted and numbered over
    the cluster once, and a batch is a range of its numbers.  Where many entries are heads, as after
    bulk writes, so is the cursor; it is a table until it is asked for.
    """

    def __init__(self, log: Callable[[], OpLog], cursor: list[str] | None = None):
        self._log = log
        self._cursor: list[str] | DataFrame = list(cursor or [])
        self._frozen: OpLog | None = None
        self._delivery: DataFrame | None = None
        self._place = self._end = 0
        self._closed = False

    def next_batch(self, max_count: int = 1000, timeout_ms: int = 0) -> list[dict]:
        """Up to so many entries; if there is none, wait for the timeout.  A cursor that compaction has removed is an error."""
        return [r.asDict(recursive=True) for r in self.next_frame(max_count, timeout_ms).orderBy(clock(), "hash").collect()]

    def next_frame(self, max_count: int = 1000, timeout_ms: int = 0) -> DataFrame:
        """``next_batch`` as a frame, for batches of any size."""
        if max_count < 1:
            raise ValueError("max_count is at least 1")
        until = time.monotonic() + timeout_ms / 1000
        while True:
            got, n = self._pull(max_count)
            if n or time.monotonic() >= until:
                return got
            time.sleep(min(POLL_S, max(0.0, until - time.monotonic())))

    def _pull(self, max_count: int) -> tuple[DataFrame, int]:
        if self._closed:
            raise RuntimeError("the subscription is closed")
        if self._delivery is None:
            log = self._log()
            if self._cursor and not log.heads_known(self._cursor):
                raise ValueError("the cursor is stale")
            rows, self._end = numbered(log.entries_since(self._cursor).withColumn("_clock", clock()), ["_clock", "hash"], "_n")
            self._frozen, self._delivery, self._place = log, rows.drop("_clock"), 0
        first, last = self._place, min(self._place + max_count, self._end)
        got = self._delivery.where((F.col("_n") >= first) & (F.col("_n") < last)).drop("_n")
        self._place = last
        if last - first < max_count:
            if self._end or not isinstance(self._cursor, DataFrame):  # else nothing came, and the cursor stays
                self._cursor = written(self._frozen.heads(), "cursor")
            self._frozen = self._delivery = None
        return got, last - first

    def current_cursor(self) -> list[str]:
        """Heads of the last delivery that ended."""
        if isinstance(self._cursor, DataFrame):
            return sorted(r["hash"] for r in self._cursor.collect())
        return list(self._cursor)

    def close(self) -> None:
        self._closed = True
