"""Observation log: (source, timestamp_ms) -> (value, metadata), last write kept."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.schema import OBSERVATIONS

MAX_SOURCE_BYTES = 65_535


class ObservationLog:
    """Rows as a DataFrame; ``seq`` orders writes of one key."""

    def __init__(self, df: DataFrame, deduplicated: bool = False):
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0).cast("long"))
        self._df = df if deduplicated else self._last(df)

    @staticmethod
    def _last(df: DataFrame) -> DataFrame:
        best = df.groupBy("source", "timestamp_ms").agg(F.max_by(F.struct("value", "metadata", "seq"), "seq").alias("x"))
        return best.select("source", "timestamp_ms", "x.value", "x.metadata", "x.seq")

    @property
    def df(self) -> DataFrame:
        return self._df.select("source", "timestamp_ms", "value", "metadata")

    def append(self, source: str, value: float, metadata: dict[str, str] | None = None, now_ms: int | None = None) -> ObservationLog:
        """One observation at this moment; of the same millisecond the last one counts."""
        if len(source.encode()) > MAX_SOURCE_BYTES:
            raise ValueError("source is too long")
        at = int(time.time() * 1000) if now_ms is None else now_ms
        return self.append_batch(self._df.sparkSession.createDataFrame([(source, at, float(value), metadata or {})], OBSERVATIONS))

    def append_values(self, rows: DataFrame, base_ms: int, order: list[str]) -> ObservationLog:
        """Rows (source, value, metadata) in the given order, each a millisecond after the one before."""
        placed, _ = numbered(rows, order, "_n")
        return self.append_batch(placed.withColumn("timestamp_ms", F.lit(base_ms).cast("long") + F.col("_n")).drop("_n"))

    def append_batch(self, rows: DataFrame) -> ObservationLog:
        """Rows (source, timestamp_ms, value, metadata) on top of what is there; too long sources are an error."""
        ok = F.when(F.octet_length("source") <= MAX_SOURCE_BYTES, F.col("source")).otherwise(F.raise_error(F.lit("source is too long")))
        top = (self._df.agg(F.max("seq")).first()[0] or 0) + 1
        added = rows.withColumn("source", ok).withColumn("seq", F.lit(top).cast("long") + F.monotonically_increasing_id())
        return ObservationLog(self._df.unionByName(added.select(self._df.columns)))

    def query(self, source: str, since_ms: int) -> DataFrame:
        return self.df.where((F.col("source") == source) & (F.col("timestamp_ms") >= since_ms)).orderBy("timestamp_ms")

    def query_latest(self, source: str | None = None) -> DataFrame:
        """The last row of a source, or of each."""
        df = self.df if source is None else self.df.where(F.col("source") == source)
        best = df.groupBy("source").agg(F.max_by(F.struct("timestamp_ms", "value", "metadata"), "timestamp_ms").alias("x"))
        return best.select("source", "x.*")

    def sources(self) -> DataFrame:
        return self.df.select("source").distinct().orderBy("source")

    def truncate(self, before_ms: int) -> tuple[ObservationLog, int]:
        gone = self._df.where(F.col("timestamp_ms") < before_ms).count()
        return ObservationLog(self._df.where(F.col("timestamp_ms") >= before_ms), True), gone

    def count(self) -> int:
        return self._df.count()
