"""Consecutive numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

_INSIDE = 33
"""Bits of ``monotonically_increasing_id`` that number a task's rows."""


def numbered(df: DataFrame, order: list[str], name: str = "number") -> tuple[DataFrame, int]:
    """The rows with numbers from 0 in the given order, and how many there are: ranges are sorted in parallel, and only their counts meet."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright("_at", _INSIDE).alias("_task")).agg(F.count("*").alias("n")).collect()
    before, n = [], 0
    for r in sorted(counts, key=lambda r: r["_task"]):
        before.append((r["_task"], n))
        n += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_task long, _before long"))
    rows = placed.withColumn("_task", F.shiftright("_at", _INSIDE)).join(starts, "_task")
    return rows.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _INSIDE) - 1)).drop("_at", "_task", "_before"), n
