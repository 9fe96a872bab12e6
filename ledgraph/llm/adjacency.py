"""Neighbours in a total order over the cluster.

Rows are range-partitioned and sorted by the whole order, which splits even rows
that share most of it; neighbours that agree in the ``same`` columns become
pairs.  What stands at the ends of the tasks' ranges is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import written


def adjacent(rows: DataFrame, order: list[str], same: list[str], carry: list[str], name: str) -> DataFrame:
    """(a_*, b_*) of the carried columns for each pair of neighbours; a stands before b. ``same`` are integer columns."""
    rows = rows.select(*dict.fromkeys([*order, *carry]))
    kinds = {f.name: f.dataType for f in rows.schema}
    halves = [T.StructField(f"{side}_{c}", kinds[c]) for side in "ab" for c in carry]
    schema = T.StructType([*halves, *(T.StructField(f"key_{c}", T.LongType()) for c in same), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None

        def end(row: pa.RecordBatch, at: int) -> pa.RecordBatch:
            kept = [row.column(row.schema.get_field_index(c)) for c in carry]
            keys = [row.column(row.schema.get_field_index(c)).cast(pa.int64()) for c in same]
            arrays = [*kept, *(pa.nulls(1, arrow.field(len(carry) + i).type) for i in range(len(carry))), *keys, pa.array([at], pa.int64())]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

        for part in batches:
            if not part.num_rows:
                continue
            if last is None:
                yield end(part.slice(0, 1), task * 2)
            else:
                part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
            keys = [np.asarray(part.column(part.schema.get_field_index(c))) for c in same]
            at = pa.array(np.flatnonzero(np.logical_and.reduce([k[1:] == k[:-1] for k in keys])))
            after = pa.array(np.asarray(at) + 1)
            arrays = [part.column(part.schema.get_field_index(c)).take(i) for i in (at, after) for c in carry]
            arrays += [pa.nulls(len(at), pa.int64()) for _ in range(len(same) + 1)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
            last = part.slice(part.num_rows - 1, 1)
        if last is not None:
            yield end(last, task * 2 + 1)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(sorted_rows.mapInArrow(run, schema), name)
    # two rows a task at most
    ends = sorted(found.where("at is not null").collect(), key=lambda r: r["at"])
    seams = [
        tuple([x[f"a_{c}"] for c in carry] + [y[f"a_{c}"] for c in carry])
        for x, y in zip(ends, ends[1:], strict=False)
        if x["at"] % 2 == 1 and all(x[f"key_{c}"] == y[f"key_{c}"] for c in same)
    ]
    pairs = found.where("at is null").select(*(h.name for h in halves))
    if seams:
        pairs = pairs.unionByName(found.sparkSession.createDataFrame(seams, T.StructType(halves)))
    return pairs
