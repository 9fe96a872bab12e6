"""What the operators share: tables, shared scratch space and batch output."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32
"""Tasks that a hot key's rows are dealt to."""
HOT_KEYS = 1000
"""A key is hot if it has more than one row in so many of all; so there are fewer hot keys than this."""
HOT_ROWS = 256
"""Rows that a key may have in one task, however few there are in all."""

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset in a local session, as in tests, a temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = f"file://{tempfile.mkdtemp(prefix='ledgraph-')}"
        found = _local_scratch[app]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def hot_keys(facts: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys of ``facts`` (one row a key, ``n`` rows each) that have too many rows for one task; None if there are none."""
    total, most = facts.agg(F.sum("n"), F.max("n")).first()
    if not total or most <= HOT_ROWS or most * HOT_KEYS <= total:
        return None
    found = facts.where((F.col("n") * HOT_KEYS > total) & (F.col("n") > HOT_ROWS)).select(*on).collect()
    return facts.sparkSession.createDataFrame(found, facts.select(*on).schema).withColumn("_hot", F.lit(True))


def dealt(rows: DataFrame, hot: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Rows with ``_salt``: a hot key's rows are dealt to several tasks by the columns ``by``."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")


def spread(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Rows with ``_salt``: a hot key's rows go to each of its tasks."""
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")


def hot_join(rows: DataFrame, facts: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Rows with the fact of their key; ``facts`` has one row a key, and ``n``, how many rows have it.

    A hot key's rows are dealt by ``by`` to several tasks, and its fact goes to each of
    them; hot keys are fewer than ``HOT_KEYS``, so they are broadcast.  ``facts`` is read
    several times and should be a written table.  Keys are not null.
    """
    return joined(rows, facts, on, by, hot_keys(facts, on))


def joined(rows: DataFrame, facts: DataFrame, on: list[str], by: list[str], hot: DataFrame | None) -> DataFrame:
    """``hot_join`` where the hot keys are known."""
    if hot is None:
        return rows.join(facts.drop("n"), on)
    return dealt(rows, hot, on, by).join(spread(facts.drop("n"), hot, on), [*on, "_salt"]).drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batch(**columns) -> pa.RecordBatch:
    """A record batch from arrays, in the order given."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
