"""Connected components by alternating star contraction, on DataFrames.

Links become stars around the smallest node in a few rounds.  Every step is a
minimum per node (combined before the shuffle) and an equi-join on the node, with
the links of very large stars dealt to several tasks, so no neighbourhood is
gathered in one place.  Each round is written to the shared folder, and the rounds
end when the links no longer change; their number grows with the logarithm of the
longest chain, so more than ``ROUNDS`` are an error.

Links that are few (``local`` at most, a bound that doesn't grow with the input) can
be joined on the driver instead, with the same result: rounds over next to nothing
cost their jobs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60
PARTS = 16
"""Tasks that a node's links are dealt to."""


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the centre of a star may have a large part of all links, so every node's are dealt to several tasks
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    return dealt.join(least, ["u", "part"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(links: pa.Table) -> pa.Table:
    """(node, label) of every node in the links (u, v), on the driver."""
    ends = pa.concat_arrays([links.column(c).combine_chunks() for c in ("u", "v")])
    nodes = ends.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = np.asarray(pc.index_in(ends, nodes)).astype(np.int64).reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        if (label[u] == label[v]).all():
            break
        # the labels themselves move, so a whole component goes with its label
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label != label[label]).any():
            label = label[label]
    return pa.table({"node": nodes, "label": nodes.take(pa.array(label))})


def components(links: DataFrame, local: int = 0) -> DataFrame:
    """(node, label) of every node in a link (a, b); the label is the component's smallest node."""
    now = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), "links")
    if local and now.count() <= local:
        return now.sparkSession.createDataFrame(_joined(now.toArrow()), now.selectExpr("u AS node", "v AS label").schema)
    state = None
    for _ in range(ROUNDS):
        now = written(_small_star(_large_star(now)), "links")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state or not after[0]:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
