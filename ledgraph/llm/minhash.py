"""Near-duplicates by an LSH forest over MinHash signatures.

A document's set is that of its distinct shingles of ``shingle`` words (the whole
sequence, if it has fewer words).  Documents with equal sets form a class; all
that follows deals with classes, so copies are never expanded into pairs.

Forest.  A signature of ``TREES * GROUP`` minima is cut into groups.  Tree t
orders the classes by the groups t, t+1, ... (each group one step of depth).

1. In the first ``SORTED_TREES`` trees the classes are sorted over the cluster,
   and neighbours that share a prefix are candidates: those with the longest
   common prefix.  In dense regions each class is also compared with the most
   typical one.  Links are confirmed on the full sets and joined to components.
   A dense region costs a few candidates a class, not its square.
2. A region (classes that share a prefix of groups) of more than ``DENSE`` classes
   goes one group deeper, until its parts are small or ``DEPTH`` is reached: each
   region has the depth that it needs.  In small ones each class outside the
   largest component is compared with all classes in other components.
3. What dense regions hold of different components, whose classes may share
   the first group only, is finished by an exact prefix filter over their
   shingles, rare ones first, which leaves the pairs that can reach the threshold.
   Regions that are one component are done, however dense.  The pairs of 2 and 3
   are made, confirmed and joined together, which saves the jobs of a pass.

So every pair that shares a first group in some tree is in one component, or is
compared, or is proven to be below the threshold; no region is cut.
A pair at 0.85 shares none of 16 first groups of 4 with probability 1e-5.

Links are confirmed by comparing the two texts' full shingle sets.

Edge cases.  Null and empty texts, and texts without words, have empty sets and
are linked with nothing.  Repeated rows are in one class.  A null id counts as
larger than any other, so it names a component only where there is no other.
An empty table gives an empty result.  Texts are never cut.  Other columns are
not read by ``near_duplicates`` and pass through ``keep_one`` whatever their names.
Of rows alike in id and text ``keep_one`` keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .adjacency import adjacent
from .common import dealt, free_name, hot_join, hot_keys, joined, spread, written
from .components import components

SHINGLE = 5
PERCENT = 80
TREES = 16
GROUP = 4
SORTED_TREES = 4
DEPTH = 4
"""Groups that the sorted order looks at."""
DENSE = 32
"""Classes of a region beyond which its rest is finished by the prefix filter."""
SLOTS = 1 << 20
"""Counters of the table that orders shingles by rarity: 8 MB, whatever the corpus."""
LOCAL_LINKS = 50_000
"""Links between classes that are joined on the driver: 2 MB of node names, whatever the corpus."""
_SEED = np.random.default_rng(88172645).integers(1, 1 << 63, (TREES * GROUP, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in text order."""
    w = bw.words(data, offsets, bw.NOT_SPACE)
    n = np.diff(w.first)
    h, at = bw.windows(w, k)
    doc = w.doc[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        parts_h, parts_d = [h], [doc]
        for size in range(1, k):
            rows = short[n[short] == size]
            if len(rows):
                first = w.first[:-1][rows]
                runs = np.stack([w.hash[first + j] for j in range(size)]).T.reshape(-1)
                parts_h.append(bw.window_hash(runs, size)[::size] ^ np.uint64(0xABCD * size))
                parts_d.append(rows)
        h, doc = np.concatenate(parts_h), np.concatenate(parts_d)
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return distinct(doc, h, len(offsets) - 1)


def distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Without a text's repeated hashes; ``doc`` is sorted.

    One sort of packed keys shows which hashes can be repeats at all; only those are compared in full.
    """
    bits = max(1, int(n_docs).bit_length())
    key = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return doc, h
    found = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    some = np.flatnonzero(twice[found] == key)
    by = np.lexsort((h[some], doc[some]))
    d, x = doc[some][by], h[some][by]
    again = np.zeros(len(some), bool)
    again[by[1:]] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    keep = np.ones(len(h), bool)
    keep[some[again]] = False
    return doc[keep], h[keep]


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, 128-bit set fingerprints (n, 2), and group hashes (n, TREES) of each text."""
    size = np.bincount(doc, minlength=n_docs)
    prints, groups = np.zeros((n_docs, 2), np.uint64), np.zeros((n_docs, TREES), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        first = np.searchsorted(doc, full)
        prints[full, 0] = np.add.reduceat(bw.mix(h ^ np.uint64(0x1234567)), first)
        prints[full, 1] = np.add.reduceat(bw.mix(h ^ np.uint64(0xFEDCBA987654321)), first)
        for t in range(TREES):
            total = np.zeros(len(full), np.uint64)
            for j in range(GROUP):
                a, b = _SEED[t * GROUP + j]
                x = (h ^ b) * a
                x ^= x >> np.uint64(29)
                total = bw.mix(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, first) + np.uint64(j))
            groups[full, t] = total
    return size, prints, groups


def _fixed(array: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    raw = np.ascontiguousarray(array)
    width = raw.dtype.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def document_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, mark, n, node, groups) of each document; node names its set and is null for empty ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bw.batches_of(batches, "text"):
            data, offsets = bw.text_buffer(part.column(1))
            doc, h = shingles(data, offsets, shingle)
            size, prints, groups = signatures(doc, h, part.num_rows)
            node = _fixed(prints.byteswap())
            if (size == 0).any():
                node = pa.array([x if n else None for x, n in zip(node.to_pylist(), size.tolist(), strict=True)], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, part.num_rows * TREES + 1, TREES), pa.int32()), pa.array(groups.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size, pa.int64()), node, listed], names=["id", "mark", "n", "node", "groups"])

    return rows.mapInArrow(run, f"id {kind}, mark long, n long, node binary, groups array<long>")


def neighbours(forest: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of classes that stand next to each other in a tree and share its first group."""
    order = ["tree", *(f"g{i}" for i in range(DEPTH)), "node"]
    found = adjacent(forest, order, ["tree", "g0"], ["node", "n"], "neighbours")
    return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb"))


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b whose sizes allow a link."""
    fit = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where("a != b")
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text): one text for each class, taken by document."""
    places = nodes.join(classes.select("node", F.col("first.id").alias("i"), F.col("first.mark").alias("m")), "node")
    own = texts.join(places, F.col("id").eqNullSafe(F.col("i")) & F.col("mark").eqNullSafe(F.col("m"))).select("node", "text")
    return own.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""
    own = written(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, texts), "texts")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [np.diff(bw.text_buffer(whole.column(whole.schema.get_field_index(c)))[1]) for c in ("ta", "tb")]
            for lo, hi in bw.shards(sizes[0] + sizes[1]):
                part = whole.slice(lo, hi - lo)
                sets = [shingles(*bw.text_buffer(part.column(part.schema.get_field_index(c))), shingle) for c in ("ta", "tb")]
                shared = intersections(sets[0], sets[1], part.num_rows)
                counts = [np.bincount(d, minlength=part.num_rows) for d, _ in sets]
                link = 100 * shared >= percent * (counts[0] + counts[1] - shared)
                yield part.select(["a", "b"]).filter(pa.array(link))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def intersections(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How many hashes row i of two lists of sets has in common."""
    salt = bw.mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    x, y = left[1] + salt[left[0]], right[1] + salt[right[0]]
    order = np.sort(np.concatenate([x, y]))
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(n, np.int64)
    found = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
    return np.bincount(left[0][twice[found] == x], minlength=n)


def across(rows: DataFrame, on: list[str], condition, values: list[str]) -> DataFrame:
    """Pairs of rows that agree in ``on`` and differ in label: those outside the largest label against all others.

    What has one label makes no pairs, however much of it there is.  A hot key's rows are dealt to
    several tasks, those outside the largest label to each of them.  Columns: a_* and b_* of the values.
    """
    sized = rows.groupBy(*on, "label").agg(F.count("*").alias("c"))
    split = sized.groupBy(*on).agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    split = written(split.select(*on, F.col("top.label").alias("main"), "n"), "split")
    hot = hot_keys(split, on)
    open_rows = written(joined(rows, split, on, values, hot).select(*on, *values, "label", "main"), "open")
    rest = open_rows.where("label != main").select(*on, *(F.col(v).alias(f"a_{v}") for v in [*values, "label"]))
    facing = open_rows.select(*on, *(F.col(v).alias(f"b_{v}") for v in [*values, "label"]))
    if hot is None:
        pairs = rest.join(facing, on)
    else:
        pairs = spread(rest, hot, on).join(dealt(facing, hot, on, [f"b_{v}" for v in values]), [*on, "_salt"]).drop("_salt")
    return pairs.where((F.col("a_label") != F.col("b_label")) & condition)


def prefix_rows(dense: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """(region, node, n, label, place) of dense nodes (node, n, label): the shingles by which those that can reach the threshold meet.

    An exact prefix filter: two sets with enough in common share one of their first shingles, in any
    order of all shingles; rare ones come first.  The order comes from counts in a table of fixed size.
    A shingle that only one set has is skipped.  The place of a shingle in both sets bounds what they
    can have in common (``reachable``).
    """
    own = dense.join(texts, "node")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for part in bw.batches_of(batches, "text"):
            _, h = shingles(*bw.text_buffer(part.column(0)), shingle)
            total += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "c"])

    counted = own.select("text").mapInArrow(tally, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # at most SLOTS rows
    table = np.zeros(SLOTS, np.int64)
    table[np.asarray(counted["slot"])] = np.asarray(counted["c"])
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for part in bw.batches_of(batches, "text"):
            doc, h = shingles(*bw.text_buffer(part.column(part.schema.get_field_index("text"))), shingle)
            often = counts[(h % np.uint64(SLOTS)).astype(np.int64)]
            order = np.lexsort((h, often, doc))
            doc, h, often = doc[order], h[order], often[order]
            size = np.bincount(doc, minlength=part.num_rows)
            first = np.cumsum(size) - size
            place = np.arange(len(doc)) - first[doc]
            keep = np.flatnonzero((place < (size - -(-percent * size // 100) + 1)[doc]) & (often > 1))
            rows = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)).take(rows) for c in ("node", "n", "label")), pa.array(h[keep].view(np.int64)), pa.array(place[keep])], names=["node", "n", "label", "region", "place"]
            )

    return own.select("node", "n", "label", "text").mapInArrow(prefixes, "node binary, n long, label binary, region long, place long").select("region", "node", "n", "label", "place")


def reachable(percent: int):
    """Whether the sizes of two sets, and the places of a shared shingle, allow a link; without places the sizes decide."""
    least, most = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    enough = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))
    return (least * 100 >= most * percent) & (F.col("a_place").isNull() | F.col("b_place").isNull() | enough)


def crowded(classes: DataFrame) -> DataFrame:
    """(tree, g0.., node, n, size): the places of all classes in all trees whose region holds another class."""
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), *(F.get("groups", (t + i) % TREES).alias(f"g{i}") for i in range(DEPTH))))
    forest = classes.select("node", "n", F.explode(trees).alias("at")).select("node", "n", "at.*")
    sizes = written(forest.groupBy("tree", "g0").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size")), "sizes")
    return hot_join(forest.withColumnRenamed("n", "n_set"), sizes, ["tree", "g0"], ["node"]).withColumnRenamed("n_set", "n")


def pivots(forest: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of each class in a dense region and the region's most typical class: that whose regions are largest in all trees."""
    score = forest.groupBy("node").agg(F.sum("size").alias("score"))
    dense = forest.where(F.col("size") > DENSE).select("tree", "g0", "node", "n").join(score, "node")
    typical = dense.groupBy("tree", "g0").agg(F.max(F.struct("score", "node", "n")).alias("p"), F.count("*").alias("n"))
    typical = written(typical.select("tree", "g0", F.col("p.node").alias("a"), F.col("p.n").alias("na"), "n"), "typical")
    return hot_join(dense.select("tree", "g0", F.col("node").alias("b"), F.col("n").alias("nb")), typical, ["tree", "g0"], ["b"]).select("a", "b", "na", "nb")


def _labelled(forest: DataFrame, labels: DataFrame) -> DataFrame:
    return written(forest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")


def _pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb"))


def deepened(members: DataFrame) -> DataFrame:
    """(region, node, n, label) of the classes in small regions, each at the least depth at which it is small."""
    kept = ["node", "n", "label"]
    small = members.where(F.col("size") <= DENSE).select(F.xxhash64("tree", "g0").alias("region"), *kept)
    # prefixes of all depths beyond the first: DEPTH - 1 rows for each place of a class in a dense region
    dense = members.where(F.col("size") > DENSE)
    levels = [dense.select("tree", "node", F.col("n").alias("n_set"), "label", F.lit(d).alias("depth"), F.xxhash64("tree", *(f"g{i}" for i in range(d))).alias("region")) for d in range(2, DEPTH + 1)]
    deep = reduce(DataFrame.unionByName, levels)
    sizes = written(deep.groupBy("depth", "region").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    if not sizes.where(F.col("n") <= DENSE).isEmpty():
        fit = deep.join(sizes.where(F.col("n") <= DENSE).drop("n"), ["depth", "region"])  # no key has more than DENSE rows
        least = fit.groupBy("tree", "node").agg(F.min(F.struct("depth", "region", "n_set", "label")).alias("x"))
        small = small.unionByName(least.select("x.region", "node", F.col("x.n_set").alias("n"), "x.label"))
    return small


def unfinished(members: DataFrame, classes: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame | None:
    """The prefix rows of the classes in dense regions that hold different components; None if there are none."""
    crowd = members.where(F.col("size") > DENSE)
    split = crowd.groupBy("tree", "g0").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("tree", "g0", "n")
    dense = written(hot_join(crowd.select("tree", "g0", "node", F.col("n").alias("n_set"), "label"), written(split, "split"), ["tree", "g0"], ["node"]).select("node", F.col("n_set").alias("n"), "label").distinct(), "dense")
    if dense.isEmpty():
        return None
    own = written(texts_of(dense.select("node"), classes, texts), "texts")
    return prefix_rows(dense, own, shingle=shingle, percent=percent)


def remaining(members: DataFrame, classes: DataFrame, texts: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) across components in small regions, and by prefix filter in dense ones.

    Small regions and shared shingles are both places where classes meet, so one join makes all pairs.
    """
    rows = deepened(members).withColumn("place", F.lit(None).cast("long"))
    more = unfinished(members, classes, texts, shingle=shingle, percent=percent)
    if more is not None:
        rows = rows.unionByName(more)
    return _pairs_of(across(written(rows, "meetings"), ["region"], reachable(percent), ["node", "n", "place"]))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, mark, n, node, least) of each document; least is the (id, mark) of its component's first document, null for empty sets."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sets = written(document_sets(docs, id_col=id_col, text_col=text_col, shingle=shingle), "sets")
    place = F.struct("id", "mark")
    named = F.when(F.col("id").isNotNull(), place)
    classes = written(
        sets.where("node is not null")
        .groupBy("node")
        .agg(F.coalesce(F.min(named), F.min(place)).alias("first"), F.max("n").alias("n"), F.max("groups").alias("groups")),
        "classes",
    )
    forest = written(crowded(classes), "forest")
    near = neighbours(forest.where(F.col("tree") < SORTED_TREES)).unionByName(pivots(forest))
    first = written(_ordered(near, percent), "pairs")
    links = written(confirmed(first, classes, texts, shingle=shingle, percent=percent), "confirmed")
    labels = written(components(links, LOCAL_LINKS), "labels")
    more = remaining(_labelled(forest, labels), classes, texts, shingle=shingle, percent=percent)
    more = written(_ordered(more, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = written(confirmed(more, classes, texts, shingle=shingle, percent=percent), "confirmed")
        if not found.isEmpty():
            labels = written(components(links.unionByName(found), LOCAL_LINKS), "labels")
    of_class = written(classes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label")), "labelled")
    # a null id stands behind all others
    least = of_class.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("first.id").isNotNull(), F.col("first"))), F.min("first")).alias("least"), F.count("*").alias("n"))
    component = hot_join(of_class, written(least, "least"), ["label"], ["node"]).select("node", "least")
    return sets.select("id", "mark", "n", "node").join(component, "node", "left")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest id in reach) and kept (whether it has that id)."""
    out = groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    component_id = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of each component, and all without words, with all their columns; rows alike in id and text are one."""
    out = groups(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    i, m = (free_name(docs, c) for c in ("stay_id", "stay_mark"))
    stay = out.where(F.col("node").isNull() | F.struct("id", "mark").eqNullSafe(F.col("least"))).select(F.col("id").alias(i), F.col("mark").alias(m)).distinct()
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(stay, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(mark) == F.col(m)), "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)
