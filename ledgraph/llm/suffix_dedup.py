"""Passages of ``MIN_WORDS`` words or more that repeat across documents.

Every window of ``MIN_WORDS`` words is owned by its smallest hash of ``SEED``
words (the leftmost of equals).  Owner and offset follow from the window's words
alone, so equal windows meet under one owner, and the windows of one owner are a
run.  One row an owner is grouped by the owner's hash and then by the hash of
all words of its run:

* documents with the same run share all its windows: the first of them stands
  for them all;
* where one owner has several runs, the first document of each gives out the
  run's windows one by one, and these are grouped;
* each run gets back which of its windows another document has, and the first
  document of these; each document gets that from its runs.

So no document is compared with chosen others, and nothing depends on how many
share a passage.  Windows are equal if two 64-bit hashes (of the owner and of
the whole) are.  A passage's extent is a maximal row of repeated windows.

A document is a copy if an earlier one (smaller id, then text hash) has one of
its windows; the first place of all has no one before it, so something is always
kept.  Its class is the connected component of documents that share windows.

Edge cases.  Null and empty texts have no words.  Rows alike in id and text are
one document; repeats inside one document don't count.  An empty table gives an
empty result.  Texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import hot_join, written
from .components import components

MIN_WORDS = 50
SEED = 10
SPAN = 32
_FAR = np.uint64((1 << 64) - 1)


def minimisers(w: bw.Words, seed: int = SEED, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Places (of words) whose seed hash is the smallest of some window, and these hashes."""
    h = bw.window_hash(w.hash, seed)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    inside = w.doc[:n] == w.doc[seed - 1 :]
    h = np.where(inside, h, _FAR)
    # windows lie within a text, or hold the whole of a short one
    low, width = np.concatenate([h, np.full(span - 1, _FAR)]), 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    low = low[:n]
    after = np.concatenate([np.zeros(span - 1, np.uint64), low])
    width = 1
    while width < span:
        step = min(width, span - width)
        after = np.maximum(after[: len(after) - step], after[step:])
        width += step
    chosen = np.flatnonzero((after == h) & inside)
    return chosen, h[chosen]


def owners(w: bw.Words, seed: int = SEED, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(first window, windows, owner's hash, hash of the run's words) of each run of windows with one owner; windows by their first word."""
    n = len(w.hash) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = bw.window_hash(w.hash, seed)
    span = min_words - seed + 1
    low, at, width = h, np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = h[at]
        width += step
    start = np.flatnonzero(w.doc[:n] == w.doc[min_words - 1 :])
    own = at[start]
    # owners never go back within a text, so equal ones are a run
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([head, [len(start)]]))
    first, own = start[head], own[head]
    run = bw.mix(_hash(w, first, first + count - 1 + min_words) ^ bw.mix((own - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)))
    return first, count, h[own], run


def _hash(w: bw.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end."""
    power, inverse = bw._power_tables(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * power[:-1], out=sums[1:])
    return bw.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _runs(rows: DataFrame, kind: str, seed: int, min_words: int) -> DataFrame:
    """(id, mark, place, n, f0, run) of each run of windows; place is its first word's number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bw.batches_of(batches, "text"):
            w = bw.words(*bw.text_buffer(part.column(1)), bw.NOT_SPACE)
            first, count, f0, whole = owners(w, seed, min_words)
            doc = w.doc[first] if len(first) else first
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(2).take(at), pa.array(first - w.first[doc], pa.int32()), pa.array(count, pa.int32()), pa.array(f0.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["id", "mark", "place", "n", "f0", "run"],
            )

    return rows.mapInArrow(run, f"id {kind}, mark long, place int, n int, f0 long, run long")


def _windows(texts: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(id, mark, f0, run, k, w, many): the windows of the runs in ``runs``, one by one; repeated texts repeat theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bw.batches_of(batches, "text", 1 << 20):
            w = bw.words(*bw.text_buffer(part.column(1)), bw.NOT_SPACE)
            lists = part.column(3)
            doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            place, n, f0, whole, many = (flat.field(i) for i in range(5))
            count = n.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(count)), count)
            k = bw.ragged(np.zeros(len(count), np.int64), count)
            start = w.first[doc[row]] + place.to_numpy()[row] + k
            at, of = pa.array(doc[row]), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(2).take(at), f0.take(of), whole.take(of), pa.array(k, pa.int32()), pa.array(_hash(w, start, start + min_words).view(np.int64)), many.take(of)],
                names=["id", "mark", "f0", "run", "k", "w", "many"],
            )

    return texts.mapInArrow(run, f"id {kind}, mark long, f0 long, run long, k int, w long, many boolean")


def _passages(texts: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Each document's rows of repeated windows as passages, in words and code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bw.batches_of(batches, "text"):
            data, offsets = bw.text_buffer(part.column(1))
            w, chars = bw.words(data, offsets, bw.NOT_SPACE), bw.code_points(data)
            docs, first, end = [], [], []
            for d, runs in enumerate(part.column(3).to_pylist()):
                at = np.unique(np.array([r["place"] + k for r in runs for k in range(r["mask"].bit_length()) if r["mask"] >> k & 1], np.int64))
                cut = np.flatnonzero(np.diff(at) > 1)
                docs += [d] * (len(cut) + 1)
                first += at[np.concatenate([[0], cut + 1])].tolist()
                end += (at[np.concatenate([cut, [len(at) - 1]])] + min_words).tolist()
            doc, first, end = (np.array(x, np.int64) for x in (docs, first, end))
            base, zero, at = w.first[doc], chars[offsets[doc]], pa.array(doc)
            spans = [first, end, chars[w.start[base + first]] - zero, chars[w.end[base + end - 1]] - zero]
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in (0, 2, 4, 5)), *(pa.array(x, pa.int64()) for x in spans)], names=["id", "mark", "copy", "class_id", "first_word", "end_word", "start", "end"])

    return texts.mapInArrow(run, f"id {kind}, mark long, copy boolean, class_id {kind}, first_word long, end_word long, start long, end long")


def _with_text(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of the documents in ``facts``, as (id, text, mark) and what else the facts hold; repeated rows stay."""
    theirs = facts.withColumnRenamed("id", "i").withColumnRenamed("mark", "m")
    own = rows.join(theirs, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    return own.select("id", "text", "mark", *(c for c in facts.columns if c not in ("id", "mark")))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(id, mark, copy, class_id, first_word, end_word, start, end): passages of at least ``min_words`` words that another document has, too; offsets in words and in code points.

    ``copy`` and ``class_id`` (the smallest id that shared passages lead to) are the document's.
    """
    if not 0 <= min_words - seed < 63:
        raise ValueError("a run's windows would not fit a mask")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    doc = F.struct("id", "mark")
    runs = _runs(rows, kind, seed, min_words)
    grouped = runs.groupBy("f0", "run").agg(F.min(F.struct("id", "mark", "place")).alias("r"), F.max(doc).alias("last"), F.first("n").alias("n"), F.count("*").alias("held"))
    grouped = written(grouped.select("f0", "run", F.struct("r.id", "r.mark").alias("first"), "last", "r.place", "n", "held"), "runs")
    owned = grouped.groupBy("f0").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("last").alias("high")).where("low != high")
    owned = written(owned.select("f0", "kinds", F.col("kinds").alias("n")), "owned")
    shared = written(hot_join(grouped.withColumnRenamed("n", "windows"), owned, ["f0"], ["run"]).withColumnRenamed("windows", "n"), "shared").withColumn("many", F.expr("first != last"))
    one = shared.where("kinds = 1").select("f0", "run", F.expr("shiftleft(1L, n) - 1").alias("mask"), "first")
    wanted = shared.where("kinds > 1").groupBy("first").agg(F.collect_list(F.struct("place", "n", "f0", "run", "many")).alias("runs")).select("first.id", "first.mark", "runs")
    windows = written(_windows(_with_text(rows, wanted), kind, min_words), "windows")
    met = windows.groupBy("f0", "w").agg(F.min(doc).alias("first"), F.max(doc).alias("last"), F.max("many").alias("many"), F.count("*").alias("n")).where("many or first != last")
    met = written(met.select("f0", "w", "first", "n"), "met")
    back = written(hot_join(windows, met, ["f0", "w"], ["id", "mark", "run", "k"]).groupBy("f0", "run", doc.alias("holder"), "first").agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask")), "back")
    several = back.groupBy("f0", "run").agg(F.expr("bit_or(mask)").alias("mask"), F.min("first").alias("first"))
    # a run that many documents have is hot
    masks = written(one.unionByName(several).join(shared.select("f0", "run", F.col("held").alias("n")), ["f0", "run"]), "masks")
    found = hot_join(runs.drop("n"), masks, ["f0", "run"], ["id", "mark", "place"]).select("id", "mark", "place", "mask", "first")
    per_doc = written(found.groupBy("id", "mark").agg(F.collect_set(F.struct("place", "mask")).alias("at"), F.min("first").alias("first"), F.collect_set(F.xxhash64("first.id", "first.mark")).alias("firsts")), "found")
    # a run's documents are linked with its first window's document, and that run's first with the other windows' first
    key = F.xxhash64("id", "mark")
    links = per_doc.select(key.alias("a"), F.explode("firsts").alias("b")).unionByName(back.select(F.xxhash64("holder.id", "holder.mark").alias("a"), F.xxhash64("first.id", "first.mark").alias("b")))
    labels = components(links.where("a != b").distinct()).distinct()
    named = written(per_doc.withColumn("node", key).join(labels, "node"), "named")
    # a null id is smallest, as in the order of documents
    classes = written(named.groupBy("label").agg(F.min(F.struct("id")).alias("least"), F.count("*").alias("n")), "classes")
    facts = hot_join(named, classes, ["label"], ["node"]).select("id", "mark", "at", F.expr("first < struct(id, mark)").alias("copy"), F.col("least.id").alias("class_id"))
    return _passages(_with_text(rows, facts), kind, min_words).distinct()


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document with repeats: n_repeats, n_words in them, spans, the class of documents it shares passages with and whether some repeat is a copy."""
    spans = F.array_sort(F.collect_set(F.struct("first_word", "end_word", "start", "end")))
    covered = F.aggregate(
        "all_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["end_word"] - F.greatest(x["first_word"], a["to"]))).alias("n"), F.greatest(a["to"], x["end_word"]).alias("to")
        ),
    )["n"]
    grouped = found.groupBy("id", "mark").agg(spans.alias("all_spans"), F.min("class_id").alias("class_id"), F.max("copy").alias("copy"))
    written_spans = F.array_join(F.array_distinct(F.transform("all_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))), ",")
    return grouped.select(F.col("id").alias(id_col), F.size("all_spans").cast("long").alias("n_repeats"), covered.alias("n_words"), written_spans.alias("spans"), "class_id", "copy")
