"""Benchmark decontamination over suffix arrays of the training texts.

The training texts are dealt in shards.  All suffixes of a shard's word sequences
are sorted by prefix doubling (a suffix ends with its text).  Every suffix of
every benchmark item is found by binary search, its range narrowed word by word
until it is empty or the item ends; so each place is met with the length of its
longest verbatim match.  Only shards see texts, so nothing is shuffled.

Words are looked up by 64-bit hash, and those of a shard that share one with an
item's word are compared with it byte by byte before the array is built.  Of an
item's suffixes those that begin another of its suffixes are left out, since
whatever they match, that one matches: a repeated phrase costs one search, not
one for each of its repeats.  Doubling ends at the longest item's length.

Definitions.  Words are maximal runs of letters, digits and non-ASCII bytes in
lower-cased text.  A window is ``window`` consecutive words of an item; an item
of fewer words (but not none) is a single window.  A document word inside an
occurrence of a window is hit.

Edge cases.  A null or empty text has no words and is never contaminated; a
null or empty item has no windows.  Texts of any length are one shard at least
and never cut.  Repeated rows are judged alike, each on its own row.  Items that
share an id count once.  An item with a null id counts under the name ``null``.
With an empty benchmark nothing is hit; empty documents give an empty result.
Other columns of the documents pass through ``decontaminate`` whatever their
names, and are not read elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import written

WINDOW = 10
BLOCK_BYTES = 8 << 20
"""Benchmark text that goes to the executors at once; a larger benchmark takes several passes, one after another."""
EXPAND = 1 << 20
"""Places that are listed at once."""
_OTHER = np.uint64(0x5DEECE66D1234567)


class Probe(NamedTuple):
    """A block of items and those of their suffixes that are searched for."""

    names: list[str]
    data: np.ndarray
    """The items' bytes in lower case."""
    start: np.ndarray
    end: np.ndarray
    """Each word's bytes."""
    hash: np.ndarray
    vocabulary: np.ndarray
    """Distinct hashes, sorted, and in ``sample`` a word for each."""
    sample: np.ndarray
    first: np.ndarray
    """Offsets of the items into the words."""
    place: np.ndarray
    """Where each suffix starts in ``hash``."""
    length: np.ndarray
    """Words from there to the item's end."""
    need: np.ndarray
    """Words that an occurrence must match."""
    item: np.ndarray


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether span i of ``a`` and span i of ``b`` (none empty) have the same bytes."""
    size = a_end - a_start
    same = size == b_end - b_start
    at = np.flatnonzero(same)
    for lo, hi in bw.shards(size[at], EXPAND):
        some = at[lo:hi]
        n = size[some]
        equal = a[bw.ragged(a_start[some].astype(np.int64), n)] == b[bw.ragged(b_start[some].astype(np.int64), n)]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same


def probe_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Probe:
    names = ["null" if i is None else str(i) for i, _ in items]
    data, offsets = bw.text_buffer(pa.array([t for _, t in items], pa.string()))
    w = bw.words(data, offsets, bw.ALNUM)
    folded = bw.LOWER[data]
    vocabulary, sample, where = np.unique(w.hash, return_index=True, return_inverse=True)
    if not same_bytes(folded, w.start, w.end, folded, w.start[sample][where], w.end[sample][where]).all():
        raise ValueError("two words of the benchmark share a hash")
    size = np.diff(w.first)
    n = len(w.hash)
    stop = np.repeat(w.first[1:], size)
    length, need = stop - np.arange(n), np.minimum(window, np.repeat(size, size))
    searched = length >= need
    if n:
        # within an item, a suffix that begins another one begins the next one in order
        rank = suffix_ranks(where, stop, int(size.max()))
        order = np.lexsort((rank, w.doc))
        here, after = order[:-1], order[1:]
        sums = np.zeros(n + 1, np.uint64)
        power, inverse = bw._power_tables(n + 1)
        np.cumsum(w.hash * power[:-1], out=sums[1:])
        fits = (w.doc[here] == w.doc[after]) & (length[after] > length[here])
        here, after = here[fits], after[fits]
        k = length[here]
        begins = (sums[here + k] - sums[here]) * inverse[here] == (sums[after + k] - sums[after]) * inverse[after]
        searched[here[begins]] = False
    at = np.flatnonzero(searched)
    small = [x.astype(np.int32) for x in (w.start, w.end)]
    return Probe(names, folded, *small, w.hash, vocabulary, sample.astype(np.int32), w.first.astype(np.int32), *(x[at].astype(np.int32) for x in (np.arange(n), length, need, w.doc)))


def suffix_ranks(code: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """Rank of each suffix of ``code`` among all, compared over ``most`` values at least.

    A suffix ends before ``stop``; what has ended stands before what goes on.  Equal suffixes share a rank: that
    of the first of them.  Each round doubles what has been compared, for those suffixes that are still tied.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = begin
    single = head & np.concatenate([head[1:], [True]]) if n else head
    tied = order[~single]
    done = 1
    while len(tied) and done < most:
        ahead = tied + done
        second = np.where(ahead < stop[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        base = rank[tied]
        key = base * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, base, second, key = tied[by], base[by], second[by], key[by]
        old = np.concatenate([[True], base[1:] != base[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(tied))
        inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        rank[tied] = base + inside
        if old.sum() == new.sum() and not (second == 0).any():
            break  # what has been compared decides all that follows
        single = new & np.concatenate([new[1:], [True]])
        tied = tied[~single & (second > 0)]
        done *= 2
    return rank


class Shard(NamedTuple):
    """A shard's words and its suffix array."""

    code: np.ndarray
    """Words as numbers, in the order of the array."""
    known: np.ndarray
    """Hash of each number, sorted."""
    stop: np.ndarray
    array: np.ndarray


def shard_of(w: bw.Words, data: np.ndarray, probes: list[Probe]) -> Shard:
    h = w.hash
    folded = bw.LOWER[data]
    for probe in probes:
        if not len(probe.vocabulary) or not len(h):
            continue
        found = np.minimum(np.searchsorted(probe.vocabulary, h), len(probe.vocabulary) - 1)
        at = np.flatnonzero(probe.vocabulary[found] == h)
        word = probe.sample[found[at]]
        other = at[~same_bytes(folded, w.start[at], w.end[at], probe.data, probe.start[word], probe.end[word])]
        if len(other):  # another word with the same hash
            h = h.copy()
            h[other] ^= _OTHER
    known, code = np.unique(h, return_inverse=True)
    stop = w.first[w.doc + 1] if len(h) else np.zeros(0, np.int64)
    longest = max((int(p.length.max()) for p in probes if len(p.length)), default=1)
    return Shard(code, known, stop, np.argsort(suffix_ranks(code, stop, longest), kind="stable"))


def _bound(s: Shard, lo: np.ndarray, hi: np.ndarray, ahead: int, wanted: np.ndarray, after: bool) -> np.ndarray:
    """First place of each range whose word ``ahead`` is not smaller than (or, with ``after``, greater than) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        suffix = s.array[mid]
        at = suffix + ahead
        value = np.where(at < s.stop[suffix], s.code[np.minimum(at, len(s.code) - 1)], -1)
        low = value <= wanted[open_] if after else value < wanted[open_]
        lo[open_[low]] = mid[low] + 1
        hi[open_[~low]] = mid[~low]


def matches(s: Shard, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffix, place, words) of all places that share at least ``need`` words with a probe suffix, with all that they share."""
    if not len(s.code) or not len(probe.place):
        return
    number = np.minimum(np.searchsorted(s.known, probe.hash), len(s.known) - 1)
    number = np.where(s.known[number] == probe.hash, number, -2)
    suffix = np.arange(len(probe.place))
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(s.array), np.int64)
    k = 0
    while len(suffix):
        ended = probe.length[suffix] == k
        if ended.any():
            yield from _listed(s, suffix[ended], lo[ended], hi[ended], k)
            suffix, lo, hi = suffix[~ended], lo[~ended], hi[~ended]
        wanted = number[probe.place[suffix] + k]
        low = _bound(s, lo, hi, k, wanted, False)
        high = _bound(s, low, hi, k, wanted, True)
        full = probe.need[suffix] <= k
        if full.any():
            yield from _listed(s, suffix[full], lo[full], low[full], k)
            yield from _listed(s, suffix[full], high[full], hi[full], k)
        live = low < high
        suffix, lo, hi = suffix[live], low[live], high[live]
        k += 1


def _listed(s: Shard, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for a, b in bw.shards(hi - lo, EXPAND):
        for low in range(0, int((hi[a:b] - lo[a:b]).max()), EXPAND):
            begin = np.minimum(lo[a:b] + low, hi[a:b])
            count = np.minimum(hi[a:b] - begin, EXPAND)
            place = s.array[bw.ragged(begin, count)]
            if len(place):
                yield np.repeat(suffix[a:b], count), place, np.full(len(place), k)


def judge(w: bw.Words, data: np.ndarray, n_docs: int, probes: list[Probe]) -> tuple[np.ndarray, list[list[str]]]:
    """Hit words of each text, and the names of the items with occurring windows."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    found: dict[int, set[str]] = {}
    s = shard_of(w, data, probes)
    for probe in probes:
        for suffix, place, got in matches(s, probe):
            edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + got, minlength=len(edge))
            doc, item = w.doc[place], probe.item[suffix]
            for d, i in zip(*np.divmod(np.unique(doc * len(probe.names) + item), len(probe.names)), strict=True):
                found.setdefault(int(d), set()).add(probe.names[i])
    hit = np.cumsum(edge[:-1]) > 0
    n_hit = np.bincount(w.doc[hit], minlength=n_docs)
    return n_hit, [sorted(found.get(d, ())) for d in range(n_docs)]


def probe_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Probe]:
    """The benchmark as probes of bounded text each."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        n = len(row.t.encode())
        if block and size + n > block_bytes:
            yield probe_of(block, window)
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield probe_of(block, window)


def _judged(batches: Iterator[pa.RecordBatch], text_col: str, probes: list[Probe]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[str]]]]:
    for part in bw.batches_of(batches, text_col):
        data, offsets = bw.text_buffer(part.column(part.schema.get_field_index(text_col)))
        w = bw.words(data, offsets, bw.ALNUM)
        yield part, np.diff(w.first), *judge(w, data, part.num_rows, probes)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted names), items_sha256, contaminated.

    A benchmark of up to ``block_bytes`` of text goes to the executors whole.  A larger
    one is taken in blocks: each is a pass over the documents that writes hit spans,
    which are merged per document.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    blocks = probe_blocks(benchmark, item_id_col, item_text_col, window, block_bytes)
    first = [p for p in [next(blocks, None)] if p is not None]
    rest = next(blocks, None)
    if rest is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, n_words, n_hit, found in _judged(batches, "text", shared.value):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                    names=["k", "n_words", "n_hit", "items"],
                )

        out = rows.mapInArrow(run, f"k {kind}, n_words long, n_hit long, items array<string>")
    else:
        out = _in_blocks(rows, (p for source in ([first[0], rest], blocks) for p in source))
    return out.select(
        F.col("k").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _found(rows: DataFrame, probe: Probe) -> tuple[DataFrame, object]:
    """(k, d, item, first_word, end_word, item_word): the verbatim matches of the block's items that go on to neither side, and the broadcast."""
    kind = rows.schema["k"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = shared.value
        for part in bw.batches_of(batches, "text"):
            data, offsets = bw.text_buffer(part.column(1))
            w = bw.words(data, offsets, bw.ALNUM)
            digests = pa.array([hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest() for i in range(part.num_rows)], pa.binary())
            for suffix, place, got in matches(shard_of(w, data, [probe]), probe):
                doc, item = w.doc[place], probe.item[suffix]
                word = probe.place[suffix] - probe.first[item]
                inner = (place > w.first[doc]) & (word > 0)
                inner[inner] = w.hash[place[inner] - 1] == probe.hash[probe.place[suffix[inner]] - 1]
                # a window inside a longer match is part of that one; a short item is its only window
                new = ~inner
                doc, item, place, got, word = doc[new], item[new], place[new], got[new], word[new]
                at, begin = pa.array(doc), place - w.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), digests.take(at), pa.array([probe.names[i] for i in item.tolist()], pa.string()), *(pa.array(x, pa.int64()) for x in (begin, begin + got, word))],
                    names=["k", "d", "item", "first_word", "end_word", "item_word"],
                )

    return rows.mapInArrow(run, f"k {kind}, d binary, item string, first_word long, end_word long, item_word long"), shared


def locations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where items stand in documents: (id, item, first_word, end_word, item_word) of each verbatim match that can't be made longer; words are numbered from 0."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    return _all_found(rows, probe_blocks(benchmark, item_id_col, item_text_col, window, block_bytes)).select(F.col("k").alias(id_col), "item", "first_word", "end_word", "item_word")


def _all_found(rows: DataFrame, probes: Iterator[Probe]) -> DataFrame:
    """What ``_found`` gives for all blocks; each block's matches are written before the next one is read, so one block is in memory at a time."""
    out: DataFrame | None = None
    for probe in probes:
        found, shared = _found(rows, probe)
        found = written(found, "matches")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.where("false").select("k", F.lit(b"").alias("d"), F.lit("").alias("item"), *(F.lit(0).cast("long").alias(c) for c in ("first_word", "end_word", "item_word")))
    return out


def _in_blocks(rows: DataFrame, probes: Iterator[Probe]) -> DataFrame:
    """Matches of all blocks, merged per text; each row of the input gets its verdict, repeated rows included."""
    found = _all_found(rows, probes).withColumnRenamed("k", "of")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct(F.col("first_word").alias("s"), F.col("end_word").alias("e")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["e"]).alias("to"),
        ),
    )["n"]
    merged = found.groupBy("of", "d").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    kind = rows.schema["k"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bw.batches_of(batches, "text"):
            data, offsets = bw.text_buffer(part.column(1))
            digests = [hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(bw.words(data, offsets, bw.ALNUM).first), pa.int64())], names=["k", "d0", "n_words"])

    keyed = rows.mapInArrow(counted, f"k {kind}, d0 binary, n_words long")
    joined = keyed.join(merged, F.col("k").eqNullSafe(F.col("of")) & (F.col("d0") == F.col("d")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("k", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark window; columns stay as they are.

    With several blocks, what passes one is written before the next one is read.
    """
    schema = docs.schema
    waiting = None
    for probe in probe_blocks(benchmark, item_id_col, item_text_col, window, block_bytes):
        if waiting is not None:
            docs = written(docs, "clean")
            waiting.destroy()
        waiting = shared = docs.sparkSession.sparkContext.broadcast(probe)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, _, n_hit, _ in _judged(batches, text_col, [shared.value]):
                yield part.filter(pa.array(n_hit == 0))

        docs = docs.mapInArrow(clean, schema)
    return docs
