"""Scoring by context-tree weighting over bytes, with a unigram word base beside it.

Each byte is eight binary decisions (most significant bit first).  Every decision
has a context tree over the ``DEPTH`` bytes before it; a node holds the counts of
zeros and ones seen in its context, its Krichevsky-Trofimov estimate, and the
weighted mixture of that with its children: Pw = (Pe + prod Pw(child)) / 2.
After training, the mixture's posterior weights give one probability for each
decision, hence for each byte in each context; -log2 of it is the code length.

The tree is a table with a row for each context of ``DEPTH`` bytes and the byte
after it that occurs in any text (its number), so it grows with the corpus and is
never gathered:

1. Tasks read their texts in blocks of ``BLOCK_BYTES``.  A block is written as its
   packed texts and its distinct numbers and words with their training counts.
2. Counts are summed by number and dealt by the ``LOCAL`` most recent bytes of the
   context, so that all deeper nodes of a subtree are in one task, which mixes
   them bottom-up.  The nodes above are 65,280 at most, whatever the corpus: they
   are mixed on the driver and broadcast.
3. Each number's log probability, and each word's count, is joined to the blocks
   that have it, once a block however often it occurs there, and each block's
   texts are scored by their block's values.

Base: sum over tokens of log10((c+1) / (N + 1*(V+1))).  Words are told apart by
63-bit hashes.

Texts are lower-cased (A-Z).  A text ends with a byte that UTF-8 does not have,
which is scored, too; before its start stands another such byte.

Edge cases.  A null text is empty: it has the end only.  A null id counts as an
empty name in the split.  Without training texts all counts are zero: bytes cost
8 bits and the base is zero.  Repeated rows are scored alike, each on its own row;
an empty table gives an empty result.  A very long text is a block of its own.
Texts are read whole; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import written

DEPTH = 5
LOCAL = 2
"""Bytes of context that subtrees are dealt by; a task has whole subtrees."""
ROWS = 200_000
"""Rows of the tree that a task has on average."""
HOLD_OUT = (7, 2)
"""Modulus and remainder of crc32(id) that is held out."""
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 1 << 20
"""Text bytes that are worked on at once; the numbers take some 40 bytes a byte."""
MOST = 1 << 20
"""Values that wait to be merged."""
SLOTS = 1 << 21
"""Slots of a block's table of values, by hash; values that share one are looked up by bisection."""
START, END = 0xFE, 0xFF
_WORD = np.int64(-(1 << 63))
"""Keys of words are negative, those of numbers are not."""
_BITS = np.arange(8)


def codes(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of each byte and of each text's end as one number, the most recent byte first, and the texts' bounds."""
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    # eight bytes stand before each text, so that the words of eight bytes before each place need no bounds
    stop = np.cumsum(np.diff(offsets) + 9)
    here = np.ones(len(data) + 9 * n, bool)
    here[(np.concatenate([[0], stop[:-1]]).astype(np.int64)[:n, None] + np.arange(8)).ravel()] = False
    body = here.copy()
    body[stop - 1] = False
    padded = np.full(len(here), START, np.uint8)
    padded[body] = bw.LOWER[data]
    padded[stop - 1] = END
    out = np.ndarray((max(len(padded) - 8, 0),), "<u8", padded.tobytes(), 0, (1,)) >> np.uint64(64 - 8 * depth)
    out <<= np.uint64(8)
    out |= padded[8:]
    return out[here[8:]].view(np.int64), bounds


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of a zeros and b ones."""
    return _half(a) + _half(b) - _whole(a + b)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after lifting small arguments; x > 0."""
    lift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        lift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - lift


def _half(n: np.ndarray) -> np.ndarray:
    return _lgamma(n + 0.5) - 0.5723649429247001


def _whole(n: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1.0)


def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (1 to 255) of a byte's eight decisions, and what is decided."""
    return (1 << _BITS) | (byte[:, None] >> (8 - _BITS)), (byte[:, None] >> (7 - _BITS)) & 1


def _mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw and the posterior weight of a node's own estimate."""
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtrees(code: np.ndarray, count: np.ndarray, depth: int = DEPTH, local: int = LOCAL) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Mixed probabilities of a one at each number's eight decisions, down from ``local`` bytes of context; and for the level above (node, log Pw below, zeros, ones).

    The numbers hold whole subtrees: all that share ``local`` bytes.
    """
    node, bit = _decisions(code & 255)
    n = np.repeat(count.astype(np.float64), 8)
    ones_in = np.where(bit.ravel() == 1, n, 0.0)
    zeros_in = n - ones_in
    mixed = np.zeros(0)
    child: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(depth, local - 1, -1):
        key = ((code >> (8 * (depth - d) + 8))[:, None] << 8 | node).ravel()
        at, where = np.unique(key, return_inverse=True)
        zeros, ones = np.bincount(where, zeros_in, len(at)), np.bincount(where, ones_in, len(at))
        own, one = _kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
        if child is None:
            weighted, mixed = own, one[where]
        else:
            below = np.bincount(np.searchsorted(at, (child[0] >> 16) << 8 | child[0] & 255), child[1], len(at))
            weighted, w = _mixed(own, below)
            mixed = (w * one)[where] + (1 - w)[where] * mixed
        child = at, weighted
    above, where = np.unique((child[0] >> 16) << 8 | child[0] & 255, return_inverse=True)
    sums = [np.bincount(where, x, len(above)) for x in (child[1], zeros, ones)]
    return mixed.reshape(-1, 8), (above, *sums)


def crown(key: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each node with one byte of context: a one's probability is a + b * (what is mixed below)."""
    own, one = _kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    weighted, w1 = _mixed(own, below)
    node = key & 255
    z, o, total = (np.bincount(node, x, 256) for x in (zeros, ones, weighted))
    w0 = _mixed(_kt(z, o), total)[1][node]
    one0 = ((o + 0.5) / (z + o + 1))[node]
    a, b = np.zeros(1 << 16), np.zeros(1 << 16)
    a[key], b[key] = w0 * one0 + (1 - w0) * w1 * one, (1 - w0) * (1 - w1)
    return a, b


def log10_probability(code: np.ndarray, mixed: np.ndarray, top: tuple[np.ndarray, np.ndarray], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each number's byte in its context."""
    node, bit = _decisions(code & 255)
    key = (code >> (8 * depth))[:, None] << 8 | node
    one = top[0][key] + top[1][key] * mixed
    return np.log10(np.where(bit == 1, one, 1 - one)).sum(1)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % HOLD_OUT[0] == HOLD_OUT[1]


def _word_key(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).view(np.int64) | _WORD


class _Tally:
    """Distinct values and how often training texts have them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray, train: np.ndarray) -> None:
        seen, n = np.unique(values[train], return_counts=True)
        other = np.unique(values[~train])
        self.parts += [(seen, n), (other, np.zeros(len(other), np.int64))]
        self.size += len(seen) + len(other)
        if self.size > MOST:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        values, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return values, np.bincount(where, np.concatenate([p[1] for p in self.parts]), len(values)).astype(np.int64)


def blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """Packs (block, raw, ids, held, sizes) and the blocks' distinct numbers and words (block, key, n), as one table; packs have no key.

    A block's name is drawn when it is read; the table keeps what one attempt has written.  Two blocks that
    draw the same name are scored as one, which changes nothing.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, tallies = 0, 0, ()

        def batch(n: int, key=None, count=None, raw=None, ids=None, held=None, sizes=None) -> pa.RecordBatch:
            arrays = [pa.array(np.full(n, block), pa.int32())]
            arrays += [pa.nulls(n, t) if x is None else x for x, t in ((key, pa.int64()), (count, pa.int64()), (raw, pa.binary()), (ids, pa.list_(id_type)), (held, pa.list_(pa.bool_())), (sizes, pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            for tally in tallies:
                values, n = tally.total()
                for lo in range(0, len(values), 1 << 16):
                    part = values[lo : lo + (1 << 16)]
                    yield batch(len(part), pa.array(part), pa.array(n[lo : lo + (1 << 16)]))

        id_type = pa.int64()
        for part in bw.batches_of(batches, "text", SHARD_BYTES):
            id_type = part.column(0).type
            data, offsets = bw.text_buffer(part.column(1))
            if not tallies or size + len(data) > block_bytes:
                yield from flush()
                block, size, tallies = int.from_bytes(os.urandom(4), "little") >> 1, 0, (_Tally(), _Tally())
            train = ~np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
            code, bounds = codes(data, offsets, depth)
            tallies[0].add(code, np.repeat(train, np.diff(bounds)))
            w = bw.words(data, offsets, bw.NOT_SPACE)
            tallies[1].add(_word_key(w.hash), train[w.doc])
            one = pa.array([0, part.num_rows], pa.int32())
            raw = pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary())
            lists = [pa.ListArray.from_arrays(one, x) for x in (part.column(0), part.column(2), pa.array(np.diff(offsets), pa.int32()))]
            yield batch(1, None, None, raw, *lists)
            size += len(data)
        yield from flush()

    names = ["block", "key", "n", "raw", "ids", "held", "sizes"]
    return rows.select("id", "text", "held_out").mapInArrow(run, f"block int, key long, n long, raw binary, ids array<{kind}>, held array<boolean>, sizes array<int>")


def _trees(counts: DataFrame, depth: int) -> DataFrame:
    """(key, mixed) of all numbers: their mixed probabilities; and (key, below, zeros, ones): the sums for the level above."""
    n = counts.count()
    dealt = counts.repartition(max(1, -(-n // ROWS)), F.shiftright("key", 8 * (depth - LOCAL) + 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not parts:
            return
        code, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        parts.clear()
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
        # a task's subtrees, some at a time
        heads = np.flatnonzero(np.diff(code >> (8 * (depth - LOCAL) + 8))) + 1
        lo = 0
        while lo < len(code):
            at = np.searchsorted(heads, lo + ROWS // 4)
            hi = int(heads[at]) if at < len(heads) else len(code)
            mixed, above = subtrees(code[lo:hi], count[lo:hi], depth)
            flat = np.ascontiguousarray(mixed, np.float32)
            ends = np.arange(0, (hi - lo) * 32 + 1, 32, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(code[lo:hi]), packed, *(pa.nulls(hi - lo, pa.float64()) for _ in range(3))], names=names)
            k = len(above[0])
            yield pa.RecordBatch.from_arrays([pa.array(above[0]), pa.nulls(k, pa.binary()), *(pa.array(x) for x in above[1:])], names=names)
            lo = hi

    names = ["key", "mixed", "below", "zeros", "ones"]
    return dealt.select("key", "n").mapInArrow(run, "key long, mixed binary, below double, zeros double, ones double")


def _probabilities(trees: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 probability of each number, in single precision, which takes half the room in shuffles."""
    sums = trees.where("mixed is null").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).toArrow()  # 256 contexts of 255 nodes at most
    shared = trees.sparkSession.sparkContext.broadcast(crown(*(np.asarray(sums[c]) for c in ("key", "below", "zeros", "ones"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                code = np.asarray(part.column(0))
                raw, _ = bw.text_buffer(part.column(1))
                mixed = np.frombuffer(raw.tobytes(), np.float32).reshape(-1, 8).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(log10_probability(code, mixed, shared.value, depth).astype(np.float32).astype(np.float64))], names=["key", "value"])

    return trees.where("mixed is not null").select("key", "mixed").mapInArrow(run, "key long, value double")


class _Table:
    """Values by key: a slot by hash, bisection for keys that share one."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.slot_key, self.slot_value = np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
        at = self._slots(self.key)
        self.slot_key[at], self.slot_value[at] = self.key, self.value

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The values of keys that are all there."""
        at = self._slots(asked)
        out = self.slot_value[at]
        other = np.flatnonzero(self.slot_key[at] != asked)
        out[other] = self.value[np.searchsorted(self.key, asked[other])]
        return out


def _scored(packs: DataFrame, values: DataFrame, kind: str, depth: int) -> DataFrame:
    """Per document: tokens, bytes, score, known words and the sum of log10(c+1) over its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _Table(np.asarray(right["key"]), np.asarray(right["value"]))
        out = []
        for raw, ids, held, sizes in zip(left["raw"], left["ids"], left["held"], left["sizes"], strict=True):
            size = np.asarray(sizes.values).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(size)])
            data = np.frombuffer(pa.decompress(raw.as_buffer(), decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
            code, bounds = codes(data, offsets, depth)
            score = np.add.reduceat(table.of(code), bounds[:-1])
            w = bw.words(data, offsets, bw.NOT_SPACE)
            c = table.of(_word_key(w.hash))
            n_known = np.bincount(w.doc, c > 0, len(size)).astype(np.int64)
            base = np.bincount(w.doc, np.log10(c + 1.0), len(size))
            out.append(pa.table([ids.values, held.values, *(pa.array(x) for x in (np.diff(w.first) + 1, size, score, n_known, base))], names=names))
        return pa.concat_tables(out) if out else schema_of.empty_table()

    names = ["id", "held_out", "n_tokens", "n_bytes", "score", "known", "logs"]
    layout = f"id {kind}, held_out boolean, n_tokens long, n_bytes long, score double, known long, logs double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema_of = to_arrow_schema(StructType.fromDDL(layout))
    return packs.groupBy("pack").cogroup(values.groupBy("of")).applyInArrow(run, layout)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, depth: int = DEPTH) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), bits_per_byte."""
    if not LOCAL < depth <= 6:
        raise ValueError("a number has room for 3 to 6 bytes of context")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    table = written(blocks(rows, block_bytes, depth), "blocks")
    keys = table.where("key is not null")
    counts = written(keys.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    packs = table.where("key is null").select(F.col("block").alias("pack"), "raw", "ids", "held", "sizes")
    n_docs = packs.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0  # each training text has one end
    total, distinct = counts.where("key < 0 and n > 0").agg(F.sum("n"), F.count("*")).first()
    n = (total or 0) + n_docs
    v = distinct + (n_docs > 0)
    trees = written(_trees(counts.where("key >= 0"), depth), "trees")
    values = _probabilities(trees, depth).unionByName(counts.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    # a key is in a block once, so the join has no hot keys
    of_block = keys.select("block", "key").join(values, "key").select(F.col("block").alias("of"), "key", "value")
    scored = _scored(packs, of_block, kind, depth)
    end = float(np.log10(n_docs + 1.0))
    each = float(np.log10(n + v + 1.0))
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + int(n_docs > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + end - F.col("n_tokens") * each).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
