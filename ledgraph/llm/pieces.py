"""Unigram encoding and decoding with a SentencePiece vocabulary.

Pieces are kept in a double-array trie over bytes; the Viterbi search finds the
segmentation with the greatest sum of log scores.  Characters that no piece
covers fall back to byte pieces.  A space is the white-space marker of the
vocabulary, and one marker is put before the text.

No piece crosses from a non-space to a space, so the search falls apart at these
places into units (spaces, then the characters up to the next space).  Units are
deduplicated in each batch, and the search runs over all distinct units at once:
one trie step for every unit and start position is one numpy gather.

The vocabulary is a parameter (a SentencePiece model file read on the driver);
its trie has a proven bound and goes to the executors as a broadcast.

Edge cases.  A null text gives null ids, an empty one no ids.  The marker's own
character in a text is written with byte pieces, so that decoding is exact for
every text.  Repeated rows are encoded alike; an empty table gives an empty
result; texts are never cut.  Only the id and text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the public algorithm: an unknown character scores this much below the worst piece
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_CHUNK = 1 << 20
"""Bytes of padded units that are searched at once."""


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id."""
    out = []
    with open(path, "rb") as f:
        for tag, value in _fields(f.read()):
            if tag == 1:
                got = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL}
                got.update(dict(_fields(value)))
                out.append((got[1].decode(), struct.unpack("<f", got[2])[0], got[3]))
    return out


class Trie:
    """A double-array trie: from state s, byte b leads to base[s]+b if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        base, check, value = {}, {0: 0}, {}
        used = bytearray(1 << 16)
        used[0] = 1
        gap = 1  # no free place is before it
        wide = 1  # where states with several children are placed from
        todo = [(0, 0, len(keys), 0)]
        for state, lo, hi, depth in todo:
            if lo < hi and len(keys[lo]) == depth:
                value[state] = values[lo]
                lo += 1
            if lo == hi:
                continue
            heads = [lo] + [i for i in range(lo + 1, hi) if keys[i][depth] != keys[i - 1][depth]]
            labels = [keys[i][depth] for i in heads]
            if len(labels) == 1:
                place = max(gap, labels[0] + 1)
                place = used.find(0, place)
                at = place - labels[0]
                if place == gap:
                    gap += 1
            else:
                at = wide
                misses = 0
                while any(used[at + c] for c in labels):
                    at += 1
                    misses += 1
                if misses > 200:
                    wide = at - 100
            base[state] = at
            if at + 1024 > len(used):
                used.extend(bytes(len(used)))
            for i, (head, label) in enumerate(zip(heads, labels, strict=True)):
                used[at + label] = 1
                check[at + label] = state
                todo.append((at + label, head, heads[i + 1] if i + 1 < len(heads) else hi, depth + 1))
        size = max(max(base.values(), default=0), max(check)) + 257
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for array, cells in ((self.base, base), (self.check, check), (self.value, value)):
            array[list(cells)] = list(cells.values())

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[state] + byte
        return np.where((self.check[to] == state) & (to > 0) & (self.base[state] > 0), to, -1)


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        kept = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.byte_id = np.full(256, -1, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.unknown = min(s for _, _, s in kept) - UNKNOWN_PENALTY
        self.trie = Trie([p.replace(MARKER, " ").encode() for _, p, _ in kept], [i for i, _, _ in kept])
        if any(" " in p.replace(MARKER, " ").lstrip(" ") for _, p, _ in kept):
            raise ValueError("a piece crosses a word's end")

    @cached_property
    def spelled(self) -> list[bytes]:
        out = []
        for p, _, kind in self.pieces:
            out.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARKER, " ").encode())
        return out

    def viterbi(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (byte spans): concatenated, and how many each has.

        Scores are compared strictly and starts tried from the left, so of equal
        segmentations the one whose last differing piece is longest wins.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            # units of like sizes share a padded matrix
            width = int(size[order[at]])
            most = max(width + 8, width * 5 // 4)
            end = int(np.searchsorted(size[order], most, side="right"))
            end = min(end, at + max(1, _CHUNK // most))
            rows = order[at:end]
            out.append((rows, *self._search(data, start[rows], size[rows])))
            at = end
        count = np.zeros(len(size), np.int64)
        for rows, _, n in out:
            count[rows] = n
        first = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(first[-1], np.int32)
        for rows, got, n in out:
            ids[bw.ragged(first[:-1][rows], n)] = got
        return ids, count

    def _search(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(start), int(size.max())
        grid = np.zeros((width, n), np.uint8)
        at = bw.ragged(start, size)
        row = np.repeat(np.arange(n), size)
        col = at - start[row]
        grid[col, row] = data[at]
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        origin = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -2, np.int32)
        lead = (grid & 0xC0) != 0x80
        length = np.where(grid < 0x80, 1, np.where(grid >= 0xF0, 4, np.where(grid >= 0xE0, 3, 2)))
        for i in range(width):
            live = np.flatnonzero((i < size) & lead[i] & (best[i] > -np.inf))
            if not len(live):
                continue
            score = best[i, live]
            chars = length[i, live]
            covered = np.zeros(len(live), bool)
            index = np.arange(len(live))
            state = np.zeros(len(live), np.int32)
            j = i
            while len(index):
                state = self.trie.step(state, grid[j, live[index]])
                go = (state >= 0)
                index, state = index[go], state[go]
                if not len(index):
                    break
                value = self.trie.value[state]
                hit = np.flatnonzero(value >= 0)
                if len(hit):
                    r = index[hit]
                    units, cand = live[r], score[r] + self.score[value[hit]]
                    covered[r[j + 1 - i == chars[r]]] = True
                    better = cand > best[j + 1, units]
                    units = units[better]
                    best[j + 1, units] = cand[better]
                    origin[j + 1, units] = i
                    piece[j + 1, units] = value[hit][better]
                j += 1
                inside = j < size[live[index]]
                index, state = index[inside], state[inside]
            lost = np.flatnonzero(~covered)
            if len(lost):
                units = live[lost]
                to = np.minimum(i + chars[lost], size[units])
                cand = score[lost] + self.unknown
                better = cand > best[to, units]
                units, to = units[better], to[better]
                best[to, units] = cand[better]
                origin[to, units] = i
                piece[to, units] = -1
        # walk back: the pieces of all units, last first
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        units, to = np.arange(n), size.astype(np.int64)
        while len(units):
            p, o = piece[to, units], origin[to, units]
            whole = p >= 0
            if whole.all():
                steps.append((units, p))
            else:
                # a character without a piece: its bytes, last first
                steps.append((units[whole], p[whole]))
                u, a, b = units[~whole], o[~whole], to[~whole]
                for k in range(1, int((b - a).max()) + 1):
                    live = b - k >= a
                    steps.append((u[live], self.byte_id[grid[(b - k)[live], u[live]]]))
            go = o > 0
            units, to = units[go], o[go].astype(np.int64)
        unit = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        when = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        final = np.lexsort((-when, unit))
        return ids[final].astype(np.int32), np.bincount(unit, minlength=n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and offsets per text."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        full = np.flatnonzero(size > 0)
        # one space before each text
        marked = np.full(len(data) + len(full), 0x20, np.uint8)
        first = offsets[:-1][full] + np.arange(len(full))
        body = np.ones(len(marked), bool)
        body[first] = False
        marked[body] = data
        bounds = np.concatenate([first, [len(marked)]])
        space = marked == 0x20
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1]] = True
        start = np.flatnonzero(opens)
        end = np.concatenate([start[1:], [len(marked)]]) if len(start) else start
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        h = bw.span_hash(marked, start, end)
        distinct, lead, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, count = self.viterbi(marked, start[lead], (end - start)[lead])
        at = np.concatenate([[0], np.cumsum(count)])
        of_unit = count[inverse]
        out = ids[bw.ragged(at[:-1][inverse], of_unit)]
        text = np.searchsorted(first, start, side="right") - 1
        per = np.zeros(n, np.int64)
        per[full] = np.bincount(text, of_unit, len(full)).astype(np.int64)
        return out, np.concatenate([[0], np.cumsum(per)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets; the space before each text is taken off."""
        joined = np.frombuffer(b"".join(self.spelled), np.uint8)
        sizes = np.array([len(s) for s in self.spelled], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        of_id = sizes[ids]
        out = joined[bw.ragged(at[:-1][ids], of_id)]
        total = np.concatenate([[0], np.cumsum(of_id)])
        bounds = total[offsets]
        full = np.flatnonzero(np.diff(bounds) > 0)
        drop = full[out[bounds[:-1][full]] == 0x20]
        keep = np.ones(len(out), bool)
        keep[bounds[:-1][drop]] = False
        gone = np.zeros(len(offsets), np.int64)
        gone[drop + 1] = 1
        return out[keep], bounds - np.cumsum(gone)


def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(read_model(path or default_model()))


def _string(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    valid = None if mask is None or mask.all() else pa.array(mask).buffers()[1]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: pieces (ids), n_pieces, n_bytes (byte pieces among them), exact (decoding gives the text again)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for part in bw.batches_of(batches, "text"):
            column = bw.large(part.column(1))
            data, offsets = bw.text_buffer(column)
            ids, at = v.encode(data, offsets)
            back, bounds = v.decode(ids, at)
            some = column.is_valid().to_numpy(zero_copy_only=False)
            same = _string(back, bounds).to_pylist() == _string(data, offsets).to_pylist()
            exact = np.ones(len(some), bool) if same else np.array([a == b for a, b in zip(_string(back, bounds).cast(pa.binary()).to_pylist(), _string(data, offsets).cast(pa.binary()).to_pylist(), strict=True)])
            byte = np.zeros(len(v.pieces), bool)
            byte[v.byte_id] = True
            n_byte = np.concatenate([[0], np.cumsum(byte[ids])])
            pieces = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            if not some.all():
                pieces = pa.array([p if ok else None for p, ok in zip(pieces.to_pylist(), some, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pieces, pa.array(np.diff(at), pa.int64()), pa.array(n_byte[at[1:]] - n_byte[at[:-1]], pa.int64()), pa.array(exact)],
                names=["id", "pieces", "n_pieces", "n_bytes", "exact"],
            )

    return rows.mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces long, n_bytes long, exact boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", pieces_col: str = "pieces", model: str | None = None) -> DataFrame:
    """Per document: the text that its pieces spell; null pieces give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = encoded.select(F.col(id_col).alias("id"), F.col(pieces_col).cast("array<int>").alias("pieces"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for part in batches:
            column = part.column(1)
            some = column.is_valid().to_numpy(zero_copy_only=False)
            size = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            data, offsets = v.decode(ids, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([part.column(0), _string(data, offsets, some)], names=["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
