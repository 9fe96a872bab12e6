"""Quality rules as a short-circuit cascade.

A text is kept if it passes every rule, so the verdict doesn't depend on the
order in which the rules are tried; the cost does.  Each task takes the first
``SAMPLE_ROWS`` rows of its partition as a sample: every rule is run on all of
them, which measures its cost (CPU seconds a byte) and selectivity (share of
rows it rejects).  From then on the rules are tried by rejections per cost,
each on the survivors of those before it.  The sample needs no job of its own,
follows the data of each partition, and is judged like all other rows.

Words are runs of bytes other than ASCII white space, as they stand.

Edge cases.  A null or empty text has no words and fails ``too_short``.
Repeated rows are judged alike; an empty table gives an empty result.  Texts are
never cut.  ``keep_good`` passes every column through, whatever its name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw

SAMPLE_ROWS = 256
WINDOW = 8

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


@dataclass
class Texts:
    """A batch of texts; what rules measure is computed once and kept for the survivors."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def words(self) -> bw.Words:
        return bw.words(self.data, self.offsets, bw.NOT_SPACE, bw.IDENTITY)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    def take(self, rows: np.ndarray) -> Texts:
        size = np.diff(self.offsets)[rows]
        out = Texts(self.data[bw.ragged(self.offsets[:-1][rows], size)], np.concatenate([[0], np.cumsum(size)]))
        if "words" in self.__dict__:
            w, count = self.words, self.n_words[rows]
            at = bw.ragged(w.first[:-1][rows], count)
            doc = np.repeat(np.arange(len(rows)), count)
            shift = np.repeat(out.offsets[:-1] - self.offsets[:-1][rows], count)
            out.__dict__["words"] = bw.Words(w.start[at] + shift, w.end[at] + shift, doc, w.hash[at], np.concatenate([[0], np.cumsum(count)]))
        return out

    def per_text(self, member: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in the set."""
        total = np.concatenate([[0], np.cumsum(member[self.data])])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def word_chars(self) -> np.ndarray:
        chars = bw.code_points(self.data)
        return np.bincount(self.words.doc, chars[self.words.end] - chars[self.words.start], self.n).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_text(SYMBOL)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each line that has a word."""
        w = self.words
        if not len(w.start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = np.flatnonzero(self.data == 10)
        line = np.searchsorted(ends, w.start) + w.doc  # a new text is a new line, too
        lead = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        doc = w.doc[lead]
        before = np.searchsorted(ends, w.start[lead]) - 1
        start = np.maximum(np.where(before >= 0, ends[np.maximum(before, 0)] + 1, 0) if len(ends) else 0, self.offsets[doc])
        after = np.minimum(before + 1, len(ends) - 1)
        end = np.minimum(np.where(before + 1 < len(ends), ends[after], len(self.data)) if len(ends) else len(self.data), self.offsets[doc + 1])
        return doc, bw.span_hash(self.data, start, end)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        doc, h = self.lines
        distinct = np.unique(_of_text(h, doc), return_index=True)[1]
        return self.n_lines - np.bincount(doc[distinct], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        h, at = bw.windows(self.words, WINDOW)
        key = _of_text(h, self.words.doc[at])
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return np.zeros(self.n, np.int64)
        found = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        at = at[twice[found] == key]
        edge = np.zeros(len(self.words.hash) + 1, np.int64)
        edge[at] += 1
        np.add.at(edge, at + WINDOW, -1)
        return np.bincount(self.words.doc[np.cumsum(edge[:-1]) > 0], minlength=self.n)

    @cached_property
    def n_upper_words(self) -> np.ndarray:
        w = self.words
        up, low = (np.concatenate([[0], np.cumsum(s[self.data])]) for s in (_UPPER, _LOWER))
        shout = (up[w.end] > up[w.start]) & (low[w.end] == low[w.start])
        return np.bincount(w.doc[shout], minlength=self.n)

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        w = self.words
        same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        return np.bincount(w.doc[same], minlength=self.n)


def _of_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return h ^ bw.mix(doc.astype(np.uint64) + np.uint64(0x51ED27))


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``fails`` is true."""

    name: str
    fails: Callable[[Texts], np.ndarray]


BASE_RULES = (
    Rule("too_short", lambda t: t.n_words < 20),
    Rule("repetitive", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
STYLE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: 2 * t.n_upper_words > t.n_words),
    Rule("stuttering", lambda t: 10 * t.n_stutters > 3 * t.n_words),
    Rule("same_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)),
)
RULES = BASE_RULES + STYLE_RULES


class Cascade:
    """Rules in the order of rejections per cost, as measured on a first sample."""

    def __init__(self, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS):
        self.rules, self.wanted = list(rules), sample_rows
        self.cost = dict.fromkeys((r.name for r in rules), 0.0)
        self.rejected = dict.fromkeys((r.name for r in rules), 0)
        self.seen = 0

    def _measure(self, texts: Texts) -> np.ndarray:
        keep = np.ones(texts.n, bool)
        for rule in self.rules:
            alone = Texts(texts.data, texts.offsets)
            alone.__dict__["words"] = texts.words
            began = time.thread_time()
            fails = rule.fails(alone)
            self.cost[rule.name] += time.thread_time() - began
            self.rejected[rule.name] += int(fails.sum())
            keep &= ~fails
        self.seen += texts.n
        if self.seen >= self.wanted:
            self.rules.sort(key=lambda r: -self.rejected[r.name] / (self.cost[r.name] + 1e-9))
        return keep

    def keeps(self, texts: Texts) -> np.ndarray:
        if self.seen < self.wanted:
            n = min(texts.n, self.wanted - self.seen)
            head = self._measure(texts.take(np.arange(n)) if n < texts.n else texts)
            return head if n == texts.n else np.concatenate([head, self.keeps(texts.take(np.arange(n, texts.n)))])
        keep, alive = np.ones(texts.n, bool), np.arange(texts.n)
        for rule in self.rules:
            fails = rule.fails(texts)
            if fails.any():
                keep[alive[fails]] = False
                alive = alive[~fails]
                if not len(alive):
                    break
                texts = texts.take(np.flatnonzero(~fails))
        return keep


def _texts(part: pa.RecordBatch, text_col: str) -> Texts:
    return Texts(*bw.text_buffer(part.column(part.schema.get_field_index(text_col))))


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample_rows)
        for part in bw.batches_of(batches, text_col):
            yield part.filter(pa.array(cascade.keeps(_texts(part, text_col))))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", style_rules: tuple[Rule, ...] = STYLE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict of every document; only the style rules are left to the cascade, as the base measures are asked for."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(style_rules, sample_rows)
        for part in bw.batches_of(batches, "text"):
            t = _texts(part, "text")
            counts = [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]
            failed = np.zeros(t.n, bool)
            for rule in BASE_RULES:
                failed |= rule.fails(t)
            kept = ~failed
            if kept.any():
                kept[np.flatnonzero(kept)] = cascade.keeps(t.take(np.flatnonzero(kept)))
            arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    out = rows.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)
