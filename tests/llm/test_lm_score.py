"""The distributed context tree against its definition, and against held-out texts."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgraph.llm import bytewords as bw
from ledgraph.llm import lm_score


def definition(texts, train, depth):
    """log10 probability of each text by recursion over a dictionary of all nodes."""
    seq = [[0xFE] * depth + list("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()) + [0xFF] for t in texts]
    nodes = {}
    for s, learn in zip(seq, train, strict=True):
        for i in range(depth, len(s)):
            for bit in range(8):
                where = (1 << bit) | (s[i] >> (8 - bit))
                for d in range(depth + 1):
                    node = nodes.setdefault((tuple(s[i - d : i][::-1]), where), [0, 0])
                    node[s[i] >> (7 - bit) & 1] += learn

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    below = {}
    children = {}
    for ctx, where in nodes:
        if ctx:
            children.setdefault((ctx[:-1], where), []).append((ctx, where))

    def pw(node):
        own = kt(*nodes[node])
        if len(node[0]) == depth:
            return own
        below[node] = sum(pw(c) for c in children[node])
        return np.logaddexp(own, below[node]) - math.log(2)

    for where in {w for _, w in nodes}:
        pw(((), where))

    def one(s, i, where, d=0):
        node = (tuple(s[i - d : i][::-1]), where)
        a, b = nodes[node]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = 1 / (1 + math.exp(below[node] - kt(a, b)))
        return w * p + (1 - w) * one(s, i, where, d + 1)

    out = []
    for s in seq:
        total = 0.0
        for i in range(depth, len(s)):
            for bit in range(8):
                p = one(s, i, (1 << bit) | (s[i] >> (8 - bit)))
                total += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
        out.append(total)
    return out


TEXTS = ["abracadabra", "Abra cadabra", "", None, "cadabra é", "abracadabra", "zzz", "abra", "dabra ab", "x"]


@pytest.mark.parametrize("block", [1 << 25, 12])
def test_scores_are_those_of_the_definition(spark, block):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(None, "abra", "x", 0.0), (5, "abracadabra", "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string, score double").repartition(2)
    got = lm_score.lm_scores(df, block_bytes=block).collect()
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    assert any(held) and not all(held)
    want = definition([r[1] for r in rows], [not h for h in held], lm_score.DEPTH)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 3)) for r in got)
    assert found == sorted((r[0] if r[0] is not None else -1, round(w, 3)) for r, w in zip(rows, want, strict=True))


def test_each_context_has_a_distribution():
    data, offsets = bw.text_buffer(pa.array(["abracadabra", "abra", ""]))
    code, _ = lm_score.codes(data, offsets)
    contexts = np.unique(code >> 8)
    every = (contexts[:, None] << 8 | np.arange(256)).ravel()
    count = np.zeros(len(every))
    count[np.searchsorted(every, code)] += 1
    mixed, above = lm_score.subtrees(every, count)
    p = 10 ** lm_score.log10_probability(every, mixed, lm_score.crown(*above))
    assert np.allclose(p.reshape(-1, 256).sum(1), 1)


def test_without_training_texts_a_byte_costs_eight_bits(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")).collect()
    assert all(r["held_out"] and abs(r["bits_per_byte"] - 8) < 1e-6 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in got)
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deeper_contexts_and_very_long_texts(spark):
    long = "the quick brown fox jumps over the lazy dog. " * 60_000
    df = spark.createDataFrame([(0, long), (2, "the quick brown fox jumps over"), (3, "vexed nymphs waltz quick")], "doc_id long, text string")
    deep = {r["doc_id"]: r["bits_per_byte"] for r in lm_score.lm_scores(df).collect()}
    flat = {r["doc_id"]: r["bits_per_byte"] for r in lm_score.lm_scores(df, depth=3).collect()}
    # only " the " leaves a choice, once in 22 bytes
    assert deep[0] < 0.05 and deep[2] < deep[3] and deep[0] <= flat[0]
