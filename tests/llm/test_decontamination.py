"""Suffix arrays of training texts: order, longest matches and places against brute force, awkward texts."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest

from ledgraph.llm import bytewords as bw
from ledgraph.llm import decontamination as dc

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_suffix_ranks_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(80):
        sizes = rng.integers(1, 12, 6)
        stop = np.repeat(np.cumsum(sizes), sizes)
        code = rng.integers(0, int(rng.integers(1, 4)), len(stop))
        rank = dc.suffix_ranks(code, stop, 100)
        text = [tuple(code[i : stop[i]]) for i in range(len(code))]
        assert [sorted(text).index(t) for t in text] == rank.tolist()


def brute(docs, items, window):
    """Maximal verbatim matches that hold a window."""
    out = set()
    for d, t in docs:
        w = words(t)
        for name, item in items:
            x = words(item)
            need = min(window, len(x))
            for p in range(len(w)):
                for s in range(len(x)):
                    if p and s and w[p - 1] == x[s - 1]:
                        continue
                    n = 0
                    while p + n < len(w) and s + n < len(x) and w[p + n] == x[s + n]:
                        n += 1
                    if need and n >= need:
                        out.add((d, name, p, p + n, s))
    return out


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_locations_against_brute_force(spark, block):
    rng = np.random.default_rng(8)
    some = lambda n, v: " ".join(f"w{i}" for i in rng.integers(0, v, n))
    items = [("a", some(14, 50)), ("b", some(9, 50)), ("c", "Only, two"), ("d", None), ("e", ""), ("f", "x y z " * 3)]
    docs = [(i, some(int(rng.integers(0, 20)), 4) + " " + (items[i % 2][1] or "") + " " + some(3, 4)) for i in range(12)]
    docs += [(20, None), (21, ""), (22, "only TWO x"), (23, items[0][1][4:]), (24, "x y z x y z x y z"), (None, items[1][1])]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item string, first_word int").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = dc.locations(df, bench, window=4, block_bytes=block).collect()
    want = brute(docs, items, 4)
    found = {tuple(r) for r in got}
    # of matches that a longer one of the same item covers, not all are told
    assert found <= want
    covered = lambda rows: {(d, i, p) for d, i, a, b, _ in rows for p in range(a, b)}
    assert covered(found) == covered(want)
    assert {max(b - a for d, i, a, b, _ in want if (d, i) == k) for k in {(r[0], r[1]) for r in want}} == {max(b - a for d, i, a, b, _ in found if (d, i) == k) for k in {(r[0], r[1]) for r in found}}
    clean = dc.decontaminate(df, bench, window=4, block_bytes=block)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {r[0] for r in want}


def test_words_that_share_a_hash_are_told_apart():
    probe = dc.probe_of([("i", "alpha beta")])
    data, offsets = bw.text_buffer(pa.array(["alpha beta", "gamma beta"]))
    w = bw.words(data, offsets, bw.ALNUM)
    h = w.hash.copy()
    h[2] = h[0]  # as if gamma had the hash of alpha
    n_hit, items = dc.judge(w._replace(hash=h), data, 2, [probe])
    assert n_hit.tolist() == [2, 0] and items == [["i"], []]


def test_long_repetitive_texts():
    probe = dc.probe_of([("i", "tic tac " * 36)])
    assert len(probe.place) <= 2  # one search for a phrase, not one for each repeat
    data, offsets = bw.text_buffer(pa.array(["tic tac " * 400_000, "tic toc " * 100_000]))
    began = time.perf_counter()
    n_hit, _ = dc.judge(bw.words(data, offsets, bw.ALNUM), data, 2, [probe])
    assert n_hit.tolist() == [800_000, 0]
    assert time.perf_counter() - began < 30


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert dc.locations(docs, bench).count() == 0 and dc.decontaminate(docs, bench).count() == 0
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dc.locations(full, bench.limit(0)).count() == 0 and dc.decontaminate(full, bench.limit(0)).count() == 1
