"""Hot keys are dealt to several tasks without a change of the result."""

from collections import Counter

from ledgraph.llm import common, minhash


def test_hot_join_is_a_join(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "k int, v int")
    facts = spark.createDataFrame([(k, f"f{k}", n) for k, n in Counter(r["k"] for r in rows.collect()).items() if k % 2 == 0], "k int, fact string, n long")
    assert [r["k"] for r in common.hot_keys(facts, ["k"]).collect()] == [0]
    got = Counter(tuple(r) for r in common.hot_join(rows, facts, ["k"], ["v"]).collect())
    assert got == Counter((r["k"], r["v"], f"f{r['k']}") for r in rows.collect() if r["k"] % 2 == 0)
    few = facts.where("k > 0")
    assert common.hot_keys(few, ["k"]) is None and common.hot_join(rows, few, ["k"], ["v"]).count() == sum(1 for i in range(0, 3000, 3) if i and i % 2 == 0)
    assert common.hot_join(rows, facts.limit(0), ["k"], ["v"]).count() == 0


def test_pairs_across_labels_with_a_hot_key(spark):
    rows = spark.createDataFrame([(1 if i < 600 else i % 40, i, i % 7 if i % 5 == 0 else 0) for i in range(900)], "h int, node int, label int")
    from pyspark.sql import functions as F

    got = {frozenset((r["a_node"], r["b_node"])) for r in minhash.across(rows, ["h"], F.lit(True), ["node"]).select("a_node", "b_node").collect()}
    each = [tuple(r) for r in rows.collect()]
    by = {}
    for h, node, label in each:
        by.setdefault(h, []).append((node, label))
    want = {frozenset((a, b)) for group in by.values() for a, x in group for b, y in group if x != y}
    assert got == want
