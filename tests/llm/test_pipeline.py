"""The pipeline against brute force and DuckDB, stage by stage; edge cases of every stage and operator."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from ledgraph.llm import decontamination, html_text, line_dedup, lm_score, minhash, oracles, pieces, quality, secrets, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^ \t-\r]")


def without_repeats(docs):
    """Texts without the lines of pairs of lines that stand at an earlier place."""
    seen, out = {}, {}
    for i, t in sorted(docs.items()):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 1):
            two = lines[k] + "\n" + lines[k + 1]
            if WORD.search(two) and seen.setdefault(two, (i, k)) != (i, k):
                gone |= {k, k + 1}
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def in_sql(docs, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(docs.items()))
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def test_stages_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {r["doc_id"]: docs[r["doc_id"]] for r in in_sql(docs, oracles.ORACLES["op3_quality"]) if r["kept"]}
    docs = without_repeats(docs)
    docs = {r["doc_id"]: docs[r["doc_id"]] for r in in_sql(docs, oracles._near_duplicates(5, 80)) if r["kept"]}
    docs = {r["doc_id"]: docs[r["doc_id"]] for r in in_sql(docs, oracles.ORACLES["op10_decontamination"]) if not r["contaminated"]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame([(r["doc_id"], r["pieces"]) for r in got], "doc_id long, pieces array<int>")).collect()}
    assert back == docs and all(r["exact"] for r in got)


LONG = " ".join(f"word{i} and{i % 7}" for i in range(150_000))
CLASH = "doc_id long, text string, lang string, source string, n_chars long, __mark long, __i int, mark string, id int, gone int, _hot boolean, _salt int, first string, component_id long"
REST = ("en", "s", 5, 1, 2, "m", 3, 4, True, 9, "f", 8)
ROWS = [(1, LONG, *REST), (2, LONG, *REST), (2, LONG, *REST), (3, None, *REST), (4, "", *REST), (None, "a b c d e f", *REST), (5, "a b c d e f", *REST), (6, "\n\n \n", *REST), (7, None, *[None] * 12)]


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame(ROWS, CLASH).repartition(2)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_awkward_rows(spark, clash, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, clash, SF)
    assert out.columns == clash.columns
    rows = out.collect()
    ids = Counter(r["doc_id"] for r in rows)
    others = {tuple(r[c] for c in clash.columns if c not in ("doc_id", "text", "n_chars")) for r in rows}
    assert others <= {tuple(r[i] for i in range(14) if i not in (0, 1, 4)) for r in ROWS}
    if name == "quality":
        assert ids == Counter({1: 1, 2: 2})
    if name == "line_dedup":
        assert ids == Counter([r[0] for r in ROWS])
    if name == "near_dedup":  # rows alike are one, a copy goes, texts without words stay
        assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    if name == "decontamination":
        assert ids == Counter([r[0] for r in ROWS])
    assert f(spark, clash.limit(0), SF).count() == 0


def test_operators_on_awkward_rows(spark, clash):
    n = len(ROWS)
    found = {r["doc_id"]: r for r in secrets.scan(clash).collect()}
    assert set(found) == {r[0] for r in ROWS} and secrets.summary(secrets.scan(clash)).count() == n
    assert {r["doc_id"]: r["n_words"] for r in quality.quality(clash).collect()}[1] == 300_000
    assert line_dedup.summary(clash).count() == n
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(clash, shingle=3, percent=85).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, 5), (5, 5), (6, 6), (7, 7)}
    copies = suffix_dedup.summary(suffix_dedup.repeats(clash)).collect()
    assert {(r["doc_id"], r["n_words"], r["class_id"], r["copy"]) for r in copies} == {(1, 300_000, 1, False), (2, 300_000, 1, True)}
    scored = lm_score.lm_scores(clash).collect()
    assert len(scored) == n and {r["doc_id"]: r["n_tokens"] for r in scored}[1] == 300_001
    encoded = pieces.encode(clash).collect()
    assert len(encoded) == n and all(r["exact"] for r in encoded)
    bench = spark.createDataFrame([("x", "word10 and3 word11 and4"), (None, "b c d")], "item_id string, text string")
    hits = {r["doc_id"]: (r["n_hit"] > 0, r["items"]) for r in decontamination.contamination(clash, bench, window=4).collect()}
    assert hits[1] == (True, ["x"]) and hits[5] == (True, ["null"]) and hits[3] == (False, [])
    for out in (secrets.scan(clash.limit(0)), quality.quality(clash.limit(0)), line_dedup.summary(clash.limit(0)), minhash.near_duplicates(clash.limit(0)), suffix_dedup.summary(suffix_dedup.repeats(clash.limit(0))), pieces.encode(clash.limit(0))):
        assert out.count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<article><p>One.</p></article>", "h", 2, 3)], "page_id long, url string, html string, host string, n_chars int, id int")
    assert html_text.extract(pages).collect()[0]["text"] == "One."
    assert url_filter.url_verdicts(pages).collect()[0]["host"] == "a.net"
