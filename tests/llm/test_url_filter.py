"""Links, ranks and verdicts of hosts against a dense solution and DuckDB."""

import duckdb
import numpy as np
import pytest

from ledgraph.llm import url_filter as uf
from ledgraph.llm.oracles import ORACLES

KIND = "page_id long, url string, html string, host string, verdict string"


def test_links(spark):
    base = '<head><base target=x href="//Cdn.net/a/"></head>'
    cases = [
        ('<a href="x">', {}), (base + '<a href="x"><a href=/y>', {"cdn.net": 2.0}), ('<a class="b" href=//B.net>', {"b.net": 1.0}), ('<a href="mailto:me@b.net"><a href="javascript:x()">', {}),
        ('<a data-href="http://no.net/">', {}), ("<a href='http:&#x2F;&#47;c.net&sol;x'>", {"c.net": 1.0}), ('<A HREF = "HTTPS://D.NET?x"><a href="http://a.org/self">', {"d.net": 1.0}), (base + '<a href="http://e.net:80/"><a href="mailto:x">', {"e.net:80": 1.0}), (None, {}), ("", {}),
    ]
    for html, want in cases:
        got = uf.host_edges(spark.createDataFrame([("http://a.org/p", html)], "url string, html string")).collect()
        assert {r["dst"]: r["weight"] for r in got} == want, html
    assert uf.host_edges(spark.createDataFrame([(None, '<a href="http://b.net/">')], "url string, html string")).count() == 0


def web(n):
    """Pages of n hosts with links to others, some of them allowed or blocked by rules."""
    rng = np.random.default_rng(6)
    ends = ["net", "net", "net", "org", "com"]
    hosts = [f"h{i}.{ends[i % 5]}" for i in range(n)]
    rows = []
    for i, h in enumerate(hosts):
        links = "".join(f'<p><a href="{["http:", "https:", ""][int(k) % 3]}//{hosts[int(t)]}/p">' for k, t in enumerate(rng.integers(0, n, int(rng.integers(0, 4)))))
        rows.append((i, f"http://{h}/{['fr', 'de', 'en'][int(rng.integers(0, 3))]}/{i}", links, "other", "clash"))
    return rows


def dense(rows):
    """Verdict of every page by power iteration over matrices."""
    def rule(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    import re

    judged = [(url.split("/")[2], *rule(url.split("/")[2], "/" + url.split("/", 3)[3])) for _, url, *_ in rows]
    hosts = sorted({h for h, _, _ in judged})
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (h, _, _), row in zip(judged, rows, strict=True):
        for target in re.findall(r'href="(?:https?:)?//([^/"]+)', row[2] or ""):
            m[at[h], at[target]] += target != h

    def rank(m, verdict):
        seed = np.zeros(len(hosts))
        for h, _, v in judged:
            seed[at[h]] += v == verdict
        seed /= seed.sum()
        out = m.sum(1, keepdims=True)
        step = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
        r = seed
        for _ in range(300):
            r = 0.15 * seed + 0.85 * (r @ step + r[out[:, 0] == 0].sum() * seed)
        return r

    trust, distrust = rank(m, "allow"), rank(m.T, "block")
    verdicts = [v or ("block" if distrust[at[h]] > 0 and distrust[at[h]] >= trust[at[h]] else "allow") for h, _, v in judged]
    far = [v is not None or abs(distrust[at[h]] - trust[at[h]]) > 1e-5 for h, _, v in judged]
    return verdicts, far


def test_verdicts_of_a_thousand_linked_hosts(spark):
    rows = web(1000)
    df = spark.createDataFrame(rows, KIND)
    got = {r["page_id"]: r for r in uf.url_verdicts(df, tolerance=1e-6).collect()}
    want, far = dense(rows)
    assert len(got) == 1000 and sum(far) > 900
    wrong = [i for i, (v, ok) in enumerate(zip(want, far, strict=True)) if ok and got[i]["verdict"] != v]
    assert wrong == []
    unruled = [i for i in range(1000) if got[i]["rule"] is None]
    assert {got[i]["verdict"] for i in unruled} == {"allow", "block"}
    assert any(got[i]["trust"] > 0 and not got[i]["host"].endswith(("org", "com")) for i in unruled)
    # the SQL counterpart says the same
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    sql = {r[0]: r[1:] for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op4_url_filter']})").fetchall()}
    assert all(sql[i] == tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in range(1000) if far[i])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "http://a.org/", "x" * 200_000 + '<a href="http://b.net/">', "", ""), (1, "http://b.net/", "", "", "")]])
def test_awkward_tables(spark, rows):
    got = uf.url_verdicts(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows) and all(r["verdict"] == "allow" for r in got)
    if len(rows) == 2:
        assert {r["host"]: r["trust"] > 0 for r in got} == {"a.org": True, "b.net": True}
