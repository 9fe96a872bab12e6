"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from . import suffix_dedup
from . import url_filter as url
from .decontamination import WINDOW
from .secrets import BASE_RULES, RULES
from .url_filter import LOWER, UPPER

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = _quoted(f"{r.pattern[:-1]}{{{r.least},}}" if r.kind == "hex" else r.pattern)
        parts.append(
            f"SELECT rid, {i} AS rule, '{r.kind}' AS kind, j, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, regexp_split_to_array(t, {pattern}) AS s, {r.least} AS least "
            f"FROM (SELECT rid, t, unnest(range(1, len(regexp_extract_all(t, {pattern}, 0)) + 1)) AS j FROM d WHERE regexp_matches(t, {pattern}))"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    n = len(BASE_RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 f AS ({' UNION ALL '.join(parts)}),
 p AS (SELECT rid, rule, kind, CAST(list_sum(list_transform(s[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[j]) AS size FROM f WHERE length(g[j]) >= least),
 x AS (SELECT rid, {counts}, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rule) FILTER (rule < {n}) AS base, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rule) AS spans FROM p GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (rid)"""


_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
 win AS (SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
 twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
 rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT win.rid, unnest(range(win.i, win.i + 8)) AS p FROM win JOIN twice USING (rid, g)) GROUP BY rid),
 m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines, coalesce(rep.n, 0) AS n_repeat_words,
   len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS upper_words,
   len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters FROM d LEFT JOIN rep USING (rid)),
 n AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR 2 * upper_words > n_words OR 10 * stutters > 3 * n_words OR 2 * n_dup_lines > len(lines) OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept FROM n"""

_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS g FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM win),
 dw AS (SELECT rid, k, i, w[i:i + k - 1] AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
 hit AS (SELECT rid, i, dw.k, item FROM dw JOIN win USING (g)),
 n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
 items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN items USING (rid)"""



def _host(column: str) -> str:
    return f"translate(regexp_extract({column}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _target(column: str, base: str) -> str:
    link = column
    for pattern, sign in url.REFERENCES:
        link = f"regexp_replace({link}, {_quoted(pattern)}, '{sign}', 'g')"
    return f"(SELECT CASE WHEN regexp_matches(l, {_quoted(url.SCHEME + '//')}) THEN {_host('l')} WHEN regexp_matches(l, {_quoted(url.SCHEME)}) THEN '' ELSE {base} END FROM (SELECT CASE WHEN {link} LIKE '//%' THEN 'http:' || {link} ELSE {link} END AS l))"


def _url_filter() -> str:
    """Ranks as sums over walks from the seeds: giving the rank of hosts without edges back to the seeds scales all of them alike."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url.RULES)

    def rank(name: str, verdict: str, near: str, far: str) -> str:
        return f"""{name}_seed AS (SELECT host, count(*) / sum(count(*)) OVER () AS mass FROM j WHERE verdict = '{verdict}' GROUP BY host),
 {name}_flow AS (SELECT {near} AS a, {far} AS b, n / sum(n) OVER (PARTITION BY {near}) AS share FROM e),
 {name}_walk AS (SELECT 0 AS k, host, mass AS m FROM {name}_seed UNION ALL SELECT k + 1, b, sum(m * share) * {url.DAMPING} FROM {name}_walk JOIN {name}_flow ON a = host WHERE k < 200 GROUP BY k, b),
 {name} AS (SELECT host, sum(m) / (SELECT sum(m) FROM {name}_walk) AS score FROM {name}_walk GROUP BY host)"""

    return f"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS rid, page_id, {_host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
 r AS (SELECT * FROM (VALUES {rules}) t(v, h, pre)),
 j AS (SELECT rid, page_id, host, path, html, max_by(h || pre, length(h || pre)) AS rule, max_by(v, length(h || pre)) AS verdict FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, pre) GROUP BY ALL),
 based AS (SELECT host, html, {_target(f"regexp_extract(html, {_quoted(url.BASE)}, 1)", "''")} AS base FROM j),
 links AS (SELECT host, base, unnest(regexp_extract_all(html, {_quoted(url.LINK)}, 1)) AS link FROM based),
 e AS (SELECT host AS src, dst, count(*) AS n FROM (SELECT host, {_target("link", "base")} AS dst FROM links) WHERE host != '' AND dst != '' AND dst != host GROUP BY host, dst),
 {rank("trust", "allow", "src", "dst")},
 {rank("distrust", "block", "dst", "src")}
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) > 0 AND coalesce(d.score, 0) >= {url.THRESHOLD} * coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN trust t ON t.host = j.host LEFT JOIN distrust d ON d.host = j.host"""


_LINE_DEDUP = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
 l AS (SELECT rid, doc_id, i, s[i] AS line, s[i] || chr(10) || s[i + 1] AS two FROM (SELECT rid, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS s FROM d))),
 a AS (SELECT rid, i, row(doc_id, i) = min(row(doc_id, i)) OVER (PARTITION BY two) AS first FROM l WHERE two IS NOT NULL AND regexp_matches(two, '[^\x20\x09-\x0D]')),
 gone AS (SELECT DISTINCT rid, unnest([i, i + 1]) AS i FROM a WHERE NOT first),
 kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (rid, i) GROUP BY l.rid)
SELECT doc_id, length(coalesce(text, '')) AS n_chars, length(coalesce(t, '')) AS n_kept_chars, length(coalesce(t, '')) < length(coalesce(text, '')) AS changed, sha256(coalesce(t, '')) AS text_sha256 FROM d LEFT JOIN kept USING (rid)"""

_LOWER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WORDS})"


def _reach(nodes: str) -> str:
    """Components of the links (a, b), both ways round, as (node, least)."""
    return f"""reach(node, other) AS (SELECT a, b FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
 least AS (SELECT node, min(other) AS least FROM (SELECT node, other FROM reach UNION ALL SELECT {nodes}) GROUP BY node)"""


def _near_duplicates(shingle: int = 3, percent: int = 85) -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER_WORDS} AS w FROM documents),
 sh AS (SELECT DISTINCT rid, array_to_string(w[i:i + {shingle - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
 same AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid != b.rid GROUP BY ALL),
 links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM same JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y JOIN d p ON p.rid = x JOIN d q ON q.rid = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
 {_reach('doc_id, doc_id FROM d')}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id, doc_id = least AS kept FROM d LEFT JOIN n USING (rid) LEFT JOIN least ON node = doc_id"""


def _suffix_dedup(k: int = suffix_dedup.MIN_WORDS) -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER_WORDS} AS w, regexp_split_to_array(coalesce(text, ''), {_WORDS}) AS s FROM documents),
 place AS (SELECT rid, i, sum(length(s[i]) + length(w[i])) OVER (PARTITION BY rid ORDER BY i) AS stop, length(w[i]) AS size FROM (SELECT rid, w, s, unnest(range(1, len(w) + 1)) AS i FROM d)),
 win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {k - 1}], ' ')) AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})),
 twice AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
 hit AS (SELECT rid, doc_id, i, first, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM win JOIN twice USING (g)),
 passage AS (SELECT rid, min(i) AS lo, max(i) + {k - 1} AS hi FROM hit GROUP BY rid, run),
 span AS (SELECT passage.rid, lo, CAST(p.stop - p.size AS BIGINT) || ':' || CAST(q.stop AS BIGINT) AS span FROM passage JOIN place p ON p.rid = passage.rid AND p.i = lo JOIN place q ON q.rid = passage.rid AND q.i = hi),
 spans AS (SELECT rid, count(*) AS n_repeats, string_agg(span, ',' ORDER BY lo) AS spans FROM span GROUP BY rid),
 covered AS (SELECT rid, count(DISTINCT p) AS n_words FROM (SELECT rid, unnest(range(lo, hi + 1)) AS p FROM passage) GROUP BY rid),
 copies AS (SELECT rid, any_value(doc_id) AS doc_id, bool_or(first < doc_id) AS copy FROM hit GROUP BY rid),
 links AS (SELECT DISTINCT doc_id AS a, first AS b FROM hit UNION SELECT first, doc_id FROM hit),
 {_reach('doc_id, doc_id FROM copies')}
SELECT doc_id, n_repeats, n_words, spans, least AS class_id, copy FROM copies JOIN spans USING (rid) JOIN covered USING (rid) JOIN least ON node = doc_id"""


ORACLES = {
    "op1_secrets": _secrets(),
    "op2_suffix_dedup": _suffix_dedup(),
    "op3_quality": _QUALITY,
    "op4_url_filter": _url_filter(),
    "op5_line_dedup": _LINE_DEDUP,
    "op8_near_duplicates": _near_duplicates(),
    "op10_decontamination": _DECONTAMINATION,
}
