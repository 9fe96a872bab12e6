"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query (``trigrams``).
The index has a posting (trigram, document) for every trigram that some rule
asks for; a rule's candidates are the documents whose postings cover one of its
clauses.  Candidates are verified with the expression itself.  Rules without a
mandatory trigram (``hex``) scan every text.

Spans are (kind, start, end) in code points, end exclusive: the leftmost
non-overlapping matches of each kind, less those whose measured group is too
short.  Base kinds are ``assign``, ``access`` and ``hex``; the further kinds add
spans and take none away.

Edge cases.  A null or empty text has no spans.  Rows that repeat an id with
another text are told apart by a hash of the text; identical rows get the same
result each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    """Characters that the group must have."""


# Fixed values of the contract.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Formats that the services publish.
FURTHER_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + FURTHER_RULES

SPAN = "array<struct<start:bigint,end:bigint>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule: the pieces between matches, and the matches, give the positions.

    ``[0-9a-f]+`` is asked for at its least length, which finds the same spans in fewer matches.
    """
    pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("b")),
        lambda x: F.struct(F.length(x["b"]).cast("long").alias("before"), F.length(x["m"]).cast("long").alias("size"), F.length(x["g"]).alias("measured")),
    )
    none = F.array().cast(SPAN)
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["before"] + x["size"]).alias("at"),
            F.when(
                x["measured"] >= rule.least,
                F.concat(a["spans"], F.array(F.struct((a["at"] + x["before"]).alias("start"), (a["at"] + x["before"] + x["size"]).alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    # most texts have no match, and are done with one scan
    return F.when(text.rlike(pattern), walked).otherwise(none)


def clauses(rules: tuple[Rule, ...]) -> list[tuple[int, int, list[str]]]:
    """(rule, clause, trigrams) of the rules that have mandatory trigrams."""
    out = []
    for i, rule in enumerate(rules):
        for j, clause in enumerate(trigrams.query(rule.pattern) or []):
            out.append((i, j, clause))
    return out


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, id, mark) for each trigram of the vocabulary that a text holds, in lower case."""
    lowered = docs.select("id", "mark", F.lower("text").alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return lowered.select("id", "mark", F.explode(held).alias("trigram"))


def candidates(posted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, mark, rules): the documents whose postings cover a clause, and of which rules.

    The postings of a document meet in one small row, in which each rule's clauses are intersected.
    """
    found = posted.groupBy("id", "mark").agg(F.collect_set("trigram").alias("held"))
    by_rule: dict[int, list[list[str]]] = {}
    for i, _, clause in clauses(rules):
        by_rule.setdefault(i, []).append(clause)
    covered = [
        F.when(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.array_contains("held", t) for t in clause)) for clause in each)), F.lit(i))
        for i, each in by_rule.items()
    ]
    return found.select("id", "mark", F.array_compact(F.array(*covered)).alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: spans, an array of (kind, start, end) sorted by start, then by the order of the rules."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    indexed = {i for i, _, _ in clauses(rules)}
    whole = [i for i in range(len(rules)) if i not in indexed]

    def struct_of(i: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rule"), s["end"].alias("end"), F.lit(rules[i].kind).alias("kind")))

    def joined(which: list[int], only: bool) -> Column:
        kinds = "array<struct<start:bigint,rule:int,end:bigint,kind:string>>"
        none = F.array().cast(kinds)
        spans = [struct_of(i, _spans(F.col("text"), rules[i])) for i in which]
        if only:
            spans = [F.when(F.array_contains("rules", i), s).otherwise(none) for i, s in zip(which, spans, strict=True)]
        return F.concat(none, *spans)

    scanned = texts.select("id", "mark", joined(whole, only=False).alias("whole"))
    if not indexed:
        out = scanned.withColumn("verified", F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>"))
    else:
        vocabulary = sorted({t for _, _, clause in clauses(rules) for t in clause})
        found = candidates(postings(texts, vocabulary), rules)
        verified = (
            texts.where("text != ''")
            .join(found.select(F.col("id").alias("i"), F.col("mark").alias("m"), "rules"), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
            .select("i", "m", joined(sorted(indexed), only=True).alias("verified"))
            .where(F.size("verified") > 0)
            .groupBy("i", "m")
            .agg(F.first("verified").alias("verified"))
        )
        out = scanned.join(verified, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    return out.select(F.col("id").alias(id_col), F.array_sort(F.concat("whole", F.coalesce("verified", F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")))).alias("spans"))


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in BASE_RULES]
    return scanned.select(F.col(id_col), *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
