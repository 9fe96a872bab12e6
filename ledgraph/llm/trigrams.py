"""Boolean trigram queries from regular expressions.

A text can match a pattern only if it holds certain trigrams (in lower case).
``query`` derives this condition in disjunctive form: a list of trigram sets, at
least one of which must be present as a whole.  ``None`` means that no trigram
is mandatory, so that every text has to be scanned.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

MOST_STRINGS = 64
"""Exact strings followed at once; beyond that the trigrams known so far are kept and the rest starts anew."""
MOST_CLAUSES = 32

Clause = frozenset[str]
Query = frozenset[Clause]
ALL: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x, y in product(a, b))
    return _slim(out) if len(out) <= MOST_CLAUSES else min(a, b, key=lambda q: (q == ALL, len(q)))


def _or(a: Query, b: Query) -> Query:
    out = _slim(a | b)
    return out if len(out) <= MOST_CLAUSES else ALL


def _slim(q: Query) -> Query:
    """Without clauses that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: frozenset[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        if len(s) < 3:
            return ALL
        out = _or(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """The exact strings of a sequence (None: too many or endless), and what else it needs."""
    exact: frozenset[str] | None = frozenset([""])
    need = ALL
    whole = True
    for op, arg in items:
        one, sub = _node(op, arg)
        need = _and(need, sub)
        joined = frozenset(a + b for a, b in product(exact, one)) if one is not None and len(exact) * len(one) <= MOST_STRINGS else None
        if joined is None:
            need = _and(need, _of_strings(exact))
            exact, whole = (one if one is not None and len(one) <= MOST_STRINGS else frozenset([""])), False
        else:
            exact = joined
    if whole:
        return exact, need
    return None, _and(need, _of_strings(exact))


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ALL
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ALL
        return (frozenset(chars), ALL) if len(chars) <= 8 else (None, ALL)
    if op is C.SUBPATTERN:
        exact, need = _walk(arg[-1])
        return exact, need
    if op is C.BRANCH:
        exact, need = frozenset(), None
        for branch in arg[1]:
            one, sub = _walk(branch)
            full = _and(sub, _of_strings(one)) if one is not None else sub
            need = full if need is None else _or(need, full)
            exact = None if exact is None or one is None else exact | one
        return (exact, ALL) if exact is not None and len(exact) <= MOST_STRINGS else (None, need)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, need = _walk(body)
        if low == 0:
            return (exact | {""}, ALL) if high == 1 and exact is not None else (None, ALL)
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS:
            return frozenset("".join(x) for x in product(exact, repeat=low)), need
        return None, need if exact is None else _and(need, _of_strings(exact))
    if op is C.AT:
        return frozenset([""]), ALL
    return None, ALL


def query(pattern: str) -> list[list[str]] | None:
    """Clauses of lower-case trigrams, one of which every matching text holds; None if none is mandatory."""
    exact, need = _walk(_parser.parse(pattern))
    out = _and(need, _of_strings(exact)) if exact is not None else need
    return None if frozenset() in out else sorted(sorted(clause) for clause in out)
