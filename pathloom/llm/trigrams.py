"""Boolean trigram queries from regular expressions.

A query is a disjunction of conjunctions: a text that the expression matches has, lower-cased, all trigrams of at least
one of the sets. The set of the empty set holds for every text: such an expression has no mandatory trigrams.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]]

ALL: Query = frozenset([frozenset()])
#: More strings than this aren't followed further, only what they must hold.
STRINGS = 40


def _absorbed(sets) -> Query:
    sets = set(sets)
    return frozenset(s for s in sets if not any(other < s for other in sets))


def either(*queries: Query) -> Query:
    return _absorbed(s for q in queries for s in q)


def both(a: Query, b: Query) -> Query:
    return _absorbed(x | y for x in a for y in b)


def of_strings(strings: set[str]) -> Query:
    return _absorbed(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """All strings that a part can match, lower-cased, if they are few; and the query of the part."""
    exact, strings, query = True, {""}, ALL
    for kind, value in parsed:
        more, sub = _one(kind, value)
        if more is not None and len(strings) * len(more) <= STRINGS:
            strings = {a + b for a in strings for b in more}
            continue
        exact, query = False, both(query, of_strings(strings))
        if more is None:
            strings, query = {""}, both(query, sub)
        else:
            strings = more
    query = both(query, of_strings(strings))
    return (strings if exact else None), query


def _one(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ALL
    if kind is op.IN:
        found: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                found.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 8:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ALL
        return (found, ALL) if len(found) <= 8 else (None, ALL)
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        parts = [_walk(p) for p in value[1]]
        known = [s for s, _ in parts if s is not None]
        strings = set().union(*known) if len(known) == len(parts) else None
        return (strings if strings is not None and len(strings) <= STRINGS else None), either(*(q for _, q in parts))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if least == most == 1:
            return strings, query
        return None, query if least else ALL
    return ({""}, ALL) if kind is op.AT else (None, ALL)


def trigram_query(pattern: str) -> Query:
    return _walk(parser.parse(pattern, re.ASCII))[1]


def finder(trigrams: list[str]) -> str:
    """An expression that matches, without taking anything, wherever one of the trigrams begins; its group 1 is the
    trigram. What follows a first character is only looked at where that character is."""
    by: dict[str, dict[str, list[str]]] = {}
    for a, b, c in sorted(trigrams):
        by.setdefault(a, {}).setdefault(b, []).append(c)
    one_of = lambda chars: re.escape(chars[0]) if len(chars) == 1 else f"[{''.join(map(re.escape, chars))}]"
    tails = {a: "|".join(re.escape(b) + one_of(c) for b, c in of.items()) for a, of in by.items()}
    return f"(?={one_of(list(by))})(?=({'|'.join(f'{re.escape(a)}(?:{t})' for a, t in tails.items())}))"
