"""Boolean trigram queries that every text with a match of a regular expression meets."""

from __future__ import annotations

import re
from itertools import product

# Strings that a stretch of a pattern may stand for before it is left at that.
MOST_STRINGS = 64

# A query is a list of clauses that must all hold. A clause is a list of alternatives, of
# which one must hold: sets of trigrams that must all be in the text.
Clause = tuple[frozenset[str], ...]

_parser = re._parser  # the standard library's parser of patterns


def trigrams(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def query(pattern: str) -> list[Clause]:
    """The trigram query of a pattern, in lower case; no clause if nothing is mandatory.

    Stretches of the pattern that stand for a few strings are spelled out; what may be
    repeated or is one of many characters ends a stretch. A stretch whose strings all have
    three letters or more is a clause.
    """
    clauses: list[Clause] = []
    _end(_walk(_parser.parse(pattern), {""}, clauses), clauses)
    return list(dict.fromkeys(clauses))


def _walk(tree, strings: set[str], clauses: list[Clause]) -> set[str]:
    """Append what `tree` stands for to the strings of the stretch so far."""
    for kind, value in tree:
        options = _options(kind, value)
        if options is not None and len(options) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, options)}
            continue
        _end(strings, clauses)
        strings = {""}
        if str(kind) == "SUBPATTERN":
            strings = _walk(value[-1], strings, clauses)
        elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            _end(_walk(value[2], {""}, clauses), clauses)
    return strings


def _end(strings: set[str], clauses: list[Clause]) -> None:
    if min(map(len, strings)) >= 3:
        sets = {trigrams(s) for s in strings}
        least = [s for s in sets if not any(other < s for other in sets)]  # the rest say no more
        clauses.append(tuple(sorted(least, key=sorted)))


def _options(kind, value) -> set[str] | None:
    """The strings a part of a pattern stands for, in lower case; None if too many."""
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
        codes = {c for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
        return {chr(c).lower() for c in codes} if len(codes) <= 8 else None
    if name == "AT":
        return {""}
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        return _union([_sequence(x) for x in value[1]])
    if name == "MAX_REPEAT" and value[1] == 1:
        return _union([{""} if value[0] == 0 else set(), _sequence(value[2])])
    if name == "MAX_REPEAT" and value[0] == value[1] <= 8:
        inner = _sequence(value[2])
        if inner is not None and len(inner) ** int(value[0]) <= MOST_STRINGS:
            return {"".join(p) for p in product(inner, repeat=int(value[0]))}
    return None


def _sequence(tree) -> set[str] | None:
    strings = {""}
    for kind, value in tree:
        options = _options(kind, value)
        if options is None or len(options) * len(strings) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, options)}
    return strings


def _union(sets: list[set[str] | None]) -> set[str] | None:
    if any(s is None for s in sets):
        return None
    joined = set().union(*sets)
    return joined if len(joined) <= MOST_STRINGS else None
