"""Boolean trigram queries from regular expressions.

A query is a list of alternatives, each a set of trigrams that must all be in a
text (ASCII letters lowered) if the expression matches anywhere in it; ``None``
means that no trigram is mandatory. Anything that cannot be told is taken as
"matches any text", so a query may let too many texts through but never too few.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

MAX_STRINGS = 64   # alternatives of a literal run before it is cut
MAX_CLAUSES = 64   # alternatives of a whole query before its last factor is left out
MAX_SET = 8        # members of a character set that are spelled out

Query = list[frozenset[str]] | None


def mandatory(pattern: str) -> Query:
    return _sequence(parser.parse(pattern))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    return _smallest(both) if len(both) <= MAX_CLAUSES else a


def _smallest(clauses: set[frozenset[str]]) -> list[frozenset[str]]:
    kept = [c for c in clauses if not any(o < c for o in clauses)]
    return sorted(kept, key=lambda c: sorted(c))


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _smallest({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _exact(node: tuple) -> set[str] | None:
    """All strings a node can match, lowered, if they are few."""
    kind, arg = node
    if kind is op.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if kind is op.IN:
        found = set()
        for k, v in arg:
            if k is op.LITERAL and v < 128:
                found.add(chr(v).lower())
            elif k is op.RANGE and v[1] < 128 and v[1] - v[0] < MAX_SET:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= MAX_SET else None
    if kind is op.SUBPATTERN:
        return _exact_sequence(arg[3])
    if kind is op.BRANCH:
        parts = [_exact_sequence(s) for s in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] != op.MAXREPEAT and arg[1] <= 2:
        once = _exact_sequence(arg[2])
        if once is None:
            return None
        out, run = set(), {""}
        for i in range(int(arg[1]) + 1):
            out |= run if i >= arg[0] else set()
            run = {a + b for a in run for b in once}
        return out if len(out) <= MAX_STRINGS else None
    return {""} if kind is op.AT else None


def _exact_sequence(items) -> set[str] | None:
    total = {""}
    for item in items:
        part = _exact(item)
        if part is None or len(total) * len(part) > MAX_STRINGS:
            return None
        total = {a + b for a in total for b in part}
    return total


def _sequence(items) -> Query:
    query, run = None, {""}
    for kind, arg in items:
        part = _exact((kind, arg))
        if part is not None and len(run) * len(part) <= MAX_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            once = _exact_sequence(arg[2])
            if once is not None and len(run) * len(once) <= MAX_STRINGS:
                # The first copy follows what came before, the last leads what comes next.
                query, run = _and(query, _of_strings({a + b for a in run for b in once})), once
                continue
        query, run = _and(query, _of_strings(run)), {""}
        if part is not None:
            run = part
        elif kind is op.SUBPATTERN:
            query = _and(query, _sequence(arg[3]))
        elif kind is op.BRANCH:
            parts = [_sequence(s) for s in arg[1]]
            if all(p is not None for p in parts):
                query = _and(query, _smallest({c for p in parts for c in p}))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
            query = _and(query, _sequence(arg[2]))
    return _and(query, _of_strings(run))
