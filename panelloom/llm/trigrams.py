"""Boolean queries over trigrams that every match of a regular expression must satisfy.

Trigrams are three consecutive bytes of the text with A-Z as a-z.  A query is
``None`` (no condition), a trigram, or ("and" | "or", parts).  The derivation walks the
parsed expression and keeps, for each part, the few strings it can be, or
the strings it can begin and end with; wherever these are long enough, one of them
must occur, so one of their sets of trigrams must.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser
from typing import NamedTuple

# Sets of alternatives larger than this say nothing.
STRINGS = 48
CLASS = 8
COPIES = 4

Query = str | tuple | None


class Part(NamedTuple):
    exact: frozenset | None  # all strings, if few
    begins: frozenset
    ends: frozenset
    query: Query


ANY = Part(None, frozenset([""]), frozenset([""]), None)
EMPTY = Part(frozenset([""]), frozenset([""]), frozenset([""]), None)


def both(*parts: Query) -> Query:
    flat = sorted({q for p in parts if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))}, key=repr)
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def either(*parts: Query) -> Query:
    if any(p is None for p in parts):
        return None
    flat = sorted(set(parts), key=repr)
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_string(s: str) -> Query:
    raw = s.encode().decode("latin-1")
    return both(*[raw[i : i + 3] for i in range(len(raw) - 2)])


def of_strings(strings: frozenset) -> Query:
    return either(*[of_string(s) for s in strings]) if len(strings) <= STRINGS else None


def whole(p: Part) -> Query:
    return p.query if p.exact is None else both(p.query, of_strings(p.exact))


def exact(strings) -> Part:
    strings = frozenset(strings)
    return Part(strings, strings, strings, None)


def followed(x: Part, y: Part) -> Part:
    """x, then y."""
    heads, tails = (x.ends if x.exact is None else x.exact), (y.begins if y.exact is None else y.exact)
    joint = frozenset(a + b for a in heads for b in tails) if len(heads) * len(tails) <= STRINGS else None
    if joint is not None and x.exact is not None and y.exact is not None:
        return Part(joint, joint, joint, both(x.query, y.query))
    if joint is None:
        query = both(whole(x), whole(y))
        joint_begins, joint_ends = (x.exact or frozenset([""])), (y.exact or frozenset([""]))
    else:
        query = both(x.query, y.query, of_strings(joint))
        joint_begins = joint_ends = joint
    begins = x.begins if x.exact is None else joint_begins
    ends = y.ends if y.exact is None else joint_ends
    return Part(None, frozenset(s[:2] for s in begins), frozenset(s[-2:] for s in ends), query)


def one_of(parts: list[Part]) -> Part:
    strings = frozenset().union(*[p.exact or () for p in parts])
    query = either(*[p.query for p in parts])
    if all(p.exact is not None for p in parts) and len(strings) <= STRINGS:
        return Part(strings, strings, strings, query)
    begins, ends = frozenset().union(*[p.begins for p in parts]), frozenset().union(*[p.ends for p in parts])
    return Part(None, frozenset(s[:2] for s in begins), frozenset(s[-2:] for s in ends), either(*[whole(p) for p in parts]))


def folded(code: int) -> str:
    """The character, A-Z as a-z; others keep their case, as in the index."""
    return chr(code + 32 if 65 <= code <= 90 else code)


def characters(items) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(folded(value))
        elif op is C.RANGE and value[1] - value[0] < CLASS:
            found |= {folded(c) for c in range(value[0], value[1] + 1)}
        else:
            return ANY
    return exact(found) if len(found) <= CLASS else ANY


def part(parsed) -> Part:
    out = EMPTY
    for op, value in parsed:
        if op is C.LITERAL:
            now = exact([folded(value)])
        elif op is C.IN:
            now = characters(value)
        elif op is C.BRANCH:
            now = one_of([part(p) for p in value[1]])
        elif op is C.SUBPATTERN:
            now = part(value[-1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = part(inner)
            now = EMPTY
            for _ in range(min(low, COPIES)):
                now = followed(now, once)
            if low == 0 and high == 1:
                now = one_of([EMPTY, once])
            elif high > min(low, COPIES):
                now = followed(now, ANY)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            now = EMPTY  # without width
        else:
            now = ANY
        out = followed(out, now)
    return out


def query_of(pattern: str) -> Query:
    """The condition on the trigrams of any text with a match; None if there is none."""
    return whole(part(_parser.parse(pattern)))


def mentioned(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[mentioned(q) for q in query[1]])
