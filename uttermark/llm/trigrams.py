"""Boolean trigram queries of regular expressions."""

from __future__ import annotations

from itertools import product
from re import _parser as parser

MOST_STRINGS, MOST_CHARACTERS = 64, 16


def trigrams_of(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def _alternatives(op, argument) -> list[str] | None:
    """All strings a node can match, in lower case; None if they are too many to name."""
    name = str(op)
    if name == "LITERAL":
        return [chr(argument).lower()]
    if name == "IN":
        letters: set[str] = set()
        for kind, value in argument:
            if str(kind) == "LITERAL":
                letters.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_CHARACTERS:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(letters) if len(letters) <= MOST_CHARACTERS else None
    if name == "SUBPATTERN":
        return _strings(argument[3])
    if name == "BRANCH":
        found: list[str] = []
        for branch in argument[1]:
            some = _strings(branch)
            if some is None:
                return None
            found += some
        return sorted(set(found))
    if name == "MAX_REPEAT":
        least, most, inner = argument
        some = _strings(inner)
        if some is None or int(most) > 3:
            return None
        return sorted({"".join(p) for n in range(least, int(most) + 1) for p in product(some, repeat=n)})
    return [""] if name == "AT" else None


def _strings(nodes) -> list[str] | None:
    whole = [""]
    for op, argument in nodes:
        some = _alternatives(op, argument)
        if some is None or len(whole) * len(some) > MOST_STRINGS:
            return None
        whole = sorted({a + b for a in whole for b in some})
    return whole


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """All of these clauses hold wherever ``pattern`` matches, A-Z in lower case: any alternative, all its trigrams.

    Neighbouring parts whose strings can be named are joined as far as they stay few; a run ends at a part
    with too many strings.  A run with a string of fewer than three characters demands nothing.  No clause
    at all means that the rule has no mandatory trigram.
    """
    clauses, run = [], [""]

    def close() -> None:
        if all(len(text) >= 3 for text in run):
            clauses.append([sorted(set(trigrams_of(text))) for text in run])

    def walk(nodes) -> None:
        nonlocal run
        for op, argument in nodes:
            some = _alternatives(op, argument)
            if some is None and str(op) == "SUBPATTERN":
                walk(argument[3])
            elif some is None and str(op) == "MAX_REPEAT" and argument[0] > 0:
                close()
                run = [""]
                walk(argument[2])
                close()
                run = [""]
            elif some is None or len(run) * len(some) > MOST_STRINGS:
                close()
                run = [""] if some is None else some
            else:
                run = sorted({a + b for a in run for b in some})

    walk(parser.parse(pattern))
    close()
    return [list(clause) for clause in {tuple(map(tuple, c)): c for c in clauses}.values()]
