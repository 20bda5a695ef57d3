"""Column names to members of a schema, in five passes of falling certainty."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

LEAST_RESEMBLANCE, MOST_EDITS = 4, 2


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def parts(name: str) -> list[str]:
    """Words of a name: at blanks, punctuation and changes of case."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def variants(name: str) -> list[str]:
    words = parts(name)
    return ["".join(re.split(r"[\s']", name)).lower(), "_".join(words), "".join(words), name.lower()]


def resemblance(a: str, b: str) -> int:
    """5 if one begins the other, 5 if one ends it, 3 if one is within it, and 1 for each common word."""
    x, y = a.lower(), b.lower()
    score = 5 * (x.startswith(y) or y.startswith(x)) + 5 * (x.endswith(y) or y.endswith(x)) + 3 * (x in y or y in x)
    return score + len(set(parts(a)) & set(parts(b)))


def resolve(columns: Sequence[str], members: Sequence[str]) -> dict[str, str]:
    """column -> member for those that resolve. A member serves once; of equal candidates the shorter, then the first by name, wins."""
    found: dict[str, str] = {}
    free = list(members)

    def best(candidates: list[str]) -> str | None:
        return min(candidates, key=lambda m: (len(m), m), default=None)

    def run(pick: Callable[[str], str | None]) -> None:
        for c in columns:
            if c not in found and (m := pick(c)) is not None:
                found[c] = m
                free.remove(m)

    def scored(score: Callable[[str, str], int], enough: Callable[[int], bool]) -> Callable[[str], str | None]:
        def pick(c: str) -> str | None:
            m = min(free, key=lambda m: (score(c, m), len(m), m), default=None)
            return m if m is not None and enough(score(c, m)) else None

        return pick

    run(lambda c: c if c in free else None)
    run(lambda c: best([m for m in free if m.lower() == c.lower()]))
    for k in range(4):
        run(lambda c, k=k: best([m for m in free if variants(m)[k] in variants(c)]))
    run(scored(lambda c, m: -resemblance(c, m), lambda s: -s >= LEAST_RESEMBLANCE))
    run(scored(lambda c, m: edit_distance(c.lower(), m.lower()), lambda d: d <= MOST_EDITS))
    return found
