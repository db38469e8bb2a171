"""Additive covers: which stored sources answer a request for several sources without counting a member twice."""

from __future__ import annotations


def additive_cover(definitions: dict[str, set[str]], requested: list[str]) -> list[str]:
    """The sources to sum. A definition with exactly the requested members wins; else the largest definitions that fit
    disjointly, largest first and then by name; members that none covers stand for themselves."""
    wanted = set().union(*[definitions.get(r, {r}) for r in requested]) if requested else set()
    for name in sorted(definitions):
        if definitions[name] == wanted:
            return [name]
    left, out = set(wanted), []
    for name in sorted(definitions, key=lambda d: (-len(definitions[d]), d)):
        if definitions[name] and definitions[name] <= left:
            out.append(name)
            left -= definitions[name]
    return sorted(out) + sorted(left)


def adaptive_granularity(days: float) -> str:
    """The stored granularity that suits a range of days."""
    return "5m" if days <= 4 else "30m" if days <= 19 else "1h" if days <= 62 else "1d"
