"""Column names that no caller's column has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as make it differ from ``taken`` and from each other, in any case."""
    held, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
