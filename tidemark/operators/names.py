"""Column names for intermediate values that no caller's column bears."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Each wanted name, with as many underscores behind it as make it differ from all taken ones."""
    held = {t.lower() for t in taken}
    found = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found
