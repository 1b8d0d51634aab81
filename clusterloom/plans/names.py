"""Names for columns of our own beside columns that a caller named."""

from __future__ import annotations


def fresh(columns: list[str], *names: str) -> list[str]:
    """`names`, each with underscores in front until no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
