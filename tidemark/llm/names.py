"""Names of columns that an operator adds for itself."""

from __future__ import annotations


def unused(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be none of ``taken``, in any case."""
    known = {t.lower() for t in taken}
    return [next(n for k in range(len(known) + 1) if (n := "_" * k + name).lower() not in known) for name in names]
