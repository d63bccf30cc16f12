"""Fixed small models of the evaluation queries, and their names."""

from __future__ import annotations

#: Merges in rank order. Fixed values, so that an encoding is one expression in either engine.
MERGES = (
    ("t", "h"), ("▁", "th"), ("o", "n"), ("i", "n"), ("e", "▁"), ("e", "r"), ("a", "n"), ("▁th", "e▁"), ("e", "n"), ("s", "▁"), ("in", "g"), ("▁", "a"),
    ("t", "i"), ("ti", "on"), (".", "▁"), ("d", "e"), ("c", "h"), ("n", "d"), ("e", "s"), ("o", "u"), ("▁", "d"), ("l", "e▁"), ("on", "▁"), ("r", "e"),
    ("s▁", "a"), ("e▁", "th"), ("n", "▁"), ("on▁", "th"),
)
SEEDS, BUDGETS = (0, 1, 2), (8, 16, 28)
ANSWER_CUT = "c"


def seed_merges(seed: int) -> tuple:
    """The model of a seed: seeds after the first leave some merges out."""
    return MERGES if seed == 0 else tuple(m for k, m in enumerate(MERGES) if k % (seed + 4) != seed)


def variants():
    """(method, budget, merges): merges that may take in a marker, or not."""
    for method in ("free", "word"):
        pool = MERGES if method == "free" else tuple(m for m in MERGES if "▁" not in m[0] + m[1])
        for budget in BUDGETS:
            yield method, budget, pool[:budget]
