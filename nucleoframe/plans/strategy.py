"""Choice of the plan for a mismatch-tolerant join."""

from __future__ import annotations

# Spaced seeds that find every placement of m letters with k mismatches.
SEEDS = {
    (6, 1): ["#-#-#"],
    (7, 1): ["##-#-"],
    (7, 2): ["##-#", "#--##"],
    (8, 1): ["###-#"],
    (9, 1): ["##-##-#"],
    (9, 2): ["###-#-", "#--###"],
    (10, 1): ["######--", "##-#-###-"],
    (10, 2): ["####---", "-#--###"],
    (11, 1): ["###-##--"],
    (11, 2): ["####-#-", "#-#---###"],
    (12, 1): ["###-###--"],
    (12, 2): ["#####---", "#-#--###"],
    (13, 1): ["####-###-"],
    (13, 2): ["#####--#-", "#--#-#-###"],
    (14, 1): ["####-####-"],
    (14, 2): ["#####--##", "##--#-#-###"],
    (15, 1): ["###-###-###-"],
    (15, 2): ["######--#-", "##--#-#-#-##"],
    (16, 1): ["###-###-###-#"],
    (16, 2): ["#####-#-##-", "#-##--#####"],
    (17, 1): ["###-###-###-##"],
    (17, 2): ["#######-#--", "#-#-#--##--###"],
    (18, 1): ["##-##-##-##-##-#"],
    (18, 2): ["######-#-##-", "#-##--######"],
    (19, 1): ["###-###-###-###-"],
    (19, 2): ["####-###-#--##", "##-#--####-###"],
}


def blocks(m: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` disjoint blocks (offset, length) of a word of ``m`` letters: with k mismatches, one of them agrees."""
    if not 0 <= k < m:
        raise ValueError("mismatches must be fewer than letters")
    base, more = divmod(m, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = base + (i < more)
        out.append((at, n))
        at += n
    return out


def choose(m: int, k: int, overhang: int = 0) -> str:
    """``exact`` for no mismatches, ``seed`` where a lossless seed is known, else ``blocks``; ``brute`` only for placements beyond the ends."""
    if overhang:
        return "brute"
    if k == 0:
        return "exact"
    return "seed" if (m, k) in SEEDS else "blocks"
