"""A two-state linear-chain conditional random field over many short sequences at once.

State 1 of a token is "marked". With two states the forward and backward
messages are ratios, so a step of all sequences is a few array operations.
Sequences are ordered by length; at step t only the longer ones take part.
"""

from __future__ import annotations

import numpy as np


class Sequences:
    """Index of tokens that lie in consecutive sequences starting at ``first[:-1]``."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        self.begin, self.length = first[:-1][order], length[order]
        steps = int(self.length[0]) if len(order) else 0
        self.active = np.searchsorted(-self.length, -np.arange(steps), "left")
        self.size = int(first[-1])
        inner = np.ones(self.size, bool)
        inner[first[:-1][length > 0]] = False
        self.later = np.flatnonzero(inner)  # tokens with a token before them


def messages(seq: Sequences, psi: np.ndarray, start: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios of state 1 to state 0 of every token.

    ``psi``: ratio of the token's own weights; ``start``: of the first state;
    ``t``: the 2 x 2 transition weights.
    """
    ahead, back = np.empty(seq.size), np.ones(seq.size)
    for step, n in enumerate(seq.active):
        at = seq.begin[:n] + step
        before = start if step == 0 else (t[0, 1] + (a := ahead[at - 1]) * t[1, 1]) / (t[0, 0] + a * t[1, 0])
        ahead[at] = psi[at] * before
    for step in range(len(seq.active) - 1, 0, -1):
        at = seq.begin[:seq.active[step]] + step
        b = psi[at] * back[at]
        back[at - 1] = (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b)
    return ahead, back


def marginals(seq: Sequences, psi: np.ndarray, start: float, t: np.ndarray) -> np.ndarray:
    """Probability of state 1 of every token."""
    ahead, back = messages(seq, psi, start, t)
    odds = ahead * back
    return odds / (1 + odds)


def expected(seq: Sequences, psi: np.ndarray, start: float, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each of the four transitions."""
    ahead, back = messages(seq, psi, start, t)
    odds = ahead * back
    a, b = ahead[seq.later - 1], psi[seq.later] * back[seq.later]
    pair = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * b, a * t[1, 0], a * t[1, 1] * b])
    return odds / (1 + odds), (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
