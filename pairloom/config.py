"""Parameters of matching."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Matching:
    """Fixed default values; each can be replaced.

    gamma, q: key similarity above which two attributes match (q-gram similarity is at most 0.5, so by default none
    does), and the length of q-grams. mu: weight of the title. alpha, beta, delta, eta, least_title: of title
    similarity. rich: attributes beyond which the fast score leaves titles out. size_gap: inches between screen sizes
    that still count as one.
    """

    gamma: float = 0.70
    mu: float = 0.65
    q: int = 3
    alpha: float = 0.6
    beta: float = 0.1
    delta: float = 0.4
    eta: float = 0.0
    least_title: float = 0.3
    rich: int = 20
    size_gap: float = 1.0


#: Distances and similarities of the usual sweeps: 0.05 to 0.90.
STEPS = tuple(round(0.05 * k, 2) for k in range(1, 19))
