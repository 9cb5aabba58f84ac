"""What several test modules share."""

from __future__ import annotations

import random


def sentence(rng: random.Random, n: int, pool: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def change(rng: random.Random, text: str, n: int) -> str:
    """The text with n words replaced."""
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)
