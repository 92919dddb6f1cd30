"""The range workload of the usual benchmark: ranges of one width from a seeded linear congruential generator."""

from __future__ import annotations


def random_doubles(seed: int, count: int) -> list[float]:
    """What java.util.Random(seed).nextDouble() gives, by its published recurrence of 48 bits."""
    mask = (1 << 48) - 1
    state, out = (seed ^ 0x5DEECE66D) & mask, []

    def bits(n: int) -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & mask
        return state >> (48 - n)

    for _ in range(count):
        out.append(((bits(26) << 27) + bits(27)) / (1 << 53))
    return out


def random_ranges(count: int, low: float = 1.0, high: float = 100.0, width: float = 20.0, seed: int = 42) -> list[tuple[float, float]]:
    """(lower, upper) of ``count`` ranges of one width between ``low`` and ``high``."""
    starts = [low + x * (high - width - low) for x in random_doubles(seed, count)]
    return [(a, a + width) for a in starts]
