"""Random numbers that are a function of a key and a counter, and draws from weighted parts.

Philox with two 32-bit words: a key and a two-word counter give two numbers, so every draw can
be made anywhere, in any order and again after a failure, and in any engine with 64-bit
unsigned arithmetic.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Multiplier and key increment of Philox 2x32, and its number of rounds.
MULTIPLIER = 0xD256D193
INCREMENT = 0x9E3779B9
ROUNDS = 10
LOW = 0xFFFFFFFF


def philox(key: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit numbers for each key and counter (all below 2**32, as unsigned 64-bit; shapes broadcast)."""
    x, y = (np.array(a, dtype=U) for a in np.broadcast_arrays(first, second))
    key = np.asarray(key, dtype=U)
    for r in range(ROUNDS):
        product = x * U(MULTIPLIER)
        x = (product >> U(32)) ^ ((key + U(r * INCREMENT & LOW)) & U(LOW)) ^ y
        y = product & U(LOW)
    return x, y


def uniforms(key: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each key and counter."""
    return tuple((n.astype(np.float64) + 0.5) / 4294967296.0 for n in philox(key, first, second))


def stream(key: int, second: int, counters: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) with 53 bits for the counters of a stream, which its two 32-bit words name."""
    counters = np.asarray(counters, dtype=U)
    x, y = philox(np.array(key, dtype=U), counters & U(LOW), (U(second) + (counters >> U(32))) & U(LOW))
    return (x.astype(np.float64) * 2097152.0 + (y >> U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def split_draws(draws: int, weights: np.ndarray, key: int, second: int, first: int = 0, direct: int = 1 << 20) -> np.ndarray:
    """How many of ``draws`` independent draws fall on each weight (multinomial counts).

    Up to ``direct`` draws are made one by one, from counter ``first`` on; more are split by conditional
    binomials, one a weight, seeded by the same words.
    """
    if not draws or not weights.sum() > 0:
        return np.zeros(len(weights), dtype=np.int64)
    if draws > direct:
        rng = np.random.Generator(np.random.Philox(key=[key, second]))
        return rng.multinomial(draws, weights / weights.sum())
    upto = np.cumsum(weights)
    place = np.searchsorted(upto, stream(key, second, np.arange(first, first + draws)) * upto[-1], side="right")
    # A product may round up to the total, which belongs to the last positive weight.
    return np.bincount(np.minimum(place, np.flatnonzero(weights > 0)[-1]), minlength=len(weights))


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of positive total weight the share a part keeps of its column, and the part that has the rest.

    The smallest open column takes what it lacks from the largest other one; ties go to the first.
    """
    rows, k = weights.shape
    total = weights[:, 0].copy()
    for j in range(1, k):
        total = total + weights[:, j]
    left = weights * k / total[:, None]
    share, other = np.ones((rows, k)), np.tile(np.arange(k), (rows, 1))
    at, open_ = np.arange(rows), np.ones((rows, k), dtype=bool)
    for _ in range(k - 1):
        low = np.argmin(np.where(open_, left, np.inf), axis=1)
        open_[at, low] = False
        high = np.argmax(np.where(open_, left, -np.inf), axis=1)
        share[at, low], other[at, low] = left[at, low], high
        left[at, high] = left[at, high] + left[at, low] - 1
    return share, other


def alias_draw(share: np.ndarray, other: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Parts (rows x draws) for numbers in (0, 1): the column, then its own part or the other."""
    k = share.shape[1]
    at = choice * k
    column = np.minimum(at.astype(np.int64), k - 1)
    own = at - column < np.take_along_axis(share, column, 1)
    return np.where(own, column, np.take_along_axis(other, column, 1))
