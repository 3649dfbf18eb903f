"""Numbers: reproducible random generators, ratios, and the formats of the reports."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the linear congruential generator and of the seeds
LCG_A, LCG_C, LCG_SEED = 1664525, 1013904223, 20260830
SHUFFLE_SEED = 20260829
RESAMPLES = 1000


def lcg_jump(state: int, steps: int) -> int:
    """The state that many steps on, by squaring the step."""
    a, c = LCG_A, LCG_C
    while steps:
        if steps & 1:
            state = (state * a + c) & 0xFFFFFFFF
        a, c = a * a & 0xFFFFFFFF, (a * c + c) & 0xFFFFFFFF
        steps >>= 1
    return state


def lcg_states(n: int, seed: int = LCG_SEED, skip: int = 0) -> np.ndarray:
    """n states after the seed, without the first `skip`, modulo 2 ** 32, by doubling what is known."""
    seed = lcg_jump(seed, skip)
    out = np.array([(seed * LCG_A + LCG_C) & 0xFFFFFFFF], np.uint64)
    a, c = LCG_A, LCG_C
    while len(out) < n:
        out = np.concatenate([out, (out * np.uint64(a) + np.uint64(c)) & np.uint64(0xFFFFFFFF)])
        a, c = a * a & 0xFFFFFFFF, (a * c + c) & 0xFFFFFFFF
    return out[:n]


def mulberry32(seed: int):
    """The generator mulberry32: 32-bit steps, numbers in [0, 1)."""
    state, low = seed & 0xFFFFFFFF, 0xFFFFFFFF

    def step() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & low
        x = ((state ^ (state >> 15)) * (state | 1)) & low
        x ^= (x + ((x ^ (x >> 7)) * (x | 61) & low)) & low
        return ((x ^ (x >> 14)) & low) / 2**32

    return step


def permutation(n: int, seed: int = SHUFFLE_SEED) -> array:
    """The order of indexes that a seeded Fisher-Yates shuffle gives; sequential by nature, over indexes only."""
    draw, order = mulberry32(seed), array("q", range(n))
    for last in range(n - 1, 0, -1):
        other = int(draw() * (last + 1))
        order[last], order[other] = order[other], order[last]
    return order


def half_up(x: Column) -> Column:
    """Rounded to whole, halves up also below zero."""
    return F.floor(x + 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def points(x: Column) -> Column:
    """Percentage points with a sign."""
    return F.concat(F.when(x >= 0, "+").otherwise("−"), F.abs(half_up(x * 100)).cast("bigint").cast("string"))


def grade_cell(passed: Column, score: Column) -> Column:
    """The pass rate, with the mean score where it says more; n/a without either."""
    both = F.concat(percent(passed), F.lit(" (avg "), percent(score), F.lit(")"))
    return F.when(passed.isNull(), "n/a").when(F.abs(passed - score) > 0.005, both).otherwise(percent(passed))
