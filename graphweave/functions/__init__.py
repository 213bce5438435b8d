"""Column functions, and what tasks need of them in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(walker: Column, step: Column, size: Column, seed: int = 42) -> Column:
    """A number in 0..size-1, fixed by walker, step and seed: whole-number arithmetic that any SQL engine repeats."""
    # a product of two ints is an int, which is too small from step 16 on
    state = F.pmod(walker.cast("long") * 1103515245 + step.cast("long") * 134775813 + F.lit(seed * 69069).cast("long"), F.lit(1 << 31))
    return F.pmod(F.shiftright(state.cast("long"), 8), size)


def drawn(walker: np.ndarray, step: int, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """The numbers of `draw` in a task; int64 that wrap around leave the lower 31 bits as they are."""
    state = (walker * 1103515245 + (step * 134775813 + seed * 69069)) & ((1 << 31) - 1)
    return (state >> 8) % size


def hashed(seed: int, key: Column, draw_: Column, size: int) -> Column:
    """A number in 0..size-1 from 60 bits of an MD5 of seed, key and draw; draws of one key do not depend on each other."""
    text = F.concat_ws(":", F.lit(seed), key, draw_)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))
