"""Random numbers that depend only on the row key, so repartitioning never changes a result."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gapwise.functions.missing import c

_RANGE = float(2**32)

# Multiplier and shifts of the SplitMix64 finaliser (Steele, Lea and Flood 2014).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit words; overflow is meant, callers silence it."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def scramble(row_hash: np.ndarray, seed: int, step: int) -> np.ndarray:
    """64 random bits per row that depend only on its hash, the seed and the step."""
    with np.errstate(over="ignore"):
        salt = mixed(np.array([seed % 2**63], dtype=np.uint64) * GOLDEN + np.uint64(step + 1))
        return mixed(row_hash.astype(np.int64).view(np.uint64) + salt * GOLDEN)


def _digest(key: Sequence[str], salt: str, seed: int) -> Column:
    parts = [c(k).cast("string") for k in key]
    return F.md5(F.concat_ws(":", *parts, F.lit(salt), F.lit(str(seed))))


def _word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double")


def hash_uniform(key: Sequence[str], salt: str, seed: int) -> Column:
    """Uniform on [0, 1): the first 32 bits of md5(key : salt : seed)."""
    return _word(_digest(key, salt, seed), 1) / F.lit(_RANGE)


def hash_normal(key: Sequence[str], salt: str, seed: int) -> Column:
    """Standard normal by Box-Muller on two 32-bit words; the half step keeps ln() off zero."""
    digest = _digest(key, salt, seed)
    u1 = (_word(digest, 1) + F.lit(0.5)) / F.lit(_RANGE)
    u2 = (_word(digest, 9) + F.lit(0.5)) / F.lit(_RANGE)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
