"""Repeatable randomness: a draw depends on the key and the seed only.

No draw depends on the partitioning or on the order of rows, so a task that runs
again after a lost executor draws the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def coin(rate: float, seed: str, *key: Column) -> Column:
    """True with probability `rate`: the first 32 bits of an md5 digest, read as a
    fraction, are below it. Digits of equal length compare as their numbers do."""
    if rate >= 1:
        return F.lit(True)
    digest = F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))
    return F.substring(digest, 1, 8) < F.lit(f"{math.ceil(rate * 2**32):08x}")


def draw(seed: str, *key: Column, digits: int = 8) -> Column:
    """A whole number from 0 to less than 16 ** digits: the first hex digits of an md5
    digest, at most 15 of them."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def shuffle_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws("-", key, F.lit(seed)).cast("binary"))
