"""Seeded hashes of ids: every draw, split and fold comes from here, never from rand()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def seeded_hash(seed: str | int, *parts: Column) -> Column:
    """A uniform integer in [0, 2^32): the first 32 bits of md5('seed:part:part...')."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
