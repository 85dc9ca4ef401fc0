"""Random numbers that depend on the row's key alone, never on its partition or position."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_digest(*key: Column | str | int) -> Column:
    """Hex md5 of the key parts joined by ``|``."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def digest_uniform(digest: Column, slot: int = 0) -> Column:
    """Uniform in (0, 1) from eight hex digits of a digest; slots 0 to 3 are independent."""
    digits = F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("double")
    return (digits + 0.5) / float(2**32)


def gaussian(digest: Column) -> Column:
    """Standard normal by Box-Muller."""
    radius = F.sqrt(-2.0 * F.log(digest_uniform(digest, 0)))
    return radius * F.cos(2.0 * math.pi * digest_uniform(digest, 1))


def poisson_one(uniform: Column) -> Column:
    """Poisson(1) count by inverting the distribution function at ``uniform``."""
    total, mass = 0.0, math.exp(-1.0)
    out = None
    for count in range(12):
        if count:
            mass /= count
        total += mass
        out = F.when(uniform <= total, count) if out is None else out.when(uniform <= total, count)
    return out.otherwise(12)
