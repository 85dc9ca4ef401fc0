"""Bit tables of digests: a filter whose size is fixed by its number of bits, so it may be
broadcast however many digests are in it. A set bit may be another digest's; a digest of the
table always has its bit set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_table(digests: DataFrame, bits: int, digest: str = "digest") -> np.ndarray:
    """One bit for each of the ``2 ** bits`` leading parts of a digest, eight to a byte. Tasks
    merge the bits; at most ``2 ** (bits - 6)`` numbers reach the driver."""
    place = F.shiftrightunsigned(F.col(digest), 64 - bits)
    words = digests.select(F.shiftright(place, 6).cast("int").alias("word"), place.alias("place"))
    words = words.withColumn("bit", F.expr("shiftleft(1L, cast(place & 63 as int))"))
    merged = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << max(bits - 6, 0), np.uint64)
    table[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return table.view(np.uint8)


def set_bits(table: np.ndarray, bits: int) -> np.ndarray:
    """Places of the set bits."""
    return np.flatnonzero(np.unpackbits(table, bitorder="little")[: 1 << bits])


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The leading parts that index a table of ``2 ** bits`` entries."""
    return (digests >> np.uint64(64 - bits)).astype(np.int64)


def passes(table: np.ndarray, digests: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each digest is set."""
    at = places(digests, bits)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
