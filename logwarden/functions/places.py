"""Place of an address from the md5 of its text, as 128-bit arithmetic on 32-bit limbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


# One remainder answers all three: 13 places, 200 steps, and 200 steps of the value without its last
# hex digit, which are the sixteens of the value modulo 3200.
_MODULUS = len(V.GEO_POOL) * V.JITTER_STEPS * 16


def digest_remainder(digest: Column) -> Column:
    """The 32 hex digits as a number, modulo ``_MODULUS``: folded over four 32-bit limbs."""
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        limb = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        rest = (rest * (2**32 % _MODULUS) + limb) % _MODULUS
    return rest


def pool_index(remainder: Column) -> Column:
    return (remainder % len(V.GEO_POOL)).cast("int")


def latitude_jitter(remainder: Column) -> Column:
    return (remainder % V.JITTER_STEPS - 100) * V.JITTER_SIZE


def longitude_jitter(remainder: Column) -> Column:
    """From the digest shifted right by four bits."""
    return (F.floor(remainder % (V.JITTER_STEPS * 16) / 16) - 100) * V.JITTER_SIZE
