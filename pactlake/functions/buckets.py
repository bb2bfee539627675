"""A logarithmic histogram of doubles whose merge is addition: 64 buckets to a power of two.

A bucket is the number's sign and the first 18 bits below it (11 of the exponent, 6 of the fraction
and the implied one), so any order of rows and any split into parts give the same counts; a value lies
within 1/128 of its bucket's middle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_OCTAVE = 64
#: Buckets of each sign that a profile keeps; the smallest magnitudes are folded into the least kept.
MAX_BUCKETS = 4096
_LEAST_NORMAL = 2.2250738585072014e-308


def bucket(x: Column) -> Column:
    """Of a finite double: the number of its magnitude's bucket; 0 for zero. Larger is larger. Without
    branches, so that Catalyst evaluates what is repeated once; the logarithm may be off by one either way."""
    a = F.abs(x)
    two_to = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a))  # null for zero
    e = guess - (two_to(guess) > a).cast("int") + (two_to(guess + 1) <= a).cast("int")
    normal = (e + 1023) * PER_OCTAVE + F.floor((a / two_to(e) - 1) * PER_OCTAVE)
    is_tiny = (a < _LEAST_NORMAL).cast("int")
    tiny = F.floor(F.least(a, F.lit(_LEAST_NORMAL)) * F.lit(2.0**1000) * F.lit(2.0**28))
    return F.coalesce((normal * (1 - is_tiny) + tiny * is_tiny).cast("long"), F.lit(0).cast("long"))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def middle(number: int) -> float:
    """The middle of a bucket's magnitudes."""
    return lower(number) / 2 + lower(number + 1) / 2


def lower(number: int) -> float:
    """The least magnitude of a bucket."""
    e, part = divmod(number, PER_OCTAVE)
    if e > 2046:
        return 1.7976931348623157e308  # beyond the last bucket
    return (part / PER_OCTAVE) * 2.0**-1022 if e == 0 else (1 + part / PER_OCTAVE) * 2.0 ** (e - 1023)
