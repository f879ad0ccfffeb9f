"""Reproducible pseudo-random numbers and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Results are shown with so many digits; nothing is compared after rounding.
DIGITS = 6
#: Hexadecimal digits of a hash that make a number: 52 bits, which a double holds exactly.
HEX = 13


def uniform(a: Column | str, b: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1] from two integers, 52 bits of their md5, the same in any engine."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    key = F.concat_ws("|", F.lit(str(seed)), a.cast("long").cast("string"), b.cast("long").cast("string"))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX), 16, 10).cast("long")
    return (bits + 1).cast("double") / F.lit(float(16**HEX))


def rounded(x: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, with zero for minus zero."""
    return F.round(x, digits) + F.lit(0.0)
