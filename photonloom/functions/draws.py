"""Reproducible draws: every random choice is a function of a key, so a lost task repeats the same choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities, the number of copies a bootstrap replicate holds of one row.
POISSON_CDF = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581519,
               0.99991675886, 0.99998980292, 0.99999887498)


def key_text(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash32(text: Column, word: int = 0) -> Column:
    """One of the four 32-bit words of the MD5 digest, as bigint."""
    return F.conv(F.substring(F.md5(text), 1 + 8 * word, 8), 16, 10).cast("bigint")
