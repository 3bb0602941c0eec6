"""Key normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as outer white space: the code points of Unicode's White_Space property and the four separators U+001C-1F.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def folded(c: Column) -> Column:
    """An identifier without case and outer white space; NULL where it is null or blank."""
    t = F.lower(F.btrim(c.cast("string"), F.lit(WHITE)))
    return F.when(t != "", t)


def key128(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the parts, as fixed-width join and grouping keys; NULL where the last part is NULL.

    128 bits make an accidental meeting of two keys among 10^11 less likely than 10^-16.
    """
    last = parts[-1]
    return F.when(last.isNotNull(), F.xxhash64(*parts)), F.when(last.isNotNull(), F.xxhash64(F.lit("second"), *reversed(parts)))
