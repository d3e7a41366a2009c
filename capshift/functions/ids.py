"""Id normalisation and list splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace),
# so that ids are trimmed exactly as the reference trims them:
#   U+0009..U+000D, U+001C..U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A,
#   U+2028, U+2029, U+202F, U+205F, U+3000
PY_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def py_strip(c: Column) -> Column:
    """``str.strip()`` as a JVM expression (plain ``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(PY_SPACES))


def split_ids(c: Column, sep: str = ",") -> Column:
    """Comma list -> array of raw tokens (not yet trimmed)."""
    return F.split(c, sep, -1)
