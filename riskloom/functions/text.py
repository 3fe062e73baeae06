"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: all white-space characters of Unicode ---------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def keyword_hits(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the text, each counted once."""
    hits = F.lit(0)
    for word in keywords:
        hits = hits + c.contains(word).cast("int")
    return hits


def text_or_none(c: Column) -> Column:
    """Text of a value, with `None` for a missing one."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double, in plain notation from 0.0001 up to 1e16."""
    digits = F.regexp_replace(c.cast("string").try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    large, small = (F.abs(c) >= 1e7) & (F.abs(c) < 1e16), (F.abs(c) >= 1e-4) & (F.abs(c) < 1e-3)
    return F.when(large | small, plain).otherwise(c.cast("string"))
