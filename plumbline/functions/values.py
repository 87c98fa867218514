"""When a cell of a reading holds a value, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers and words that devices write where they have no value.
NO_VALUE_CODES = (-1.0, -99.0, -999.0, -9999.0)
NO_VALUE_WORDS = ("", "-", "--", "?", ".", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "unknown", "missing", "undefined")


def has_number(c: Column, codes: tuple[float, ...] = NO_VALUE_CODES) -> Column:
    """True or false, never null: not null, finite, and no code for "no value"."""
    # NaN sorts above every number in Spark, so the two comparisons refuse NaN and both infinities.
    return F.coalesce((c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))) & ~c.isin(*codes), F.lit(False))


def has_word(c: Column, words: tuple[str, ...] = NO_VALUE_WORDS) -> Column:
    """True or false, never null: not null, not blank, and no word for "no value" in any case of letters."""
    # Nothing is cut off between a first and a last character from ! to ~, and there the search for spaces is left out, which takes longer than all else.
    plain = (c >= F.lit("!")) & (c < F.lit("\x7f")) & F.substring(c, -1, 1).between("!", "~")
    bare = F.lower(F.when(plain, c).otherwise(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return F.coalesce(~bare.isin(*words), F.lit(False))


def number_or_null(c: Column, codes: tuple[float, ...] = NO_VALUE_CODES) -> Column:
    return F.when(has_number(c, codes), c)
