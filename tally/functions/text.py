"""Text and identifier rules. Each takes a string column and returns a column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally import fixed


def trimmed(c: Column) -> Column:
    """Strip blanks of every kind from both ends (``trim`` alone keeps tabs)."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def folded(c: Column) -> Column:
    """Lookup form of a value: trimmed and lower-cased."""
    return F.lower(trimmed(c))


def repair_mojibake(c: Column, repairs: Mapping[str, str] = fixed.MOJIBAKE) -> Column:
    """Undo recoverable double encodings; lossy marks stay as they are."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), repairs.items(), c)


def blank_placeholders(c: Column, words: Iterable[str] = fixed.PLACEHOLDERS) -> Column:
    """Null for placeholder text; anything else is returned untouched."""
    return F.when(folded(c).isin(*words), F.lit(None)).otherwise(c)


def strip_junk(c: Column, junk: str = fixed.JUNK) -> Column:
    """Delete characters that cannot be part of a name."""
    return F.translate(c, junk, "")


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` restarts after a space only, so a marked space is put before each
    letter that follows a non-letter and taken out again afterwards.
    """
    mark = "\x01 "
    spaced = F.regexp_replace(c, r"(\P{L})(?=\p{L})", f"$1{mark}")
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


_CASES = {
    None: lambda c: c,
    "upper": F.upper,
    "lower": F.lower,
    "title": title_case,
    "initcap": F.initcap,
}


def trim_case(c: Column, case: str | None = None) -> Column:
    """Trim, then fold case: ``upper``, ``lower``, ``title``, ``initcap`` or none.

    ``title`` restarts after every non-letter (``O'Brien``, ``St Mark'S``);
    ``initcap`` only after blanks (``O'brien``, ``St Mark's``).
    """
    return _CASES[case](trimmed(c))


def normalise_id(c: Column) -> Column:
    """Join form of an identifier: trimmed, no leading zeros, ``0`` if nothing is left."""
    digits = F.ltrim(trimmed(c), F.lit("0"))
    return F.when(digits == "", F.lit("0")).otherwise(digits)


def pad_code(c: Column, width: int = 4) -> Column:
    """Restore lost leading zeros; a longer value is kept whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def is_lossy(c: Column) -> Column:
    """True where a value still carries an unrecoverable encoding mark."""
    hits = [c.contains(mark) for mark in fixed.LOSSY_MARKS]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def is_odd_name(c: Column) -> Column:
    """True where a name holds anything but letters, apostrophe, hyphen and space."""
    return F.coalesce(~c.rlike(r"^[\p{L}' -]+$"), F.lit(False))
