"""Number, level, code and date rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.text import folded, trimmed

# Plain decimal text; rules out Java forms such as 1d and 1f.
NUMBER_TEXT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"

# Month abbreviations of day-month-year text.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# First two-digit year read as 19xx.
YEAR_PIVOT = "69"


def recode_sentinels(c: Column, sentinels: Iterable[str] = fixed.SENTINELS) -> Column:
    """Null for a number that means "no score". Text match, so 999.00 is a score."""
    return F.when(trimmed(c.cast("string")).isin(*sentinels), F.lit(None)).otherwise(c)


def coerce_numeric(c: Column) -> Column:
    """Double, or null where the text is not a number."""
    text = trimmed(c.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def whole_number(c: Column) -> Column:
    """Nullable whole number."""
    return coerce_numeric(c).try_cast("bigint")


def parse_level(c: Column) -> Column:
    """First run of digits as a whole number: ``3`` and ``Year 3`` agree."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def recode_not_attempted(c: Column, mark: int = fixed.NOT_ATTEMPTED) -> Column:
    """Zero for an item that was not attempted."""
    return F.when(c == mark, F.lit(0)).otherwise(c)


# --- codes --------------------------------------------------------------------


def lookup(c: Column, vocabulary: Mapping[str, Iterable[str]]) -> Column:
    """Canonical form of a coded value, null where the spelling is unknown."""
    pairs = {v.strip().lower(): canon for canon, spellings in vocabulary.items() for v in spellings}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(table, folded(c))


def canonicalise_code(c: Column, vocabulary: Mapping[str, Iterable[str]]) -> Column:
    """Canonical form of a coded value; an unknown spelling is kept."""
    return F.coalesce(lookup(c, vocabulary), c)


# --- dates --------------------------------------------------------------------


def parse_date(c: Column) -> Column:
    """Date from ISO text, or from day-first text falling back to month-first.

    ISO text is never re-read day-first. Other text is cut at its separators and
    reassembled as ISO, so a value that fits no format costs a null rather than a
    formatter exception per attempt. A two-digit year takes the POSIX pivot.
    """
    cut = F.translate(c, "/", "-")
    first, year = F.substring_index(cut, "-", 1), F.substring_index(cut, "-", -1)
    second = F.substring_index(F.substring_index(cut, "-", 2), "-", -1)
    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))])
    second = F.coalesce(F.try_element_at(named, F.lower(second)), second)
    century = F.when(F.length(year) == 4, F.lit("")).when(year >= YEAR_PIVOT, F.lit("19")).otherwise(F.lit("20"))
    year = F.concat(century, year)
    day_first = F.concat_ws("-", year, second, first).try_cast("date")
    month_first = F.concat_ws("-", year, first, second).try_cast("date")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")).when(
        c.rlike(r"^\d{1,2}([/-])(\d{1,2}|[A-Za-z]{3})\1\d{2}(\d{2})?$"),
        F.coalesce(day_first, month_first),
    )


def parse_dates(c: Column) -> Column:
    """The same date as ISO text."""
    return F.date_format(parse_date(c), "yyyy-MM-dd")
