"""Screening of SQL text, as one chain of column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.text import trimmed

# A quoted piece, a comment, or anything else. Comments and literals are matched in
# one go, so a comment mark inside a literal is text and a quote inside a comment
# is not a literal. No nested repetition: safe on texts of any length.
PIECES = r"""('[^']*'|"[^"]*"|--[^\n]*|/\*[\s\S]*?\*/|[^'"/\-]+|[\s\S])"""

# Reasons of a refusal.
EMPTY = "empty query"
MULTIPLE = "only a single statement is allowed"
NOT_SELECT = "only SELECT queries are allowed"
WRITES = " is not permitted (read-only access)"


def without_comments(sql: Column) -> Column:
    """Line comments vanish, block comments become a space, literals stay."""
    pieces = F.regexp_extract_all(sql, F.lit(PIECES), F.lit(1))
    kept = F.transform(
        pieces,
        lambda p: F.when(p.startswith("--"), F.lit(""))
        .when(p.startswith("/*") & p.endswith("*/") & (F.length(p) >= 4), F.lit(" "))
        .otherwise(p),
    )
    return F.array_join(kept, "")


def cleaned_sql(sql: Column) -> Column:
    """The statement to run: no comments, no code fence, no closing semicolon."""
    bare = trimmed(without_comments(sql))
    unfenced = trimmed(F.regexp_replace(bare, r"(?i)^```(?:sql)?|```$", ""))
    return trimmed(F.rtrim(unfenced, F.lit(";")))


def probe_text(cleaned: Column) -> Column:
    """The statement with the contents of its string literals blanked."""
    return F.regexp_replace(cleaned, "'[^']*'", "''")


def screen(sql: Column, extra_words: Iterable[str] = ()) -> Column:
    """``struct(ok, sql, reason)`` of a statement; never fails on any text.

    Refusals in order: empty, several statements, a forbidden word, not a SELECT.
    """
    words = "|".join([*fixed.FORBIDDEN_WORDS, *extra_words])
    cleaned = cleaned_sql(sql)
    probe = probe_text(cleaned)
    word = F.regexp_extract(probe, rf"(?i)\b({words})\b", 1)
    reason = (
        F.when(F.coalesce(trimmed(sql), F.lit("")) == "", F.lit(EMPTY))
        .when(probe.contains(";"), F.lit(MULTIPLE))
        .when(word != "", F.concat(F.lit("'"), F.upper(word), F.lit("'"), F.lit(WRITES)))
        .when(~cleaned.rlike(r"(?i)^\s*(select|with)\b"), F.lit(NOT_SELECT))
        .otherwise(F.lit(""))
    )
    ok = reason == ""
    return F.struct(ok.alias("ok"), F.when(ok, cleaned).otherwise(F.lit("")).alias("sql"), reason.alias("reason"))
