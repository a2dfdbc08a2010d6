"""Inference on the clean tables: gaps, rankings and shrunk school means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import groups


def gender_gap(
    results: DataFrame,
    students: DataFrame,
    domain: str | None = "Numeracy",
    year_level: int | None = 9,
    confidence: float = 0.95,
) -> DataFrame:
    """Gap of F minus M, one row per level and domain.

    ``None`` for a filter keeps every value of it, so one job covers the grid.
    Only the columns that matter meet, and the join needs no common partitioning
    afterwards, so adaptive execution may split a hot student id.
    """
    scored = results.filter(F.col("scaled_score").isNotNull())
    if domain is not None:
        scored = scored.filter(F.col("domain") == domain)
    if year_level is not None:
        scored = scored.filter(F.col("year_level") == year_level)
    people = students.filter(F.col("gender").isin("F", "M")).select("student_id", "gender")
    joined = scored.select("student_id", "year_level", "domain", "scaled_score").join(people, "student_id")
    return groups.mean_gap(joined, "gender", "F", "M", "scaled_score", ["year_level", "domain"], confidence)


def _moments(results: DataFrame, schools: DataFrame, domain: str, by: Sequence[str]) -> DataFrame:
    one = results.filter(F.col("domain") == domain)
    return groups.school_moments(one, schools, "scaled_score", by=by)


def school_ranking(
    results: DataFrame,
    schools: DataFrame,
    domain: str = "Numeracy",
    min_n: int = groups.MIN_RELIABLE_N,
    by: Sequence[str] = ("school_name",),
) -> tuple[DataFrame, DataFrame]:
    """League table of schools large enough to rank, and the ones withheld."""
    ranking = groups.group_ranking(_moments(results, schools, domain, by), by, min_n)
    return groups.reliable_groups(ranking, by), groups.flagged_groups(ranking, by)


def school_effects(
    results: DataFrame, schools: DataFrame, domain: str = "Numeracy", by: Sequence[str] = ("school_name",)
) -> DataFrame:
    """Raw and shrunk mean per school."""
    return groups.shrink_means(_moments(results, schools, domain, by), by)
