"""What cleaning did to a delivery, shown on its own values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.text import normalise_id
from tally.functions.values import canonicalise_code
from tally.operators import drift, sentinels, showcase
from tally.plans.cleaning import code, dates, ids, junk, level, mojibake, placeholders
from tally.plans.cleaning import sentinels as sentinel_rule

STUDENT_STORIES = (
    replace(mojibake("family_name"), detail="Broken encodings are undone; lossy ones are left for a cleaner source."),
    replace(placeholders("given_name"), detail="Words that stand for nothing become nulls and stop counting as values."),
    replace(junk("family_name"), detail="Stray characters go; apostrophes, hyphens and accents stay."),
    replace(code("gender_code", "gender"), detail="Every spelling of a gender maps to one code."),
    replace(dates("birth_date"), detail="Day-first text becomes an ISO date; ISO dates pass unchanged."),
    replace(ids("local_id", "local_id"), detail="Leading zeros go, so both feeds agree on the id."),
)
RESULT_STORIES = (
    replace(code("test_domain", "domain"), detail="Every spelling of a domain maps to one name."),
    replace(sentinel_rule("raw_score"), detail="Codes for 'no score' become nulls before any average."),
    replace(level("test_level", "test_level"), detail="'Year 9' and 9 become one number."),
)


def before_after_examples(feeds: dict[str, DataFrame], limit: int = 5) -> DataFrame:
    """Real values each rule changed, a few per rule, with what the rule is for."""
    students = showcase.before_after(feeds["students"], STUDENT_STORIES, limit)
    results = showcase.before_after(feeds["results"], RESULT_STORIES, limit)
    shifted = results.withColumn("position", F.col("position") + len(STUDENT_STORIES))
    return students.unionByName(shifted).orderBy("position", "example")


def refused_but_attempted(feeds: dict[str, DataFrame], limit: int | None = 5) -> DataFrame:
    """Refused tests of a raw delivery that carry a score."""

    def canonical(column: str, vocabulary: str):
        return canonicalise_code(F.col(column), fixed.CODES[vocabulary])

    results = feeds["results"].select(
        normalise_id(F.col("STUDENT_KEY")).alias("student_id"), canonical("test_domain", "domain").alias("domain"), "raw_score"
    )
    participation = feeds["participation"].select(
        normalise_id(F.col("platform_student_id")).alias("student_id"),
        canonical("domain_name", "domain").alias("domain"),
        canonical("participation_code", "participation").alias("participation_code"),
    )
    return showcase.refused_but_attempted(results, participation, limit=limit)


def drift_check(feeds: dict[str, DataFrame], renamed: str = "student_platform_ref") -> DataFrame:
    """Rename the participation feed's key as a new year might, and look for it."""
    feed = feeds["participation"].withColumnRenamed("platform_student_id", renamed)
    return drift.detect_drift(feed, "student_id", "platform_student_id", feeds["results"], "STUDENT_KEY")


def sentinel_impact(feeds: dict[str, DataFrame]) -> DataFrame:
    """Bias of the mean raw score if "no score" codes were left in."""
    return sentinels.sentinel_impact(feeds["results"], "raw_score")
