"""Raw warehouse feeds to the three clean tables and the audit."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally import fixed
from tally.functions import text, values
from tally.operators import audit, reshape, rows
from tally.operators.audit import Rule
from tally.session import stage
from tally.sources.describe import annotate
from tally.sources.files import read_table, scan_text_csv, write_tables

# Source column of each clean column, per feed.
STUDENT_COLUMNS = {
    "student_id": "student_id",
    "enrolment_id": "enrolment_id",
    "year_level": "year_level",
    "most_recent_school_id": "school_id",
    "family_name": "family_name",
    "given_name": "given_name",
    "middle_name": "middle_name",
    "gender_code": "gender",
    "birth_date": "birth_date",
}
RESULT_COLUMNS = {
    "student_id": "student_id",
    "year_level": "year_level",
    "school_id": "school_id",
    "domain": "domain",
    "raw_score": "raw_score",
    "scaled_score": "scaled_score",
    "proficiency_band": "proficiency",
    "test_year": "test_year",
}
PARTICIPATION_COLUMNS = {
    "student_id": "student_id",
    "domain": "domain",
    "participation_code": "participation_code",
    "cal_year": "cal_year",
}
SCHOOL_COLUMNS = {
    "acara_id": "school_id",
    "school_name": "school_name",
    "sector_code": "sector",
    "postcode": "postcode",
}


def mojibake(column: str, **kw) -> Rule:
    return Rule("repair_mojibake", column, text.repair_mojibake, detail="double-encoded only", **kw)


def junk(column: str, **kw) -> Rule:
    return Rule("strip_junk_characters", column, text.strip_junk, **kw)


def placeholders(column: str, **kw) -> Rule:
    return Rule("blank_placeholders", column, text.blank_placeholders, **kw)


def ids(column: str, source: str, **kw) -> Rule:
    return Rule("normalise_id", column, text.normalise_id, source=source, **kw)


def code(column: str, vocabulary: str, source: str | None = None, **kw) -> Rule:
    words = fixed.CODES[vocabulary]
    unresolved = lambda before, after: before.isNotNull() & values.lookup(before, words).isNull()
    return Rule(
        "canonicalise_code",
        column,
        lambda c: values.canonicalise_code(c, words),
        source=source,
        detail=f"{vocabulary}; {{}} unresolved",
        detail_count=unresolved,
        **kw,
    )


def dates(column: str, **kw) -> Rule:
    return Rule(
        "parse_dates", column, values.parse_dates, counter=audit.present,
        detail="{} unparseable", detail_count=audit.lost, **kw,
    )


def level(column: str, source: str, **kw) -> Rule:
    return Rule("parse_year_level", column, values.parse_level, source=source, **kw)


def sentinels(column: str, source: str | None = None, **kw) -> Rule:
    return Rule("recode_sentinels", column, values.recode_sentinels, source=source, **kw)


def numeric(column: str, source: str | None = None, fn=values.coerce_numeric, **kw) -> Rule:
    return Rule("coerce_numeric", column, fn, source=source, counter=audit.lost, detail="non-numeric -> null", **kw)


STUDENT_RULES = (
    mojibake("family_name"),
    junk("family_name"),
    mojibake("given_name"),
    placeholders("given_name"),
    junk("middle_name"),
    code("gender_code", "gender"),
    dates("birth_date"),
    level("year_level", "most_recent_test_level"),
    ids("student_id", "STUDENT_KEY"),
    ids("enrolment_id", "local_id"),
)

RESULT_RULES = (
    code("domain", "domain", "test_domain"),
    level("year_level", "test_level"),
    ids("student_id", "STUDENT_KEY"),
    sentinels("raw_score"),
    numeric("raw_score"),
    sentinels("scaled_score", "scale_score"),
    numeric("scaled_score"),
    numeric("test_year", "cal_year", values.whole_number),
)

PARTICIPATION_RULES = (
    ids("student_id", "platform_student_id", label="part.student_id"),
    code("domain", "domain", "domain_name", label="part.domain"),
    code("participation_code", "participation"),
)

SCHOOL_RULES = (
    junk("school_name"),
    Rule("normalise_whitespace_case", "school_name", lambda c: text.trim_case(c, "title"), detail="title"),
    placeholders("sector_code"),
    Rule("pad_postcode", "postcode", text.pad_code),
)


@dataclass
class Cleaned:
    """A clean table and the report of what it took to get there."""

    table: DataFrame
    report: DataFrame


def _distinct(raw: DataFrame, rules, columns: dict[str, str], name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct clean rows and their report, from one pass over the raw feed.

    The rules' counters are summed while copies collapse, so one shuffle and one
    written table serve both the rows and every count.
    """
    done = audit.apply_rules(raw, rules)
    tidy = done.df.select(*[F.col(a).alias(b) for a, b in columns.items()], *done.flags)
    counted = stage(rows.with_copies(tidy, done.flags), name)
    report = audit.union_reports(audit.rule_report(counted, rules, summed=True), rows.copies_report(counted, name))
    return counted.select(*columns.values()), report


def clean_students(raw: DataFrame) -> Cleaned:
    """One row per student; a conflict keeps the lowest school id."""
    unique, report = _distinct(raw, STUDENT_RULES, STUDENT_COLUMNS, "students")
    conflicts = rows.conflict_report(unique, "student_id", "school_id", ascending=True)
    table = rows.resolve_conflicts(unique, "student_id", "school_id", ascending=True)
    return Cleaned(table, report.unionByName(conflicts))


def clean_participation(raw: DataFrame) -> Cleaned:
    return Cleaned(*_distinct(raw, PARTICIPATION_RULES, PARTICIPATION_COLUMNS, "participation"))


def clean_results(raw: DataFrame, participation: Cleaned) -> Cleaned:
    """One row per result; a refusal's scores are zero whatever was delivered."""
    unique, report = _distinct(raw, RESULT_RULES, RESULT_COLUMNS, "results")
    # Read by the table and by the report.
    overridden = stage(reshape.zero_refused(unique, participation.table), "overridden")
    report = audit.union_reports(report, participation.report, reshape.refused_report(overridden))
    return Cleaned(overridden.select(*unique.columns), report)


def clean_schools(raw: DataFrame, non_schools=fixed.NON_SCHOOL_IDS) -> Cleaned:
    """Real schools only."""
    unique, report = _distinct(raw, SCHOOL_RULES, SCHOOL_COLUMNS, "schools")
    listed = F.col("school_id").isin(*non_schools)
    dropped = audit.count_row(unique, "drop_non_schools", "school_id", F.count_if(listed), "pseudo/home")
    return Cleaned(rows.exclude_ids(unique, "school_id", non_schools), report.unionByName(dropped))


def run_cleaning(feeds: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Clean tables and the full report from the four raw feeds."""
    participation = clean_participation(feeds["participation"])
    cleaned = {
        "students": clean_students(feeds["students"]),
        "results": clean_results(feeds["results"], participation),
        "schools": clean_schools(feeds["schools"]),
    }
    tables = {name: c.table for name, c in cleaned.items()}
    return tables, audit.union_reports(*[c.report for c in cleaned.values()])


def read_feeds(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The four warehouse files of a delivery folder."""
    names = ("students", "results", "participation", "schools")
    return {n: scan_text_csv(spark, os.path.join(raw_dir, f"warehouse_{n}.csv")) for n in names}


def build_tables(spark: SparkSession, raw_dir: str, out_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Clean a delivery, replace the tables under ``out_dir``, return both."""
    tables, report = run_cleaning(read_feeds(spark, raw_dir))
    write_tables({n: annotate(df) for n, df in tables.items()}, out_dir)
    return {n: read_table(spark, out_dir, n) for n in tables}, report
