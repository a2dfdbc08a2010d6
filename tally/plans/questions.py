"""Prepared questions over the clean tables, and the guarded way to ask them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally import fixed
from tally.functions.sqltext import screen
from tally.operators.routing import Template, nearest, route
from tally.plans.plancheck import refused_by_plan
from tally.session import literal_rows, stage, tune
from tally.sources.files import table_path

ROW_LIMIT = 1000
MIN_GROUP = 20

# Key words and wording of the prepared questions, in match order.
TEMPLATES = (
    Template(
        ("average", "writing", "year", "level"),
        "average writing score by year level",
        """SELECT year_level, round(avg(scaled_score), 1) AS avg_writing, count(*) AS n
FROM results
WHERE domain = 'Writing' AND scaled_score IS NOT NULL
GROUP BY year_level
ORDER BY year_level""",
    ),
    Template(
        ("top", "schools", "average", "numeracy"),
        "top 10 schools by average numeracy score",
        """SELECT school_name, round(avg(scaled_score), 1) AS avg_numeracy, count(*) AS n
FROM results JOIN schools USING (school_id)
WHERE domain = 'Numeracy' AND scaled_score IS NOT NULL
GROUP BY school_name
HAVING count(*) >= 20
ORDER BY avg_numeracy DESC, school_name
LIMIT 10""",
    ),
    Template(
        ("average", "year", "9", "numeracy", "gender"),
        "average year 9 numeracy score by gender",
        """SELECT gender, round(avg(scaled_score), 1) AS avg_scaled_score, count(*) AS n
FROM results JOIN students USING (student_id)
WHERE results.year_level = 9 AND domain = 'Numeracy' AND scaled_score IS NOT NULL
GROUP BY gender
ORDER BY gender NULLS LAST""",
    ),
    Template(
        ("average", "score", "domain"),
        "average scaled score by domain",
        """SELECT domain, round(avg(scaled_score), 1) AS avg_scaled_score, count(*) AS n
FROM results
WHERE scaled_score IS NOT NULL
GROUP BY domain
ORDER BY avg_scaled_score DESC, domain""",
    ),
    Template(
        ("proficiency", "reading", "year", "5"),
        "proficiency band distribution for year 5 reading",
        """SELECT proficiency, count(*) AS students
FROM results
WHERE year_level = 5 AND domain = 'Reading' AND proficiency IS NOT NULL
GROUP BY proficiency
ORDER BY students DESC, proficiency""",
    ),
    Template(
        ("how", "many", "students", "sector"),
        "how many students sat, by school sector",
        """SELECT sector, count(DISTINCT student_id) AS students
FROM results JOIN schools USING (school_id)
WHERE scaled_score IS NOT NULL
GROUP BY sector
ORDER BY students DESC, sector""",
    ),
)


# --- the same questions as frames, with the measure and keys as parameters ------


def average_by(df: DataFrame, keys: list[str], score: str, name: str, digits: int = 1) -> DataFrame:
    """Rounded mean and count of scored rows per group."""
    scored = df.filter(F.col(score).isNotNull())
    return scored.groupBy(*keys).agg(F.round(F.avg(score), digits).alias(name), F.count("*").alias("n"))


def top_groups(
    facts: DataFrame, dims: DataFrame, on: str, label: str, score: Column, name: str,
    k: int = 10, min_n: int = MIN_GROUP, digits: int = 1,
) -> DataFrame:
    """Best k groups by mean. Facts are summed per key before the dimension joins."""
    per_key = (
        facts.select(on, score.alias("__s")).filter("__s IS NOT NULL")
        .groupBy(on).agg(F.sum("__s").alias("__total"), F.count("*").alias("__n"))
    )
    groups = per_key.join(dims.select(on, label), on).groupBy(label).agg(
        F.round(F.sum("__total") / F.sum("__n"), digits).alias(name), F.sum("__n").alias("n")
    )
    return groups.filter(F.col("n") >= min_n).orderBy(F.desc(name), label).limit(k)


def band_counts(df: DataFrame, band: str, name: str = "students") -> DataFrame:
    known = df.filter(F.col(band).isNotNull())
    return known.groupBy(band).agg(F.count("*").alias(name)).orderBy(F.desc(name), band)


def distinct_by_group(
    facts: DataFrame, dims: DataFrame, on: str, label: str, member: str, name: str, approximate: bool = False
) -> DataFrame:
    """Distinct members per group. The dimension joins first, so facts are shuffled once, as partial distincts."""
    pairs = facts.select(on, member).join(dims.select(on, label), on)
    distinct = F.approx_count_distinct(member) if approximate else F.countDistinct(member)
    return pairs.groupBy(label).agg(distinct.alias(name)).orderBy(F.desc(name), label)


# --- asking -------------------------------------------------------------------


@dataclass
class Answer:
    """What was asked, the SQL that answers it, and the rows or the reason why not."""

    question: str
    sql: str = ""
    rows: DataFrame | None = None
    truncated: bool = False
    error: str = ""
    suggestion: str = ""
    examples: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.error and self.rows is not None


def screen_one(spark: SparkSession, sql: str | None, extra_words=()) -> tuple[bool, str, str]:
    """``(ok, sql, reason)`` of a single statement."""
    one = literal_rows(spark, ("sql",), [(sql or "",)]).select(screen(F.col("sql"), extra_words).alias("s"))
    verdict = one.first()["s"]
    return verdict["ok"], verdict["sql"], verdict["reason"]


def capped(df: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    return df.limit(limit)


def guarded_session(spark: SparkSession, tables: dict[str, str]) -> SparkSession:
    """A session that sees the given parquet tables and cannot open files by name."""
    session = tune(spark.newSession())
    for name, path in tables.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    return session


def run_guarded(spark: SparkSession, sql: str, tables: dict[str, str], row_limit: int = ROW_LIMIT) -> Answer:
    """Screen a statement, then run it read-only with a row cap; ``truncated`` says that the cap cut rows.

    The text is screened first, then the tree that Spark parses it to: commands, scripts, functions that
    run JVM code and relations other than ``tables`` are refused. The statement stays on the answer
    whatever happens. It runs once, for one row more than is shown.
    """
    ok, cleaned, reason = screen_one(spark, sql)
    answer = Answer(question="", sql=cleaned or sql)
    if ok:
        reason = refused_by_plan(spark, cleaned, tables)
    if reason:
        answer.error = reason
        answer.suggestion = "Ask for a plain SELECT over the listed tables."
        return answer
    try:
        rows = stage(guarded_session(spark, tables).sql(cleaned).limit(row_limit + 1), "answer")
        answer.truncated = rows.count() > row_limit
        answer.rows = capped(rows, row_limit)
    except (PySparkException, ValueError) as exc:
        answer.error = f"execution failed: {exc}"
        answer.suggestion = "The statement reads well but did not run; check names against the tables."
    return answer


def answer_question(
    spark: SparkSession, question: str, tables: dict[str, str], templates=TEMPLATES, row_limit: int = ROW_LIMIT
) -> Answer:
    """Answer from the prepared questions, or show the closest ones."""
    asked = literal_rows(spark, ("question",), [(question,)])
    sql = route(asked, "question", templates).first()["sql"]
    if sql is None:
        close = nearest(asked, "question", templates).orderBy("place").collect()
        return Answer(
            question,
            error="No prepared question matches.",
            suggestion="Try one of these:",
            examples=[r["example"] for r in close],
        )
    answer = run_guarded(spark, sql, tables, row_limit)
    answer.question = question
    return answer


def clean_paths(root: str, names=("students", "results", "schools")) -> dict[str, str]:
    """Where the clean tables under ``root`` lie now."""
    return {n: table_path(SparkSession.active(), root, n) for n in names}
