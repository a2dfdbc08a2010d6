"""Route questions to prepared queries by shared words.

The prepared list is small and known when the plan is built, so it travels inside
the expression: questions of any number are scored in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A prepared question: its key words, how it reads, and its SQL."""

    words: tuple[str, ...]
    question: str
    sql: str


def question_words(question: Column) -> Column:
    """Distinct lower-case words and numbers of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9]+)"), F.lit(1)))


def _overlap(words: Column, template: Template) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in template.words])))


def _scored(words: Column, templates: Sequence[Template]) -> Column:
    return F.array(
        *[
            F.struct(
                _overlap(words, t).alias("overlap"),
                F.lit(-i).alias("order"),
                F.lit(t.question).alias("question"),
                F.lit(t.sql).alias("sql"),
                F.lit(max(2, len(t.words) - 1)).alias("needed"),
            )
            for i, t in enumerate(templates)
        ]
    )


def route(df: DataFrame, question: str, templates: Sequence[Template]) -> DataFrame:
    """Best template per question, null where none shares enough words.

    Most shared words win; the template listed first wins a tie.
    """
    scored = df.withColumn("__scored", _scored(question_words(F.col(question)), templates))
    fitting = F.filter("__scored", lambda s: s["overlap"] >= s["needed"])
    return scored.withColumn("__best", F.array_max(fitting)).select(
        *df.columns,
        F.col("__best.question").alias("matched"),
        F.coalesce(F.col("__best.overlap"), F.lit(0)).alias("overlap"),
        F.col("__best.sql").alias("sql"),
    )


def nearest(df: DataFrame, question: str, templates: Sequence[Template], n: int = 3) -> DataFrame:
    """The n closest templates per question, one row each, closest first."""
    scored = _scored(question_words(F.col(question)), templates)
    ranked = F.slice(F.sort_array(scored, asc=False), 1, n)
    return df.select(*df.columns, F.posexplode(ranked).alias("pos", "t")).select(
        *df.columns,
        (F.col("pos") + 1).cast("bigint").alias("place"),
        F.col("t.question").alias("example"),
        F.col("t.overlap").alias("overlap"),
    )
